"""Thin queries over the operators, registered as ``opN_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertide.llm import (
    bpe, centroids, decontaminate, langid, lm, mixing, ngram_join, sharding, spelling, suffixes, tokens, vector_join,
    warc,
)
from embertide.session import configure

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}
TOKENIZER = "byte_bpe_50k.json"


def llm_queries() -> dict[str, tuple[Query, str | None]]:
    return dict(_QUERIES)


def query(name: str, table: str, oracle: str | None = None):
    """Register a function of whole tables (names divided by spaces)."""
    def add(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            read = configure(spark).read
            return build(*[read.parquet(f"{folder}/{t}.parquet") for t in table.split()])

        run.__name__ = name
        _QUERIES[name] = (run, oracle)
        return build

    return add


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS last FROM p WHERE octet_length(body) >= 1000 GROUP BY payload_digest
)
SELECT page_id, octet_length(body) AS payload_bytes, p.payload_digest,
       CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND octet_length(body) >= 1000
"""


@query("op1_parity_join", "documents")
def _(docs):
    return ngram_join.jaccard_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id")


@query("op2_qgram_matches", "documents benchmark")
def _(docs, items):
    return decontaminate.matches(docs, items)


@query("op3_suffix_repeats", "documents")
def _(docs):
    return suffixes.repeated_bytes(docs)


@query("op4_legacy_archives", "pages", OP4_SQL)
def _(pages):
    return warc.archived_pages(pages)


@query("op5_language_mixture", "documents")
def _(docs):
    out = langid.held_out(F.col("doc_id"), 4)
    model = langid.fit(docs, where=~out)
    return langid.identify(docs, model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "languages", "shares")


@query("op6_source_mix", "documents")
def _(docs):
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_subspace_join", "embeddings")
def _(vectors):
    return vector_join.near_vectors(vectors, 0.93)


@query("op8_class_model", "documents")
def _(docs):
    out = langid.held_out(F.col("doc_id"), 7)
    return lm.class_scores(docs, ~out).select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score", "perplexity")


@query("op9_token_files", "documents")
def _(docs):
    return tokens.token_output(docs, tokenizer_path())


@query("op10_minimax_shards", "documents")
def _(docs):
    return sharding.minimax_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op11_spelling_variants", "documents")
def _(docs):
    return spelling.variants(docs)


@query("op12_bpe_round_trip", "documents")
def _(docs):
    path = tokenizer_path()
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return bpe.decode(bpe.encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The same clustering in SQL, one step a round."""
    nearest = """SELECT id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT v.id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d
      FROM v CROSS JOIN {m} m) GROUP BY id, x"""
    steps = [f"""v AS MATERIALIZED (
      SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 1024)::HUGEINT) AS x
      FROM embeddings WHERE len(embedding) = {dim}
      AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}
    ), m0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS m
      FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})
    )"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({nearest.format(m=f"m{r}")}), m{r + 1} AS MATERIALIZED (
      SELECT o.c, coalesce(n.m, o.m) AS m FROM m{r} o LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
          SELECT c, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n
          FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n
      ON n.c = o.c)""")
    steps.append(f"z AS MATERIALIZED ({nearest.format(m=f'm{rounds}')})")
    return "WITH " + ", ".join(steps) + f"""
    SELECT v.vec_id, z.c::INT AS cluster, z.d::BIGINT AS distance, sum(z.d) OVER (PARTITION BY z.c)::BIGINT AS cluster_inertia,
      sum(z.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.m, ',')) AS centroid_sha256
    FROM z JOIN v ON v.id = z.id JOIN m{rounds} m ON m.c = z.c"""


@query("op13_hilbert_centroids", "embeddings", op13_sql())
def _(vectors):
    return centroids.cluster(vectors)
