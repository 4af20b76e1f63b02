"""Documents into training tokens: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``documents``. A stage decides by row, that is by doc_id and text: rows whose doc_id is null, or stands for
several texts, are judged like all others. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertide.llm import decontaminate, langid, mixing, ngram_join, tokens
from embertide.llm.common import Stage, only_result
from embertide.llm.queries import tokenizer_path
from embertide.session import checked_broadcast, configure

LEAST_SHARE = 0.5  # of a text that its main language must hold
WORDS, SHARE = 5, 80  # shingle length and Jaccard percentage of near duplicates
NEEDED_ROWS = 1_000_000  # ids of 8 bytes that may be broadcast; beyond, the join shuffles


def _rows(docs: DataFrame) -> DataFrame:
    """Documents with ``_row``, a hash of doc_id and text: equal for equal rows, whatever the doc_id."""
    return docs.withColumn("_row", F.xxhash64(
        F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but for the given rows (column ``_row``)."""
    held = Stage(docs.sparkSession).put(rows.select("_row").distinct(), "rows")
    return _rows(docs).join(checked_broadcast(held, NEEDED_ROWS), "_row", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or has no language that holds half of it."""
    model = langid.fit(docs, where=~langid.held_out(F.col("doc_id"), 4))
    found = langid.identify(_rows(docs), model, doc_id="_row").withColumnRenamed("doc_id", "_row")
    return _without(docs, found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SHARE)))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id stays, once."""
    classes = ngram_join.jaccard_components(_rows(docs), WORDS, SHARE, doc_id="_row").select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_class")).distinct()
    many = classes.groupBy("_class").count().where("count > 1").select("_class")
    grouped = Stage(spark).put(classes.join(many, "_class", "left_semi"), "grouped")
    ids = _rows(docs.select("doc_id", "text")).select("doc_id", "_row").join(
        checked_broadcast(grouped, NEEDED_ROWS), "_row")
    first = ids.groupBy("_class").agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row"))
    kept = _rows(_without(docs, grouped.join(Stage(spark).put(first, "first").select("_row"), "_row", "left_anti")))
    # rows that are repeated as a whole
    twice = Stage(spark).put(kept.groupBy("_row").count().where("count > 1").select("_row"), "twice")
    twice = checked_broadcast(twice, NEEDED_ROWS)
    return kept.join(twice, "_row", "left_anti").unionByName(
        kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"])).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which a passage of ``benchmark`` occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.matches(_rows(docs), items, doc_id="_row").withColumnRenamed("doc_id", "_row"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, to the nearest whole; 0 to 3 rows."""
    chosen = mixing.mix_sources(_rows(docs), doc_id="_row").where("size > 0").groupBy("doc_id").agg(
        F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias("_copies")).where("_copies > 0")
    chosen = checked_broadcast(Stage(spark).put(chosen.withColumnRenamed("doc_id", "_row"), "copies"), NEEDED_ROWS)
    taken = _rows(docs).join(chosen, "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_output(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token output", token_files),
]

#: Language inference, tokenization and coding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier: list[str] = []
    for number, (_, stage) in enumerate(STAGES):
        with only_result(spark, earlier) as keep:  # tables of a stage, and the stage before, go once it is on disk
            docs = keep(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
