"""The registered queries on the fixture tables against brute force, row for row."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import brute
from embertide.llm.queries import llm_queries, tokenizer_path

QUERIES = llm_queries()


def rows(spark, folder, start):
    name = next(n for n in QUERIES if n.startswith(start))
    return QUERIES[name][0](spark, folder).collect()


def test_parity_join(spark, folder, documents):
    want = brute.jaccard_classes({i: t for i, t, _, _ in documents}, 3, 90)
    got = rows(spark, folder, "op1_")
    assert len(got) == len(documents)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert any(i != c for i, (_, c) in want.items())


def test_qgram_matches(spark, folder, documents):
    got = {(r.doc_id, r.item_id): r for r in rows(spark, folder, "op2_")}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    plain = lambda t: " ".join((t or "").lower().split())
    for i, t, _, _ in documents:
        for k, item in items.items():
            if len(plain(item)) < 10:
                assert (i, k) not in got
                continue
            if plain(item) in plain(t):
                assert got[i, k].edits == 0
                assert plain(t[got[i, k].start:got[i, k].end]).startswith(plain(item)[:70])
            elif (i, k) in got:  # some window within the budget
                text = plain(t)
                windows = [plain(item)[s:s + 80] for s in range(0, len(plain(item)) - 79)]
                assert min(brute.edits_within(w, text) for w in windows[::4] + windows[-1:]) <= 8
    assert any(i == 2001 for i, _ in got)  # two edits, other case and white space
    assert not any(i == 2002 for i, _ in got)


def test_suffix_repeats(spark, folder, documents):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, folder, "op3_")))
    assert got == sorted(brute.repeats([(i, t) for i, t, _, _ in documents]))


def test_legacy_archives(spark, folder):
    base = duckdb.connect()
    base.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    name = "op4_legacy_archives"
    found = base.sql(QUERIES[name][1])
    got = QUERIES[name][0](spark, folder).select(*found.columns).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(found.fetchall(), key=key)
    assert sum(r.record_type == "revisit" for r in got) == 3
    assert {5008, 5009} <= {r.page_id for r in got}


def test_language_mixture(spark, folder, documents):
    got = {r.doc_id: r for r in rows(spark, folder, "op5_")}
    truth = {i: lang for i, _, _, lang in documents if i < 60}
    for i, t, _, _ in documents:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, t or "")))
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.9 * len(held)


def test_source_mix(spark, folder, documents):
    got = rows(spark, folder, "op6_")
    again = rows(spark, folder, "op6_")
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes = [(i, len(brute.words(t)), s) for i, t, s, _ in documents]
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, n) for i, n, _ in sizes)
    totals = Counter()
    for _, n, s in sizes:
        totals[s] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, open_ = {}, sum(totals.values()), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * totals[s]}
        target |= {s: 3 * totals[s] if s in over else weight[s] * unit for s in (over or open_)}
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    of = {i: s for i, _, s in sizes}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == totals[of[r.doc_id]]
        assert math.isclose(r.target, target[of[r.doc_id]], rel_tol=1e-9)
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_subspace_join(spark, folder):
    import numpy as np

    data = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    good = [(i, label, np.array(v)) for i, label, v in data
            if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, la, u) in enumerate(good) for b, lb, v in good[k + 1:]
             if la == lb and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93]
    degree = Counter(x for pair in links for x in pair)
    found = brute.classes([i for i, _, _ in data], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows(spark, folder, "op7_")}
    assert got == {i: (degree[i], found[i], found[i] == i) for i, _, _ in data}
    assert len(links) > 50


def test_class_model(spark, folder, documents):
    got = sorted(rows(spark, folder, "op8_"), key=lambda r: (r.doc_id, r.n_tokens))
    want = sorted(brute.base_scores([(i, t) for i, t, _, _ in documents], 7))
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:4] for w in want]
    assert all(math.isclose(r.base_score, w[4], rel_tol=1e-9) for r, w in zip(got, want))
    held = [r for r in got if r.held_out and r.doc_id < 60]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution():
    """Transitions and emissions sum to one over all classes, known words and one unseen word."""
    import numpy as np

    from embertide.llm import lm

    n = np.array([5, 3, 2], float)
    classes = np.array([0, 1, 1])
    total = np.bincount(classes, weights=n, minlength=2)
    follows = np.array([[1, 2, 0, 1], [3, 0, 1, 0], [0, 0, 0, 1], [2, 1, 0, 0]], float)
    frequency = (follows.sum(axis=0) + 1) / (follows.sum() + 4)
    steps = (follows + lm.SMOOTHING * frequency) / (follows.sum(axis=1, keepdims=True) + lm.SMOOTHING)
    assert np.allclose(steps.sum(axis=1), 1)
    assert np.allclose(np.bincount(classes, weights=n / total[classes]), 1)


def test_token_files(spark, folder, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    import numpy as np

    for i, text, _, _ in sorted(documents, key=lambda d: d[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, folder, "op9_")) == want


def test_minimax_shards(spark, folder, documents):
    got = rows(spark, folder, "op10_")
    facts = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), t) for i, t, _, _ in documents}
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _, _ in documents)
    shard_of, slots, load = {}, defaultdict(list), Counter()
    for r in got:
        size, crc, text = facts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size, crc, "bytes", None)
        assert shard_of.setdefault(text, r.shard) == r.shard and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
        load[r.shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    from embertide.llm.sharding import least_capacity
    import numpy as np

    group = Counter()
    for i, t, _, _ in documents:
        group[t] += facts[i][0]
    order = sorted(group, key=lambda t: int(hashlib.md5(("null" if t is None else "t" + t).encode()).hexdigest()[:15], 16))
    assert max(load.values()) == least_capacity(np.array([group[t] for t in order]), 24)


def test_spelling_variants(spark, folder, documents):
    want = brute.spelling_variants([(i, t) for i, t, _, _ in documents])
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows(spark, folder, "op11_")), key=str)
    assert got == sorted(want, key=str)
    assert any(w[1] for w in want) and any(w[4] > 1 for w in want)


def test_bpe_round_trip(spark, folder, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, text, _, _ in documents:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, folder, "op12_")]
    assert sorted(got) == sorted(want)


def test_hilbert_centroids(spark, tmp_path):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    data = [(k, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for k in range(900)]
    data += [(1000 + k, data[0][1]) for k in range(300)] + [(5, data[5][1]), (5, data[5][1]), (None, data[7][1])]
    odd = [None, [], [1.0] * 63, [float("nan")] + [0.0] * 63, [None] + [0.0] * 63, [float("inf")] * 64]
    table = data + [(2000 + k, v) for k, v in enumerate(odd)]
    schema = "vec_id long, embedding array<double>, label int, id long, x string"
    for name, rows_ in (("plain", table), ("large", table[:40] + [(3000, [1e9] * 64), (3001, [-1e300] * 64), (3002, [2.0 ** 60] * 64)])):
        spark.createDataFrame([(i, v, 0, 7, "y") for i, v in rows_], schema).repartition(4).write.parquet(
            f"{tmp_path}/{name}/embeddings.parquet")
        want = brute.clusters([(i, v) for i, v in rows_])
        got = [tuple(r) for r in rows(spark, f"{tmp_path}/{name}", "op13_")]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, folder, tmp_path, name):
    for table in ("documents", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    got = QUERIES[name][0](spark, str(tmp_path))
    assert got.count() == 0
    assert got.columns == QUERIES[name][0](spark, folder).columns
