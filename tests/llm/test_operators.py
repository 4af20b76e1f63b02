"""The operators' own interfaces: parts that the queries do not show."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from embertide.llm import decontaminate, langid, mixing, ngram_join, sharding, suffixes, tokens, vector_join, warc
from embertide.llm.common import text_buffer, word_hashes
from embertide.llm.graph import components
from embertide.llm.common import Stage


def test_sketch_distance_never_exceeds_the_set_difference():
    rng = random.Random(1)
    for size in (3, 40, 700):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
        other = [w if rng.random() > 0.1 else "x" + w for w in base] + ["end"]
        column = pa.array([" ".join(base), " ".join(other)])
        value, row = ngram_join.shingles(*text_buffer(column), 3)
        a, b = set(value[row == 0].tolist()), set(value[row == 1].tolist())
        sketches = ngram_join.sketches(value, row, np.bincount(row, minlength=2))
        assert ngram_join.sketch_distance(*sketches) <= len(a ^ b)


def test_linked_sets_share_a_block():
    rng = random.Random(2)
    for size in (12, 60, 333, 2000):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
        other = list(base)
        for _ in range(max(1, size // 80)):
            other[rng.randrange(size)] = "changed"
        value, row = ngram_join.shingles(*text_buffer(pa.array([" ".join(base), " ".join(other)])), 3)
        sizes = np.bincount(row, minlength=2)
        a, b = (set(value[row == k].tolist()) for k in (0, 1))
        if 100 * len(a & b) >= 90 * len(a | b):
            keys, bounds = ngram_join.block_keys(value, row, sizes, 90)
            assert set(keys[:bounds[1]].tolist()) & set(keys[bounds[1]:].tolist())


@pytest.mark.parametrize("share", [60, 80, 90])
def test_links_between_sets_of_unlike_size_share_a_block(share):
    """Sets grow or shrink up to the threshold, across bands; every pair that links meets."""
    rng = np.random.default_rng(share)
    linked = 0
    for _ in range(600):
        a = set(rng.integers(0, 1 << 63, int(rng.integers(1, 150))).tolist())
        b = {x for x in a if rng.random() > 0.1}
        b |= set(rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 6 + 1))).tolist())
        if a == b or 100 * len(a & b) < share * len(a | b):
            continue
        linked += 1
        value = np.array(sorted(a) + sorted(b), np.uint64)
        row = np.repeat([0, 1], [len(a), len(b)])
        keys, bounds = ngram_join.block_keys(value, row, np.array([len(a), len(b)]), share)
        assert set(keys[:bounds[1]].tolist()) & set(keys[bounds[1]:].tolist())
    assert linked > 30


def test_words_hash_alike_wherever_they_stand():
    one, _ = word_hashes(*text_buffer(pa.array(["Hello there", None, "", "\tthere\nHELLO  x"])))
    assert one[0] == one[3] and one[1] == one[2] and len(set(one.tolist())) == 3


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Stage(spark)).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(200)}}


def test_overlapping_sources_share_what_both_hold():
    given = mixing.routed({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 60})
    assert sum(n for (p, s), n in given.items() if s == "a") == 150
    assert sum(n for (p, s), n in given.items() if s == "b") == 60
    used = {p: sum(n for (q, _), n in given.items() if q == p) for p, _ in given}
    assert all(used[p] <= {("a",): 100, ("a", "b"): 100, ("b",): 10}[p] for p in used)  # nothing needs repeating


def test_repeats_are_a_last_resort():
    given = mixing.routed({("a",): 100, ("a", "b"): 10}, {"a": 250, "b": 10})
    assert given[("a",), "a"] + given[("a", "b"), "a"] == 250 and given[("a", "b"), "b"] == 10


def test_mix_of_arrays_of_sources(spark):
    rows = [(k, "w " * (k % 7 + 1), [["a"], ["a", "b"], None, []][k % 4]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix_sources(docs, {"a": 1, "b": 1}).collect()
    assert len(got) == 200 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert all(r.taken == 0 for r in got if not r.pattern)


def test_edits_are_found_within_the_budget_only():
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefgh ") for _ in range(200))
    index = decontaminate.build_index([(1, decontaminate.characters(*decontaminate.lowered(pa.array([item])))[0])])

    def found(text):
        code, bounds, place = decontaminate.characters(*decontaminate.lowered(pa.array([text])))
        return decontaminate.aligned(index, code, bounds, place, decontaminate.candidate_regions(index, code, bounds))

    noise = "".join(rng.choice("ijklmnop ") for _ in range(300))
    changed = list(item)
    for k in range(5, 200, 20):
        changed[k] = "z"
    gone = "".join(c for k, c in enumerate(item) if k % 40)
    for text in (item, "".join(changed), gone):
        assert found(noise + text + noise)
    for k in range(2, 200, 6):
        changed[k] = "y"
    assert not found(noise + "".join(changed) + noise) and not found(noise)


def test_mixtures_of_two_languages():
    rng = random.Random(4)
    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dos", "tres", "cuatro"], "zz": ["ein", "zwei", "drei"]}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    counts = np.full((1 << langid.BUCKET_BITS, 3), langid.ALPHA)
    for k, lang in enumerate(words):
        bucket, _ = langid.gram_buckets(*text_buffer(pa.array([prose(lang, 2000)])))
        counts[:, k] += np.bincount(bucket, minlength=len(counts))
    model = langid.LanguageModel(list(words), np.log(counts / counts.sum(axis=0)))
    mixed = prose("xx", 150) + " " + prose("yy", 50)
    shares = langid.infer(model, *langid.gram_buckets(*text_buffer(pa.array([prose("zz", 60), mixed, ""]))), 3)
    assert (shares[0] > 0).tolist() == [False, False, True]
    assert (shares[1] > 0).tolist() == [True, True, False] and 0.6 < shares[1][0] < 0.9
    assert not shares[2].any()


def test_mixture_inference_takes_rows_in_small_groups_and_equals_the_plain_steps():
    rng = np.random.default_rng(5)
    languages = ["aa", "bb", "cc", "dd"]
    log_p = np.log(rng.dirichlet(np.full(1 << langid.BUCKET_BITS, 0.05), 4).T + 1e-9)
    sizes = [3, 1, 0, 40, 700, 9000, *rng.integers(1, 2500, 600).tolist()]
    row = np.repeat(np.arange(len(sizes)), sizes)
    bucket = rng.integers(0, 1 << langid.BUCKET_BITS, len(row)).astype(np.uint32)
    for k in range(4, len(sizes)):  # rows of one language, and of two
        own = np.flatnonzero(row == k)
        for lang, part in ((k % 4, own), ((k + 1) % 4, own[:len(own) * (k % 3) // 4])):
            bucket[part] = rng.choice(1 << langid.BUCKET_BITS, len(part), p=np.exp(log_p[:, lang]) / np.exp(log_p[:, lang]).sum())
    model = langid.LanguageModel(languages, log_p)
    tracemalloc.start()
    found = langid.infer(model, bucket, row, len(sizes))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(row)  # bytes an n-gram, whatever the number of languages; whole batches took 4 x 32 at least

    def mixed(p, n, share):
        for _ in range(langid.STEPS):
            share = (p * share * (n / (p @ share))[:, None]).sum(axis=0) / n.sum()
        return share, (n * np.log(p @ share)).sum()

    for k in (0, 1, 2, 3, 4, 5, 30, 31, 32, 33, 200, 500):
        cells, n = np.unique(bucket[row == k], return_counts=True)
        if not len(cells):
            assert not found[k].any()
            continue
        p, cost = np.exp(log_p[cells]), langid.PENALTY * np.log(n.sum() + 1)
        single = n @ log_p[cells]
        want, value = np.eye(4)[single.argmax()], single.max()
        full, bound = mixed(p, n, np.full(4, 0.25))
        order, size = np.argsort(-full, kind="stable"), 1
        while bound > single.max() + cost and size < 4:
            size += 1
            share = np.zeros(4)
            share[order[:size]] = 1 / size
            share, more = mixed(p, n, share)
            if more - cost <= value:
                break
            want, value = share, more - cost
        assert np.abs(found[k] - want).max() < 1e-9


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_by_declared_lengths(version):
    name = "a-0"
    payload = b"x\n\nhttp://y 1.1.1.1 20200101000000 text/html 3\nabc"
    data = warc.arc_head(version, name) + warc.arc_record(version, "http://a b", 7, payload, "d") + b"\n" + \
        warc.arc_record(version, None, 8, b"", "d")
    head, one, two = list(warc.parse_arc(data))
    assert head.fields["URL"] == f"filedesc://{name}"
    assert warc.http_parts(one.block)[2] == payload and one.fields["URL"] == "http://a%20b"
    assert ("Result-code" in one.fields) == (version == 2)
    assert warc.http_parts(two.block)[2] == b"" and two.fields["URL"] == "urn:page:8"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-10]))


def test_arc_dates():
    assert warc.warc_date("20240229123456") == "2024-02-29T12:34:56Z"
    assert warc.warc_date("2024") == "2024-01-01T00:00:00Z" and warc.warc_date("bad")[:4] == "2000"


def test_code_lengths_are_limited_and_complete():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610])
    for longest in (4, 5, 16):
        lengths = tokens.code_lengths(counts, longest)
        used = lengths[counts > 0].astype(int)
        assert used.max() <= longest and (2.0 ** -used).sum() == 1.0 and lengths[0] == 0
    free = tokens.code_lengths(counts, 16).astype(int)
    assert (free * counts).sum() <= (tokens.code_lengths(counts, 5).astype(int) * counts).sum()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_packed_ids_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_999).astype(np.uint32)
    lengths = tokens.code_lengths(np.bincount(ids, minlength=50_000))
    code = lengths, tokens.canonical(lengths)
    bits, offsets, total = tokens.pack(ids, *code)
    assert (tokens.unpack(bits, offsets, n, tokens.decode_table(lengths)) == ids).all()


def test_one_piece_spans_go_to_the_model_and_give_the_librarys_ids():
    from tokenizers import Tokenizer

    from embertide.llm.queries import tokenizer_path

    rng = random.Random(6)
    signs = list("aZ 09.,!'é×÷\n\t ßñ漢sªµ½²") + ["<|endoftext|>"]
    found = sorted({"".join(rng.choice(signs) for _ in range(rng.randint(1, 6))).encode() for _ in range(4000)})
    found += [w.encode() for w in (" the", "abc", " 2024", "!!", "été", "漢字", "don't", "'s", " ", "\n", "  a")]
    library = Tokenizer.from_file(tokenizer_path())
    want = [e.ids for e in library.encode_batch_fast([s.decode() for s in found], add_special_tokens=False)]
    handed = []

    class Counting:  # notes the texts that the whole tokenizer is asked for
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **rest):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **rest)

    for text in (found, [s for s in found if b"<|endoftext|>" not in s]):
        ids, counts = tokens.SpanTokenizer(Counting())(text)
        wanted = [w for s, w in zip(found, want) if s in set(text)]
        assert ids.tolist() == [i for w in wanted for i in w] and counts.tolist() == [len(w) for w in wanted]
    handed.clear()
    tokens.SpanTokenizer(Counting())([b" the", b"abc", b" 2024", b"!!", "été".encode(), b"  "])
    assert "".join(handed).startswith("  ") and "abc" not in "".join(handed)


@pytest.mark.parametrize("distance", [1, 7, 256, 1000])
def test_packing_in_blocks_gives_the_bits_of_one_code_after_the_other(distance):
    rng = np.random.default_rng(distance)
    ids = np.minimum(rng.geometric(0.003, 2 * tokens.PACKED + 1001), 4999).astype(np.uint32)
    lengths = tokens.code_lengths(np.bincount(ids, minlength=5000))
    codes = tokens.canonical(lengths)
    tracemalloc.start()
    bits, offsets, total = tokens.pack(ids, lengths, codes, distance)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    text = "".join(format(int(codes[i]), f"0{lengths[i]}b") for i in ids.tolist())
    assert total == len(text) and np.unpackbits(bits)[:total].tolist() == [int(c) for c in text]
    assert not np.unpackbits(bits)[total:].any() and len(bits) == total // 8 + 5
    assert (offsets == (np.cumsum(lengths[ids].astype(int)) - lengths[ids])[::distance]).all()
    assert peak < 64 * len(ids)


def test_numbers_kept_for_hashing_and_encoding_are_bounded_by_small_pieces():
    from tokenizers import Tokenizer

    from embertide.llm import common
    from embertide.llm.queries import tokenizer_path

    common._POWERS.clear()
    word_hashes(*text_buffer(pa.array(["a few words"])))
    assert sum(held.nbytes for held in common._POWERS.values()) < 8_000_000  # 64 MB whatever the text
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=900)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(texts)], ["doc_id", "text"])
    library = Tokenizer.from_file(tokenizer_path())
    tracemalloc.start()
    assert sum(len(lengths) for _, lengths, _ in tokens.encoded([batch], library, 2)) == 800
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000


def test_minimax_is_the_least_capacity():
    rng = np.random.default_rng(1)
    for _ in range(20):
        weights = rng.integers(1, 50, rng.integers(1, 12))
        shards = int(rng.integers(1, 6))
        best = sharding.least_capacity(weights, shards)
        prefix = np.cumsum(weights)
        assert sharding.greedy_cuts(prefix, shards, best) is not None
        assert best == weights.max() or sharding.greedy_cuts(prefix, shards, best - 1) is None


def test_names_order_the_sampled_suffixes(spark):
    """Ranks after each sort order suffixes as their bytes do."""
    rng = random.Random(6)
    body = "".join(rng.choice("ab") for _ in range(700)).encode()
    regions = spark.createDataFrame([(b"k" * 16, body, 1), (b"l" * 16, body[100:500], 1)], "key binary, body binary, n long")
    stage = Stage(spark)
    chunks = stage.put(suffixes.packed(regions), "c")
    cuts = suffixes.splitters(chunks, 3)
    for level, span in enumerate(suffixes.SPANS):
        chunks = suffixes.sorted_names(chunks, level, cuts, stage)
        found = []
        for row in chunks.collect():
            data, sizes, names = suffixes.chunk_arrays(row.asDict(), level + 1)
            for at in suffixes.sampled_places(sizes, span).tolist():
                found.append((data[at:at + span].tobytes(), int(names[at])))
        found.sort()
        assert all((a[0] < b[0]) == (a[1] < b[1]) for a, b in zip(found, found[1:]))


def test_blocks_share_the_whole_budget():
    for dim in (1, 3, 16, 64):
        assert abs(sum(vector_join.budgets(dim, 0.93)) - 0.14) < 1e-6
        q = vector_join.rotation(dim)
        assert np.allclose(q @ q.T, np.eye(dim))


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1, "x"), (5, "a b c d e f", 2, None), (6, "a b c d e f", 3, "x"), (7, None, 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, component_id string")
    got = ngram_join.jaccard_components(docs, 3, 90).collect()
    assert sorted((str(r.doc_id), r.component_id, r.n_shingles) for r in got) == [
        ("5", 5, 4), ("6", 5, 4), ("7", 7, 0), ("None", None, 4)]
    assert suffixes.repeated_bytes(docs).where(F.col("n_removed") > 0).count() == 0
    assert sharding.minimax_shards(docs, 2).count() == 4
    assert mixing.mix_sources(docs.withColumn("source", F.lit(None).cast("string"))).count() == 4


def test_every_excerpt_of_a_window_is_found():
    """Stretches of 80 characters of an item at any offset, with up to six edits: recall 1 against every window."""
    import random

    import pyarrow as pa

    import brute
    from embertide.llm import decontaminate as dc

    rng = random.Random(8)
    words = ["".join(rng.choice("aeioumnrstl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chars = lambda t: dc.characters(*dc.lowered(pa.array([t], pa.string())))
    items = [prose(45) for _ in range(15)]
    index = dc.build_index([(k, chars(t)[0]) for k, t in enumerate(items)])
    for edits in (0, 0, 2, 4, 6):
        for _ in range(25):
            k = rng.randrange(len(items))
            o = rng.randrange(len(items[k]) - 80)
            part = list(items[k][o:o + 80])
            for _ in range(edits):
                part[rng.randrange(len(part))] = rng.choice(["x", "", "qz"])
            text = prose(20) + " " + "".join(part) + " " + prose(20)
            code, bounds, place = chars(text)
            found = {f[1] for f in dc.aligned(index, code, bounds, place, dc.candidate_regions(index, code, bounds))}
            windows = range(max(0, o - 4), min(o + 5, len(items[k]) - 79))
            assert k in found or min(brute.edits_within(items[k][s:s + 80], text) for s in windows) > dc.edit_budget(80)


def test_shared_phrases_are_looked_at_in_slices(monkeypatch):
    """The regions are the same however few hits a slice holds."""
    import pyarrow as pa

    from embertide.llm import decontaminate as dc

    chars = lambda *t: dc.characters(*dc.lowered(pa.array(list(t), pa.string())))
    phrase = "this phrase stands in every item of the set "
    items = [phrase + f"item number {k} ends so " * 3 for k in range(40)]
    index = dc.build_index([(k, chars(t)[0]) for k, t in enumerate(items)])
    code, bounds, _ = chars(phrase * 5, items[7], "none", phrase)
    want = [x.tolist() for x in dc.candidate_regions(index, code, bounds)]
    monkeypatch.setattr(dc, "POSTINGS", 300)
    got = [x.tolist() for x in dc.candidate_regions(index, code, bounds)]
    assert sorted(zip(*got)) == sorted(zip(*want)) and want[0]


def test_what_tasks_receive_needs_no_package():
    """Broadcast values are plain arrays: unpickling them imports nothing of this library."""
    import pickle

    import numpy as np

    from embertide.llm import bpe, decontaminate as dc
    from embertide.llm.queries import tokenizer_path

    index = dc.build_index([(1, np.arange(100, dtype=np.uint32))])
    for value in (dc.index_parts(index), bpe.load_tables(tokenizer_path())):
        assert b"embertide" not in pickle.dumps(value)


def test_bpe_equals_the_library_on_odd_texts():
    """White space, contractions, special tokens, scripts and long runs, split at every kind of border."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from embertide.llm import bpe
    from embertide.llm.common import text_buffer
    from embertide.llm.queries import tokenizer_path
    from embertide.llm.spans import SpanMemory, text_ids

    library = Tokenizer.from_file(tokenizer_path())
    encoder = bpe.Encoder(bpe.load_tables(tokenizer_path()), library.pre_tokenizer)
    rng = random.Random(2)
    signs = "abeEIst'  \n\n\t.,!#12\u00e9\u00df\u00d7\u4e2d\u0301\u00a0\u2003\U0001f600\u00aa\u0558\u0430" + "'s're"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "  <|endoftext|>  \n x", "<|endo", "ftext|> x", "x" * 3000,
              "ab" * 2000, " " * 2000]
    for slots in (1 << 16, 1 << 4):  # the second memory forgets nearly everything
        ids, counts = text_ids(*text_buffer(pa.array(texts)), SpanMemory(encoder, slots), b"<|endoftext|>")
        ends = counts.cumsum()
        for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[ends[k] - counts[k]:ends[k]].tolist() == e.ids, texts[k]


def test_near_words_against_comparing_all():
    import random

    import numpy as np

    from embertide.llm.fm_index import Index, near_words

    rng = random.Random(1)
    for trial in range(12):
        alphabet = "ab" if trial % 3 == 0 else "abcde"
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9 if trial % 2 else 25)))
                        for _ in range(200)})
        symbols = [np.frombuffer(w.encode(), np.uint8) - 96 for w in words]
        every = np.arange(len(words))
        got = {(words[a], words[b]) for a, b in near_words(Index(symbols), symbols, every, every).tolist()}
        want = {(w, v) for w in words for v in words
                if len(w) == len(v) and sum(x != y for x, y in zip(w, v)) == 1
                or len(w) == len(v) + 1 and any(w[:j] + w[j + 1:] == v for j in range(len(w)))}
        assert got == want


def test_a_half_shared_by_many_words_is_spread(spark, monkeypatch):
    """One beginning in all words, parts of a few symbols: the same neighbours."""
    import itertools

    from embertide.llm import spelling
    from embertide.llm.common import Stage

    words = ["shared" + "".join(p) for p in itertools.product("abc", repeat=4)] + ["sharedabcde", "harredabca"]
    monkeypatch.setattr(spelling, "PART_SYMBOLS", 200)
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(table, Stage(spark)).collect()}

    def one(w, v):
        if abs(len(w) - len(v)) == 1:
            w, v = max(w, v, key=len), min(w, v, key=len)
            return any(w[:j] + w[j + 1:] == v for j in range(len(w)))
        return len(w) == len(v) and sum(x != y for x, y in zip(w, v)) == 1

    assert got == {(w, v) for w in words for v in words if w != v and one(w, v)}


def test_pairs_that_share_many_buckets_are_made_a_few_times(spark):
    """Every pair that meets anywhere is there; near copies that meet everywhere come about once."""
    rng = random.Random(6)
    held = {i: set(range(-30, 30)) for i in range(300)}  # in all buckets, more than a chunk holds
    held |= {i: set(rng.sample(range(-30, 30), rng.randint(1, 12))) for i in range(300, 340)}
    members = spark.createDataFrame(
        [(b, i, i // 2) for i, own in held.items() for b in own], "bucket long, id long, class long")
    profile = spark.createDataFrame([(i, 40, bytes(16)) for i in held], "doc_id long, n long, sketch binary")
    made = [tuple(r) for r in ngram_join.met_pairs(members, profile, Stage(spark), 90).collect()]
    want = {(a, b) for a in held for b in held if a < b and a // 2 != b // 2 and held[a] & held[b]}
    assert set(made) == want
    near = [p for p in made if p[1] < 300]
    assert len(near) == len(set(near)) and len(made) <= 2 * len(want)


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """The shuffles of a step are gone when its table is written, not some steps later."""
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(k).getName() for k in range(files.size()))
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = held()
    out = Stage(spark).put(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert held() <= before and out.count() == 7


def test_rows_are_ordered_by_further_keys_only_where_they_tie():
    from embertide.llm.suffixes import distinct_rows

    order, number = distinct_rows([np.array([7, 3, 5], np.uint64), None, None])
    assert (order.tolist(), number.tolist()) == ([1, 2, 0], [0, 1, 2])
    rng = np.random.default_rng(11)
    for n, values in ((0, 1), (1, 1), (500, 1), (500, 3), (500, 30), (500, 2 ** 63)):
        keys = [rng.integers(0, values, n).astype(np.uint64) << np.uint64(values < 2 ** 60) for _ in range(3)]
        rows = list(zip(*(k.tolist() for k in keys)))
        order, number = distinct_rows(keys)
        place = {row: i for i, row in enumerate(sorted(set(rows)))}
        assert sorted(order.tolist()) == list(range(n))
        assert number.tolist() == [place[rows[i]] for i in order.tolist()] == sorted(number.tolist())


def test_words_at_are_eight_bytes_in_byte_order():
    from embertide.llm.suffixes import words_at

    for data in (b"", b"a", b"seven b", b"\xff" * 8, bytes(range(256))):
        want = [int.from_bytes(data[i:i + 8].ljust(8, b"\0"), "big") for i in range(len(data))]
        assert words_at(np.frombuffer(data, np.uint8)).tolist() == want


@pytest.mark.parametrize("step", [3, 7, 1 << 15])
def test_sliding_extremes_are_those_of_each_window(step):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 6, 7, 8, 50):
        values = rng.integers(0, 40, n).astype(np.uint64)
        for width in (1, 2, 3, 7, 8, 60):
            least = suffixes.sliding(values, width, np.minimum, np.uint64(99), step)
            most = suffixes.sliding(values, width, np.maximum, np.uint64(0), step)
            windows = [values[i:i + width].tolist() for i in range(n)]
            assert least.tolist() == [min(w) for w in windows] and most.tolist() == [max(w) for w in windows]


def test_regions_that_share_text_lie_side_by_side(spark):
    """One passage with other edges each time, far apart in the input: the copies come in succession, equal ones as one row."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [text(900) for _ in range(6)]
    bodies = [(k, passages[k][rng.randrange(60):-1 - rng.randrange(60)].encode()) for _ in range(10) for k in range(6)]
    least = {b: int(suffixes.gram_hashes(np.frombuffer(b, np.uint8), np.array([0, len(b)])).min()) for _, b in bodies}
    bodies += bodies[:7]
    rows = [(hashlib.blake2b(b, digest_size=16).digest(), least[b], b) for _, b in bodies]
    regions = spark.createDataFrame(rows, "key binary, least long, body binary").repartition(5)
    got = [(bytes(r.body), r.n) for r in suffixes.gathered(regions).collect()]
    order = [least[b] for b, _ in got]
    assert order == sorted(order)
    times = Counter(b for _, b in bodies)
    assert Counter({b: sum(n for c, n in got if c == b) for b in times}) == times
    chunks = [row for row in suffixes.packed(suffixes.gathered(regions)).collect()]
    held = [(row.keys[16 * i:16 * i + 16], n) for row in chunks for i, n in enumerate(np.frombuffer(row["counts"], "<i8").tolist())]
    assert sorted(held) == sorted((hashlib.blake2b(b, digest_size=16).digest(), n) for b, n in times.items())


def test_a_chunk_orders_its_triples_once(spark):
    """What a sort returns holds the chunk's own order, by number, beside the names; further sorts compare numbers."""
    rng = random.Random(9)
    body = "".join(rng.choice("ab") for _ in range(600)).encode()
    regions = spark.createDataFrame([(b"k" * 16, body, 1), (b"l" * 16, body[50:450], 1)], "key binary, body binary, n long")
    stage = Stage(spark)
    chunks = stage.put(suffixes.packed(regions), "c")
    cuts = suffixes.splitters(chunks, 3)
    named = chunks
    for level, span in enumerate(suffixes.SPANS):
        named = suffixes.sorted_names(named, level, cuts, stage, chunks)
        for row in named.collect():
            number, names = suffixes.answered(row)
            data, sizes, _ = suffixes.chunk_arrays(row, 0)
            at = suffixes.sampled_places(sizes, span)
            strings = [data[i:i + span].tobytes() for i in at.tolist()]
            place = {x: i for i, x in enumerate(sorted(set(strings)))}
            assert number.tolist() == [place[x] for x in strings] and len(names) == len(place)
            assert names.tolist() == sorted(set(names.tolist()))


def test_a_plain_sort_orders_as_argsort_does():
    rng = np.random.default_rng(12)
    for n, low, high in ((0, 0, 9), (1, 4, 5), (400, 7, 8), (400, 5, 40), (400, 2 ** 50, 2 ** 60), (400, 0, 2 ** 64 - 1)):
        for kind in (np.uint64, np.int64):
            key = rng.integers(low, min(high, 2 ** 63 - 1) if kind is np.int64 else high, n, dtype=kind)
            order = suffixes.ascending(key)
            assert sorted(order.tolist()) == list(range(n)) and (key[order] == np.sort(key)).all()


@pytest.mark.parametrize("step", [1, 7, 1 << 14])
def test_gram_hashes_do_not_depend_on_their_steps(step):
    raw = np.random.default_rng(3).integers(97, 99, 700).astype(np.uint8)
    raw[400:600] = raw[100:300]
    bounds = np.array([0, 350, 350, 420, 700])
    got = suffixes.gram_hashes(raw, bounds, step)
    inside = [i for a, b in zip(bounds, bounds[1:]) for i in range(a, b - suffixes.GRAM + 1)]
    assert set(np.flatnonzero(got != suffixes.TOP).tolist()) == set(inside)
    seen = {}
    for i in inside:
        assert seen.setdefault(raw[i:i + suffixes.GRAM].tobytes(), int(got[i])) == int(got[i])
    assert len(set(seen.values())) == len(seen)


def test_byte_planes_come_back():
    from embertide.llm.common import loosened, squeezed

    for numbers in (np.zeros(0, np.uint64), np.array([0, 1, 2 ** 64 - 1, 2 ** 33], np.uint64), np.arange(5), np.arange(10)[::2]):
        assert loosened(squeezed(numbers)).tolist() == numbers.tolist()


def test_minimizers_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(300), text(450)]
    rows = [(i, text(rng.randrange(200)) + shared[i % 2] + text(rng.randrange(200))) for i in range(6)]
    rows += [(6, text(900)), (7, rows[0][1]), (8, None), (9, shared[0][:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in suffixes.repeated_bytes(docs).collect())
    assert sum(r[2] for r in want) > 1000
    monkeypatch.setattr(suffixes, "HELD_MINIMIZERS", -1)
    assert sorted(tuple(r) for r in suffixes.repeated_bytes(docs).collect()) == want
