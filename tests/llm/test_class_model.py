"""The exchange of the class model: contexts are the classes of the neighbours, and every repeated word has a class."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertide.llm import lm
from embertide.llm.common import Stage

CLASSES, WORDS = 4, 9


def test_gains_are_those_of_the_criterion():
    """A move's gain equals the difference of the criterion, counted anew from the texts."""
    rng = np.random.default_rng(3)
    full = CLASSES + 2
    texts = [rng.integers(-1, WORDS, rng.integers(0, 30)) for _ in range(40)] + [np.array([2, 2, 2, 5, 5])]
    own = rng.integers(0, CLASSES, WORDS)

    def framed(text, kinds):
        return [CLASSES + 1, *[kinds[w] if w >= 0 else CLASSES for w in text], CLASSES + 1]

    def follows(kinds):
        out = np.zeros((full, full))
        for text in texts:
            k = framed(text, kinds)
            np.add.at(out, (k[:-1], k[1:]), 1)
        return out

    cells = Counter()
    for text in texts:
        k = framed(text, own)
        for i, w in enumerate(text):
            if w >= 0:
                cells[w, k[i]] += 1
                cells[w, full + k[i + 2]] += 1
                if i and text[i - 1] == w:
                    cells[w, 2 * full] += 1
    local, context = np.array(sorted(cells)).T
    n = np.array([cells[c] for c in sorted(cells)], float)
    got = lm.move_gains(own, local, context, n, follows(own))
    for w in range(WORDS):
        for kind in range(CLASSES):
            kinds = own.copy()
            kinds[w] = kind
            assert got[w, kind] == pytest.approx(lm.information(follows(kinds)) - lm.information(follows(own)), abs=1e-8)


def alternating():
    """Words p and q in turn, none of them among the 40 most frequent words, which stand apart from them."""
    rng = random.Random(8)
    common = [" ".join(f"common{rng.randrange(40)}" for _ in range(40)) for _ in range(100)]
    turns = [" ".join(f"{'pq'[i % 2]}{rng.randrange(60)}" for i in range(rng.choice([20, 21]))) for _ in range(120)]
    return common + turns


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(alternating())), "doc_id long, text string").repartition(3)


def test_words_are_told_apart_by_content_words(spark, corpus):
    """Words that differ only in which rarer words stand beside them are in different classes."""
    model, _ = lm.train(corpus, F.lit(True), Stage(spark), n_classes=8)
    words = Counter(w for text in alternating() for w in text.split())
    hashes = {int(h): k for k, h in enumerate(model.words)}
    side = {"p": Counter(), "q": Counter()}
    for word in words:
        if word[0] in side:
            side[word[0]][int(model.classes[hashes[hash_of(word)]])] += 1
    # with few classes one start may end in a local optimum that parts the common words instead
    assert not side["p"].keys() & side["q"].keys(), side


def hash_of(word):
    from embertide.llm.common import word_hashes

    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


@pytest.mark.parametrize("head_words", [0, 30])
def test_words_beyond_the_broadcast_have_classes(spark, corpus, head_words):
    """Where the line between broadcast and joined words falls changes no class and no score."""
    held = F.col("doc_id") % 5 != 0
    whole, fewer = ({r.doc_id: r for r in lm.class_scores(corpus, held, **settings).collect()}
                    for settings in ({}, {"head_words": head_words}))
    assert whole.keys() == fewer.keys()
    for k, r in whole.items():
        assert fewer[k].n_known == r.n_known
        assert fewer[k].score == pytest.approx(r.score, rel=1e-9)
        assert fewer[k].base_score == pytest.approx(r.base_score, rel=1e-9)


@pytest.mark.parametrize("reach", [{"head_words": 0, "class_words": 0}, {"head_words": 5, "class_words": 30}, {"head_words": 0}])
def test_reach_of_broadcasts_and_blocks_changes_nothing(spark, corpus, monkeypatch, reach):
    """Nor do small blocks, words spread over several of them, or words sent in small parts."""
    held = F.col("doc_id") % 5 != 0
    whole = {r.doc_id: r for r in lm.class_scores(corpus, held).collect()}
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "HOT_COUNT", 80)
    monkeypatch.setattr(lm, "HELD", 500)
    fewer = {r.doc_id: r for r in lm.class_scores(corpus, held, **reach).collect()}
    assert whole.keys() == fewer.keys()
    for k, r in whole.items():
        assert (fewer[k].n_known, fewer[k].n_tokens) == (r.n_known, r.n_tokens)
        assert fewer[k].score == pytest.approx(r.score, rel=1e-9)
        assert fewer[k].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_block_transitions_are_those_of_the_texts(spark, corpus):
    seen = []
    before = lm.information
    try:
        lm.information = lambda follows: seen.append(follows) or before(follows)
        model, _ = lm.train(corpus, F.lit(True), Stage(spark), n_classes=8)
    finally:
        lm.information = before
    kinds = {int(h): int(c) for h, c in zip(model.words, model.classes)}
    want = np.zeros((10, 10))
    for text in alternating():
        path = [9, *[kinds.get(hash_of(w), 8) for w in text.split()], 9]
        np.add.at(want, (path[:-1], path[1:]), 1)
    assert any((want == follows).all() for follows in seen[1:])
    assert all(follows.sum() == want.sum() for follows in seen)


def test_rounds_move_no_texts(spark, corpus, monkeypatch):
    """Words outside the broadcast head are looked up once, not by a join of the texts in each round."""
    moved, put = [], Stage.put

    def spy(self, df, name, *by, **settings):
        if name.split("-")[0] in ("kinds", "moves", "read", "tail") and name[-1].isdigit():
            moved.append((name, "Exchange" in df._jdf.queryExecution().executedPlan().toString()))
        return put(self, df, name, *by, **settings)

    monkeypatch.setattr(Stage, "put", spy)
    lm.class_scores(corpus, F.lit(True), head_words=10).count()
    assert moved and not any(x for _, x in moved), moved
