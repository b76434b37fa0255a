"""The models of words after words, against plain counting."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortide.llm import toxicity
from cohortide.llm.words import Texts
from test_llm import ALNUM, lower


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(240):
        own = rng.choices(words, k=rng.randint(1, 40))
        if i % 6 == 0:
            own[1:1] = ["You", "awful", "w3"]
        rows.append((" ".join(own), int(i % 6 == 0)))
    return rows + [(None, 1), ("", 0), ("one", 0)]


def brute(rows, everything):
    """log P(w | v, toxic) - log P(w | v, ordinary) for any v, w."""
    pairs, df = [defaultdict(int), defaultdict(int)], defaultdict(int)
    for text, label in rows:
        w = ALNUM.findall(lower(text))
        for p in set(zip(w, w[1:])):
            pairs[label][p] += 1
    for text in everything:
        for w in set(ALNUM.findall(lower(text))):
            df[w] += 1
    total = sum(df.values())
    mass = [sum(p.values()) for p in pairs]

    def log_p(label, v, w):
        cut = toxicity.PAIR_DISCOUNT * mass[label] / min(mass)
        own = {x: n for (b, x), n in pairs[label].items() if b == v}
        n = sum(own.values())
        if not n:
            return math.log(df[w] / total) if w in df else 0.0
        left = sum(min(c, cut) for c in own.values()) / n
        p = max(own.get(w, 0) - cut, 0) / n + left * (df[w] / total if w in df else 1.0)
        return math.log(p)

    return lambda v, w: log_p(1, v, w) - log_p(0, v, w)


def test_pair_ratios_equal_plain_counting(spark):
    rows = corpus()
    unlabelled = [" ".join(f"w{i % 31}" for i in range(k, k + 9)) for k in range(50)]
    docs = spark.createDataFrame(rows, "text string, label int").repartition(3)
    every = docs.unionByName(spark.createDataFrame([(t, None) for t in unlabelled], "text string, label int"))
    model = toxicity.pair_model(toxicity.count_pairs(docs), toxicity.count_words(every))
    assert len(model[0]) > 50 and len(model[2]) > 10
    want = brute(rows, [t for t, _ in rows] + unlabelled)
    texts = ["you awful w3 w5 w2", "W7 w3", "w30 new words here w1", None, "one"] + [t for t, _ in rows[:40]]
    got = toxicity.pair_ratios(Texts(pa.array(texts), toxicity.ALNUM, lower=True), model)
    expected = []
    for t in texts:
        w = ALNUM.findall(lower(t))
        expected += ([0.0] if w else []) + [want(a, b) for a, b in zip(w, w[1:])]
    assert got == pytest.approx(expected, abs=1e-9)
    assert got[1] > 0.5  # "you awful"


def test_measures_equal_loops():
    rng = np.random.default_rng(2)
    texts = Texts(pa.array(["a b c d e", "", "x", None, "q " * 30]), toxicity.ALNUM, lower=True)
    ratios = rng.normal(size=(2, len(texts.starts)))
    got = toxicity.measured(texts, ratios, (1, 4))
    for t in range(len(texts)):
        for k in range(2):
            own = ratios[k, texts.first[t]:texts.first[t + 1]]
            if not len(own):
                assert not got[t, k].any()
                continue
            best = [max(own[i:i + w].sum() / min(len(own), w) for i in range(len(own))) for w in (1, 4)]
            assert got[t, k] == pytest.approx([own.mean(), *best])


def test_scores_equal_the_models(spark):
    """Every step after the counts, by hand: measures, calibration on a fifth, logistic score."""
    rows = [(i, t, label) for i, (t, label) in enumerate(corpus() * 3)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    toxic = [got[i].score for i, _, y in rows if y and rows[i][1]]
    clean = [got[i].score for i, _, y in rows if not y]
    assert min(toxic) > max(clean)


def test_no_pairs(spark):
    docs = spark.createDataFrame([("one", 0), ("two", 1)], "text string, label int")
    model = toxicity.pair_model(toxicity.count_pairs(docs), toxicity.count_words(docs))
    assert [len(x) for x in model] == [0] * 4
    assert not toxicity.pair_ratios(Texts(pa.array(["one two"]), toxicity.ALNUM, lower=True), model).any()
