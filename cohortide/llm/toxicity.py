"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts.

Kneser-Ney counts contexts, not occurrences; here those are the documents that a word, or a word after
another, is in. There are two models of each class (toxic, ordinary):

* of words. Each class discounts its counts and gives the discounted mass to one shared backoff, the
  counts over all documents. The discount is of several contexts and in proportion to the class's size,
  so a rare expression has the same backoff in both classes and decides nothing.
* of words after a word. P(w | v) is the class's discounted count of v w over that of v, and the mass
  discounted after v goes to the same shared counts. A pair that neither class keeps anything of has a
  ratio that v alone decides.

A document's log-likelihood ratio by either model is normalised by length, over the whole text and over
its best windows of ``WINDOWS`` words; a logistic calibration turns these into the score. Calibration,
and the choice among ``DISCOUNTS``, use a fifth of the labelled rows, which the class counts leave out.

Counts are exact, by the 64-bit hash of a word, and cover every word of every document: each task
counts its share, and a grouped sum adds the shares to a table that grows with the vocabulary. A
word whose class counts the least discount takes whole has the same ratio as a word without a label,
whatever its shared count. So the model that is broadcast names only the other words (those in more
than one labelled document of a class) and one ratio for the rest, and loses nothing by that. The same
holds for pairs.

Class counts of words come from at most ``SAMPLE`` labelled documents, those of pairs from at most
``PAIR_SAMPLE``; the shared counts from all documents.

Cases: a null or empty text has a ratio of 0. Labels that are null, repeat, or belong to no
document are allowed. Without toxic labels every score is the share of toxic rows. Rows that repeat
get a score each and count each time. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortide.llm.labelled import fit_logistic, held_out, labelled_sample, sigmoid
from cohortide.llm.storage import materialize
from cohortide.llm.words import ALNUM, Texts, U64, job_settings, mix, slices

SAMPLE = 200_000
#: Contexts that the smaller class's counts may be discounted by.
DISCOUNTS = (1.5, 4.0, 12.0, 36.0)
#: The same for pairs of words.
PAIR_DISCOUNT = 1.5
PAIR_SAMPLE = 20_000
WINDOWS = (1, 12)
THRESHOLD = 0.3
#: Labelled documents for the calibration, at most.
CALIBRATION = 20_000
#: A task adds up its counts when it holds so many, and sends them when that leaves more than half.
HELD = 2_000_000


def add_up(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, in order, with the sums of its rows of ``counts``."""
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    new = np.flatnonzero(np.append(True, words[1:] != words[:-1])[:len(words)])
    return words[new], np.add.reduceat(counts, new) if len(new) else counts


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), and the documents it is in: n, labelled ordinary, labelled toxic. ``docs`` has
    text and label."""

    def count(batches):
        words, counts, held = [], [], 0

        def send(words, counts):
            if len(words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), *(pa.array(c) for c in counts.T.copy())],
                    ["word", "n", "ordinary", "toxic"])

        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"), ALNUM, lower=True)
                label = np.array([-1 if x is None else x for x in part.column("label").to_pylist()])
                h, owner = texts.hashes(), texts.owner()
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                once = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[:len(h)]
                h, kind = h[once], label[owner[once]]
                h, own = add_up(h, np.column_stack([np.ones(len(h), np.int64), kind == 0, kind == 1]))
                words.append(h)
                counts.append(own)
                held += len(h)
                if held >= HELD:
                    h, own = add_up(np.concatenate(words), np.concatenate(counts))
                    words, counts, held = [h], [own], len(h)
                    if 2 * held >= HELD:
                        yield from send(h, own)
                        words, counts, held = [], [], 0
        if words:
            yield from send(*add_up(np.concatenate(words), np.concatenate(counts)))

    job_settings(docs.sparkSession)
    sums = docs.mapInArrow(count, "word long, n long, ordinary long, toxic long").groupBy("word").agg(
        *(F.sum(c).alias(c) for c in ("n", "ordinary", "toxic")))
    return materialize(sums, "word-counts")


def word_model(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words in order, and for each of DISCOUNTS their log P(word | toxic) - log P(word | ordinary);
    the last ratio is that of all other words."""
    total, *mass = (n or 0 for n in counts.agg(F.sum("n"), F.sum("ordinary"), F.sum("toxic")).head())
    if not all(mass):
        return np.zeros(0, np.uint64), np.zeros((len(DISCOUNTS), 1), np.float32)
    least = [min(DISCOUNTS) * n / min(mass) for n in mass]
    # Of words in labelled documents, of which there are ``SAMPLE`` at most.
    named = counts.where((F.col("ordinary") > least[0]) | (F.col("toxic") > least[1])).toArrow()
    words = named.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    n, *classes = (named.column(c).to_numpy()[order] for c in ("n", "ordinary", "toxic"))
    shared = n / total
    ratios = np.zeros((len(DISCOUNTS), len(words) + 1))
    for k, discount in enumerate(DISCOUNTS):
        for sign, own, m in zip((-1, 1), classes, mass):
            kept = np.maximum(own - discount * m / min(mass), 0)
            left = 1 - kept.sum() / m
            ratios[k, :-1] += sign * np.log(kept / m + left * shared)
            ratios[k, -1] += sign * np.log(left)
    return words[order], ratios.astype(np.float32)


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9E3779B97F4A7C15) + mix(after))


def next_words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the places that have a word of the same text before them."""
    has = np.ones(len(texts.starts), bool)
    has[texts.first[:-1][texts.counts > 0]] = False
    return texts.hashes(), np.flatnonzero(has)


def count_pairs(docs: DataFrame) -> DataFrame:
    """before, after (hashes of neighbouring words) and the documents they are in by label: ordinary,
    toxic. ``docs`` has text and label, 0 or 1."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"), ALNUM, lower=True)
                label = np.array(part.column("label").to_pylist(), np.int64)
                h, at = next_words(texts)
                owner = texts.owner()[at]
                before, after = h[at - 1], h[at]
                keys = pair_keys(before, after)
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                once = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[:len(keys)]
                place, toxic = order[once], label[owner[once]] == 1
                new = np.flatnonzero(np.append(True, keys[once][1:] != keys[once][:-1])[:once.sum()])
                sums = [np.add.reduceat(c.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
                        for c in (~toxic, toxic)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before[place[new]].view(np.int64)), pa.array(after[place[new]].view(np.int64)),
                     *map(pa.array, sums)], ["before", "after", "ordinary", "toxic"])

    job_settings(docs.sparkSession)
    sums = docs.mapInArrow(count, "before long, after long, ordinary long, toxic long").groupBy(
        "before", "after").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    return materialize(sums, "pair-counts")


def pair_model(pairs: DataFrame, counts: DataFrame) -> tuple[np.ndarray, ...]:
    """Keys of pairs with log P(after | before, toxic) - log P(after | before, ordinary), and words with
    that ratio for all other words after them. What is not named has a ratio of 0."""
    names = ("ordinary", "toxic")
    mass = [n or 0 for n in pairs.agg(*(F.sum(c) for c in names)).head()]
    if not all(mass):
        return (np.zeros(0, np.uint64), np.zeros(0)) * 2
    cut = [PAIR_DISCOUNT * m / min(mass) for m in mass]
    total = counts.agg(F.sum("n")).head()[0]
    after = pairs.groupBy("before").agg(
        *(F.sum(c).alias(f"all_{c}") for c in names),
        *(F.sum(F.least(F.col(c).cast("double"), F.lit(d))).alias(f"off_{c}") for c, d in zip(names, cut)))
    # The mass discounted after a word; a class that has not seen it backs off whole.
    for c in names:
        after = after.withColumn(f"left_{c}", F.when(F.col(f"all_{c}") > 0, F.col(f"off_{c}") / F.col(f"all_{c}"))
                                 .otherwise(1.0))
    kept = [F.greatest(F.col(c) - F.lit(d), F.lit(0.0)) for c, d in zip(names, cut)]
    share = F.col("n") / F.lit(total)
    p = [F.when(F.col(f"all_{c}") > 0, k / F.col(f"all_{c}")).otherwise(0.0) + F.col(f"left_{c}") * share
         for c, k in zip(names, kept)]
    # Both tables are of words in several labelled documents, of which there are ``PAIR_SAMPLE`` at most.
    named = (pairs.where((kept[0] > 0) | (kept[1] > 0)).join(after, "before")
             .join(counts.select(F.col("word").alias("after"), "n"), "after")
             .select("before", "after", F.log(p[1] / p[0]).alias("ratio"))).toArrow()
    rest = after.select("before", F.log(F.col("left_toxic") / F.col("left_ordinary")).alias("ratio")).where(
        "ratio <> 0").toArrow()
    keys = pair_keys(*(named.column(c).to_numpy().view(np.uint64) for c in ("before", "after")))
    words = rest.column("before").to_numpy().view(np.uint64)
    out = []
    for own, table in ((keys, named), (words, rest)):
        order = np.argsort(own)
        out += [own[order], table.column("ratio").to_numpy()[order]]
    return tuple(out)


def looked_up(names: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each asked name is there, and its value."""
    if not len(names):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return names[at] == asked, values[at]


def pair_ratios(texts: Texts, model: tuple) -> np.ndarray:
    """The ratio of each word after the one before it; 0 for a text's first word."""
    keys, ratios, words, rests = model
    h, at = next_words(texts)
    out = np.zeros(len(h))
    found, own = looked_up(keys, ratios, pair_keys(h[at - 1], h[at]))
    seen, rest = looked_up(words, rests, h[at - 1])
    out[at] = np.where(found, own, np.where(seen, rest, 0.0))
    return out


def word_ratios(texts: Texts, words: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The ratio of each word by each table."""
    h = texts.hashes()
    at = np.searchsorted(words, h)
    at[np.append(words, U64(0))[at] != h] = len(words)
    return tables[:, at].astype(float)


def measured(texts: Texts, ratios: np.ndarray, windows=WINDOWS) -> np.ndarray:
    """For each text and row of ``ratios`` the mean ratio of its words, and that of its best windows."""
    out = np.zeros((len(texts), len(ratios), 1 + len(windows)))
    n = texts.counts
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    first, last = texts.first[:-1], texts.first[1:]
    stop = np.repeat(last, n)
    for k, own in enumerate(ratios):
        total = np.append(0, np.cumsum(own))
        out[some, k, 0] = (total[last[some]] - total[first[some]]) / n[some]
        for j, w in enumerate(windows):
            end = np.minimum(np.arange(len(own)) + w, stop)
            # A window cut short by the text's end is divided by its full length, or the text's.
            means = (total[end] - total[:-1]) / np.repeat(np.minimum(n, w), n)
            out[some, k, j + 1] = np.maximum.reduceat(means, first[some])
    return out


def evidence(texts: Texts, words: np.ndarray, tables: np.ndarray, pairs: tuple) -> np.ndarray:
    """For each text and table the measures by the model of words, then those by that of pairs."""
    by_word = measured(texts, word_ratios(texts, words, tables))
    by_pair = measured(texts, pair_ratios(texts, pairs)[None])
    both = np.concatenate([by_word, np.repeat(by_pair, len(tables), axis=1)], axis=2)
    return both.reshape(len(texts), both.shape[1] * both.shape[2])


def with_evidence(docs: DataFrame, words: np.ndarray, tables: np.ndarray, pairs: tuple, column: str) -> DataFrame:
    """``column`` of ``docs``, and the evidence of each text as a list."""
    job_settings(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((words, tables, pairs))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                got = evidence(Texts(part.column("text"), ALNUM, lower=True), *shared.value)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), got.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(column), flat.cast(pa.list_(pa.float64()))], [column, "evidence"])

    kind = docs.schema[column].dataType.simpleString()
    return docs.mapInArrow(run, f"`{column}` {kind}, evidence array<double>")


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray]:
    """The discount (by number) whose evidence explains the labels best, and its weights.

    ``x``: labelled rows by discount by measure."""
    best = None
    for k in range(x.shape[1]):
        w = fit_logistic(x[:, k], y)
        p = np.clip(sigmoid(x[:, k] @ w[:-1] + w[-1]), 1e-6, 1 - 1e-6)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
        if best is None or loss < best[0]:
            best = loss, k, w
    return best[1], best[2]


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                   sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fifth = F.pmod(F.xxhash64(F.lit(11), "sample_id"), F.lit(5)) == 0
    learn = labelled_sample(labels, "toxic", sample).where(~fifth)
    counts = count_words(rows.join(F.broadcast(learn), rows["doc_id"] == learn["sample_id"], "left")
                         .select("text", "label"))
    words, tables = word_model(counts)
    some = labelled_sample(labels, "toxic", 5 * PAIR_SAMPLE // 4).where(~fifth)
    pairs = pair_model(count_pairs(rows.join(F.broadcast(some), rows["doc_id"] == some["sample_id"])
                                   .select("text", "label")), counts)
    few = labelled_sample(labels, "toxic", 5 * CALIBRATION).where(fifth)
    known = with_evidence(rows.join(F.broadcast(few), rows["doc_id"] == few["sample_id"])
                          .select("text", "label"), words, tables, pairs, "label").collect()
    y = np.array([r.label for r in known], float)
    x = np.array([r.evidence for r in known], float).reshape(len(y), len(tables), 2 * (1 + len(WINDOWS)))
    chosen, w = calibrate(x, y)
    total = F.lit(float(w[-1]))
    for k, v in enumerate(w[:-1]):
        total = total + float(v) * F.get("evidence", F.lit(k))
    scores = with_evidence(rows, words, tables[chosen:chosen + 1], pairs, "doc_id").withColumn(
        "x", F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0)))
    scored = scores.withColumn("score", 1 / (1 + F.exp(-F.col("x"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
