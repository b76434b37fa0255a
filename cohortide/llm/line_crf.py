"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

Features of a line are binned measures (case, marks, symbols, bars, repetition, lengths) of the
line itself and of its two neighbours. Forward-backward gives each line's probability of being
good; their mean weighted by line length, calibrated, is the document's score.

The field is fitted on a bounded sample of labelled documents: ``SAMPLE_DOCS`` by hash of the id, and of
those, whole and in that order, as many as make up ``SAMPLE_LINES`` lines (the first in any case). Lines
carry their document's label. Only the binned measures of that sample reach the driver. Scoring is one
pass without a shuffle.

Cases: a null or empty text, or one of blank lines, has no lines and gets the sample's share of
good documents. Labels that are null, repeat, or belong to no document are allowed. No labels: the
score is 0.5 everywhere, and ``keep_good`` keeps every document. Rows that repeat get a score each. Other
columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortide.llm.labelled import fit_logistic, free_name, held_out, labelled_sample, sigmoid
from cohortide.llm.words import job_settings

SAMPLE_DOCS = 6000
SAMPLE_LINES = 300_000
#: Lines that are fitted as one chain. Neighbours' features pass the cuts, only the links between the
#: labels of two lines are left out there.
CHAIN = 64
THRESHOLD = 0.7

_MARKS = re.compile(r"[!?]{2,}")
_SYMBOLS = re.compile(r"[#*$%&<>]+")
_DIGITS = re.compile(r"\d")
#: Upper edges of the bins of each measure.
EDGES = (
    (0.08, 0.2, 0.5),          # capitals per character
    (0.0, 0.05, 0.3),          # runs of marks per word
    (0.0, 0.05, 0.3),          # symbol runs per word
    (0.0, 0.05, 0.2),          # bars per word
    (0.3, 0.6, 0.8, 0.95),     # distinct words per word
    (0.0, 0.05, 0.2),          # words equal to the one before, per word
    (2, 9, 40, 200),           # words
    (3, 5, 8, 14),             # characters per word
    (0.0, 0.05, 0.3),          # digits per character
    (0.5,),                    # ends in a closing mark
    (0.5,),                    # equals an earlier line
)
BINS = 5
MEASURES = len(EDGES)


def measures(line: str, seen: set) -> tuple:
    words = line.split()
    n, size = len(words), len(line)
    again = line in seen
    seen.add(line)
    same = sum(map(str.__eq__, words, words[1:])) if len(set(words)) < 0.95 * n else 0
    # Capitals of all scripts that have case.
    return (sum(map(str.isupper, line)) / size, len(_MARKS.findall(line)) / n,
            len(_SYMBOLS.findall(line)) / n, line.count("|") / n, len(set(words)) / n, same / n, n,
            size / n, len(_DIGITS.findall(line)) / size,
            line.rstrip()[-1:] in ".!?:;…\"')]", again)


def binned(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of every non-blank line, the lines' lengths, and how many lines each text has."""
    rows, sizes, counts = [], [], []
    for text in texts:
        before, seen = len(rows), set()
        for line in (text or "").split("\n"):
            if line and not line.isspace():
                rows.append(measures(line, seen))
                sizes.append(len(line))
        counts.append(len(rows) - before)
    table = np.array(rows, float).reshape(-1, MEASURES)
    bins = np.column_stack([np.searchsorted(e, table[:, k]) for k, e in enumerate(EDGES)])
    return bins.astype(np.uint8), np.array(sizes, float), np.array(counts, np.int64)


@dataclass
class Field:
    """own, before, after: weights by measure and bin; same: log potentials of bad-bad, good-good."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    same: np.ndarray
    calibration: np.ndarray
    prior: float
    #: Documents that it was fitted on.
    fitted_on: int = 0


def edges_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line has one before it, and one after it, in its text."""
    n = int(counts.sum())
    has_before, has_after = np.ones(n, bool), np.ones(n, bool)
    ends = np.cumsum(counts)[counts > 0]
    has_after[ends - 1] = False
    has_before[np.append(0, ends[:-1])[:len(ends)]] = False
    return has_before, has_after


def potentials(field: Field, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of good against bad that each line has by its features."""
    if not len(bins):
        return np.zeros(0)
    pick = np.arange(MEASURES)
    has_before, has_after = edges_of(counts)
    out = field.own[pick, bins].sum(1)
    out[1:] += np.where(has_before[1:], field.before[pick, bins[:-1]].sum(1), 0)
    out[:-1] += np.where(has_after[:-1], field.after[pick, bins[1:]].sum(1), 0)
    return np.clip(out, -25, 25)


def forward_backward(e: np.ndarray, counts: np.ndarray, same: np.ndarray):
    """Probability that each line is good; of each line and the next, that both are bad or good.

    All chains advance together, longest first, so the work is in arrays over chains.
    """
    n = len(e)
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    length = counts[order]
    move = np.exp(np.array([[same[0], 0.0], [0.0, same[1]]]))
    local = np.column_stack([np.ones(n), np.exp(e)])
    alpha, beta, pair = np.empty((n, 2)), np.ones((n, 2)), np.zeros((n, 2))
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(steps + 1)]
    for t in range(steps):
        i = first[order[:active[t]]] + t
        a = local[i] if t == 0 else (alpha[i - 1] @ move) * local[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        i = first[order[:active[t + 1]]] + t
        ahead = local[i + 1] * beta[i + 1]
        b = ahead @ move.T
        beta[i] = b / b.sum(1, keepdims=True)
        joint = alpha[i][:, :, None] * move[None] * ahead[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pair[i, 0], pair[i, 1] = joint[:, 0, 0], joint[:, 1, 1]
    both = alpha * beta
    return (both[:, 1] / both.sum(1) if n else np.zeros(0)), pair


def weighted_means(p: np.ndarray, sizes: np.ndarray, counts: np.ndarray, empty: float) -> np.ndarray:
    """Mean of each text's lines by length."""
    total = np.append(0, np.cumsum(sizes))
    good = np.append(0, np.cumsum(p * sizes))
    last = np.cumsum(counts)
    weight = total[last] - total[last - counts]
    return np.where(counts > 0, (good[last] - good[last - counts]) / np.maximum(weight, 1), empty)


def log_odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-3, 1 - 1e-3)
    return np.log(q / (1 - q))


def cut_chains(counts: np.ndarray) -> np.ndarray:
    """Lines of the chains that are fitted: a longer text is several of them."""
    whole, rest = counts // CHAIN, counts % CHAIN
    pieces = whole + (rest > 0)
    out = np.full(int(pieces.sum()), CHAIN, np.int64)
    some = rest > 0
    out[np.cumsum(pieces)[some] - 1] = rest[some]
    return out


def fit(bins, sizes, counts, labels, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; ``labels`` has 0 or 1 for each text."""
    shape = (MEASURES, BINS)
    field = Field(*(np.zeros(shape) for _ in range(3)), np.zeros(2), np.zeros(2), 0.5)
    if not len(labels):
        return field
    y = np.repeat(labels.astype(float), counts)
    has_before, has_after = edges_of(counts)
    chains = cut_chains(counts)
    goes_on = edges_of(chains)[1]
    seen = [(goes_on & (y == k)).sum() for k in (0, 1)]
    names, state = ("own", "before", "after", "same"), {}
    slot = np.arange(MEASURES) * BINS + bins

    def spread(delta, index):
        return np.bincount(index.ravel(), np.repeat(delta, MEASURES), MEASURES * BINS).reshape(shape)

    for step in range(1, steps + 1 if len(y) else 1):
        p, pair = forward_backward(potentials(field, bins, counts), chains, field.same)
        d = y - p
        grads = (spread(d, slot), spread(d[1:][has_before[1:]], slot[:-1][has_before[1:]]),
                 spread(d[:-1][has_after[:-1]], slot[1:][has_after[:-1]]),
                 np.array([seen[k] - pair[:, k].sum() for k in (0, 1)]))
        for name, g in zip(names, grads):
            w = getattr(field, name)
            g = g / len(labels) - decay * w
            m, v = state.get(name, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = m, v
            setattr(field, name, w + rate * (m / (1 - 0.9 ** step))
                    / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8))
    field.prior, field.fitted_on = float(labels.mean()), len(labels)
    p, _ = forward_backward(potentials(field, bins, counts), counts, field.same)
    q = weighted_means(p, sizes, counts, field.prior)
    field.calibration = fit_logistic(log_odds(q)[:, None], labels)
    return field


def score_texts(field: Field, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores; and each line's probability of being good, with the number of lines of each text."""
    bins, sizes, counts = binned(texts)
    p, _ = forward_backward(potentials(field, bins, counts), counts, field.same)
    q = weighted_means(p, sizes, counts, field.prior)
    scores = sigmoid(log_odds(q) * field.calibration[0] + field.calibration[1])
    return np.where(counts > 0, scores, field.prior), p, counts


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS,
          sample_lines: int = SAMPLE_LINES, doc_id: str = "doc_id", text: str = "text") -> Field:
    job_settings(docs.sparkSession)
    sample = labelled_sample(labels, label, sample_docs)
    found = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
             .join(F.broadcast(sample), F.col("id") == F.col("sample_id")))
    # A row for each document of the sample: its place by hash, and its lines.
    sizes = sorted((r.place, r.id, r.lines) for r in found.groupBy("id").agg(
        F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines"),
        F.first(F.xxhash64(F.lit(5), "id")).alias("place")).collect())
    kept, total = [], 0
    for _, key, lines in sizes:
        if kept and total + lines > sample_lines:
            break
        kept.append((key,))
        total += lines
    spark = docs.sparkSession
    ids = spark.createDataFrame(kept, f"kept_id {dict(found.dtypes)['id']}")
    rows = found.join(F.broadcast(ids), F.col("id") == F.col("kept_id")).select("text", "label")

    def run(batches):
        for batch in batches:
            got = binned(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "bins": pa.array([got[0].tobytes()]), "sizes": pa.array([got[1].tobytes()]),
                "counts": pa.array([got[2].tobytes()]),
                "labels": pa.array([np.array(batch.column("label").to_pylist(), np.int8).tobytes()])})

    parts = rows.mapInArrow(run, "bins binary, sizes binary, counts binary, labels binary").collect()
    joined = [b"".join(bytes(r[k]) for r in parts) for k in range(4)]
    return fit(np.frombuffer(joined[0], np.uint8).reshape(-1, MEASURES), np.frombuffer(joined[1]),
               np.frombuffer(joined[2], np.int64), np.frombuffer(joined[3], np.int8))


def with_score(docs: DataFrame, field: Field, name: str, text: str = "text") -> DataFrame:
    """``docs`` with one column more, of that name."""
    job_settings(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights

    def run(batches):
        for batch in batches:
            scores, _, _ = score_texts(shared.value, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)],
                                             [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = with_score(rows, train(docs, labels, doc_id=doc_id, text=text), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is classified as good."""
    field = train(docs, labels, doc_id=doc_id, text=text)
    if not field.fitted_on:
        return docs
    name = free_name(docs, "line_score")
    scored = with_score(docs, field, name, text)
    return scored.where(F.col(name) >= threshold).select(*docs.columns)
