"""Near duplicates by SimHash, joined exactly through vantage-point trees.

1. Fingerprints. A task hashes the 3-word shingles of its texts and votes bit by bit. Rows of one
   fingerprint in a slice leave the task as one row, so a text that a third of all rows copy is
   summed up before anything is shuffled. All further work is on distinct fingerprints.
2. Shards. A tree of vantage points is fitted on a bounded sample: each point splits at a radius
   around it. A fingerprint goes to every shard that its ball of half the threshold can meet, which
   the triangle inequality tells from its distance to the points on the way. Two fingerprints within
   the threshold have a point half way between them, so both are sent to that point's shard.
3. A shard goes on splitting by vantage points of its own, with the same overlap, and compares what
   is left pairwise. It emits a spanning forest of its links, not the links.
4. Components of all forests, named by the smallest id, and spread to the copies.

Cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any other.
A text of fewer words than n has one shingle, the whole. Rows that repeat are linked. Rows without
an id come back, in the component of their fingerprint; its name is null only if no row of it has
an id. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortide.llm.components import components, stars
from cohortide.llm.storage import materialize
from cohortide.llm.words import job_settings, slices

N = 3
SEED = 42
THRESHOLD = 2
#: Distinct fingerprints that a shard is meant to hold, guests not counted.
SHARD = 4096
#: Sampled fingerprints for each shard, and in all. Beyond the latter shards grow.
PER_SHARD = 16
SAMPLE = 1 << 18
#: What a shard compares pairwise.
LEAF = 512
#: Vantage points that are tried for a split.
TRIES = 5


def fingerprint(text: bytes, n: int = N, seed: int = SEED) -> int:
    """Bit i is set if over half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        return digest(b" ".join(words), seed)
    total = len(words) - n + 1
    hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(n)))),
                         "<u8", total)
    votes = np.zeros(64, np.int64)
    for i in range(0, total, 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        votes += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """fingerprint (as a long) and the ids that have it, one row for each of a slice."""
    job_settings(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                groups = {}
                texts = part.column("text").cast(pa.large_binary())
                for key, body in zip(part.column("id").to_pylist(), texts):
                    groups.setdefault(fingerprint(body.as_py() or b"", n), []).append(key)
                values = np.array(list(groups), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, pa.int64()), pa.array(list(groups.values()), pa.list_(pa.int64()))],
                    ["fingerprint", "ids"])

    return rows.mapInArrow(run, "fingerprint long, ids array<long>")


# --- vantage-point trees ------------------------------------------------------------------------

def distances(x: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(x ^ point).astype(np.int16)


def best_split(x: np.ndarray, reach: int, rng) -> tuple | None:
    """Point and radius whose larger side, with the overlap, is least; None if none takes a tenth off."""
    best, least = None, 0.9 * len(x)
    for point in x[rng.integers(0, len(x), TRIES)]:
        d = distances(x, point)
        radius = int(np.median(d))
        for r in (radius, radius - 1):
            most = max(int((d - reach <= r).sum()), int((d + reach > r).sum()))
            if most < least:
                best, least = (point, r), most
    return best


def grow(sample: np.ndarray, leaf: int, reach: int, rng) -> tuple:
    """A tree as nested (point, radius, inside, outside); a leaf is an empty tuple."""
    split = best_split(sample, reach, rng) if len(sample) > leaf else None
    if split is None:
        return ()
    point, r = split
    d = distances(sample, point)
    return (point, r, grow(sample[d <= r], leaf, reach, rng), grow(sample[d > r], leaf, reach, rng))


def route(tree: tuple, x: np.ndarray, reach: int) -> list[np.ndarray]:
    """For each leaf, from left to right, the indices whose ball of that reach can meet it."""
    out = []

    def down(node, at):
        if not node:
            out.append(at)
            return
        point, r, inside, outside = node
        d = distances(x[at], point)
        down(inside, at[d - reach <= r])
        down(outside, at[d + reach > r])

    down(tree, np.arange(len(x)))
    return out


def near_pairs(x: np.ndarray, threshold: int, reach: int, leaf: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of ``x`` that are linked within the threshold."""
    left, right = [], []
    todo = [x]
    while todo:
        part = todo.pop()
        split = best_split(part, reach, rng) if len(part) > leaf else None
        if split is not None:
            d = distances(part, split[0])
            todo += [part[d - reach <= split[1]], part[d + reach > split[1]]]
            continue
        for i in range(0, len(part), leaf):
            own = part[i:i + leaf]
            for j in range(i, len(part), leaf):
                a, b = np.nonzero(np.bitwise_count(own[:, None] ^ part[None, j:j + leaf]) <= threshold)
                new = i + a < j + b
                left.append(own[a[new]].view(np.int64))
                right.append(part[j + b[new]].view(np.int64))
                if sum(map(len, left)) > 1 << 20:
                    node, root = stars(np.concatenate(left), np.concatenate(right))
                    left, right = [node[node != root]], [root[node != root]]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, root = stars(np.concatenate(left), np.concatenate(right))
    return node[node != root], root[node != root]


def shard_tree(distinct: DataFrame, n: int, reach: int, shard: int) -> tuple:
    """A tree whose leaves get about ``shard`` fingerprints, grown on a sample of them."""
    if n <= shard:
        return ()
    want = min(SAMPLE, PER_SHARD * n // shard)
    fine = 1 << 30
    rows = distinct.where(F.pmod(F.xxhash64(F.lit(7), "fingerprint"), F.lit(fine)) < fine * want // n)
    sample = np.sort(np.asarray(rows.select("fingerprint").toArrow().column(0).to_numpy()).view(np.uint64))
    return grow(sample, max(PER_SHARD, len(sample) * shard // n), reach, np.random.default_rng(3))


def near_links(distinct: DataFrame, n: int, threshold: int = THRESHOLD, shard: int = SHARD,
               leaf: int = LEAF) -> DataFrame:
    """Links a, b between distinct fingerprints that connect all within the threshold."""
    reach = -(-threshold // 2)
    tree = shard_tree(distinct, n, reach, shard)

    def deal(batches):
        for batch in batches:
            x = np.asarray(batch.column("fingerprint")).view(np.uint64)
            parts = route(tree, x, reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), pa.int32()),
                 pa.array(x[np.concatenate(parts)].view(np.int64))], ["shard", "fingerprint"])

    def join(table: pa.Table) -> pa.Table:
        x = np.unique(table.column("fingerprint").to_numpy().view(np.uint64))
        a, b = near_pairs(x, threshold, reach, leaf, np.random.default_rng(len(x)))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (distinct.select("fingerprint").mapInArrow(deal, "shard int, fingerprint long")
            .groupBy("shard").applyInArrow(join, "a long, b long"))


def near_components(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, shard: int = SHARD,
                    leaf: int = LEAF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = materialize(fingerprints(docs, n, doc_id, text), "fingerprints")
    distinct = materialize(rows.groupBy("fingerprint").agg(
        F.min(F.array_min("ids")).alias("low")), "distinct-fingerprints")
    roots = components(near_links(distinct, distinct.count(), threshold, shard, leaf))
    linked = distinct.join(roots, F.col("fingerprint") == F.col("node"))
    lows = linked.groupBy("root").agg(F.min("low").alias("root_low"))
    named = linked.join(lows, "root").select("node", F.col("root_low"))
    names = distinct.join(named, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("root_low"))
        .alias("component_id"))
    return rows.join(names, "fingerprint").select(
        F.explode("ids").alias(doc_id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")
