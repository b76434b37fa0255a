"""Mixing of sources to target weights: Sainte-Lague apportionment of blocks of words.

1. Targets: sources share the total size by weight; no target exceeds ``max_repeat`` times its
   source's size, and what a capped source leaves is shared by weight among the rest.
2. The total is blocks of equal numbers of words: ``BLOCK``, or fewer where the smallest target asks
   for it (a 64th of it, one word at least). Sources get blocks by highest quotients of their targets
   over 1, 3, 5, ...; what then lacks to a target, less than a few blocks, is settled in words.
3. Each source is split into shards by a seeded hash of the document, and its blocks go to its shards
   by the same rule on shard sizes.
4. A shard's documents stand in a seeded order and their words are cut into blocks. A quota of more
   than the shard's size takes the whole shard as often as it fits; the rest takes blocks one after the
   other, from a seeded one on, the last of them in part. So a shard cuts two documents at most.

A shard holds about ``SHARD_TOKENS`` words or ``SHARD_ROWS`` rows without their texts, whatever the
size of its source, and is worked on by itself. A source of so many shards that their sums, one row
each, would pass ``MAX_SHARDS`` has larger ones. Only sums go to the driver: one row for each source,
and their number is checked.

Cases: a null or empty text has size 0 and is never taken. A null source is a source, last in
order. Rows that repeat, or share an id, are separate rows with equal rights; rows equal in id and
text share their takings in an order of no consequence. Other columns are not looked at. An empty
table, or one of empty texts, gives no takings.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortide.llm.storage import materialize
from cohortide.llm.words import PLAIN, Texts

SEED = 17
BLOCK = 256
SHARD_TOKENS = 1_000_000
SHARD_ROWS = 5_000
MAX_SHARDS = 200_000
MAX_SOURCES = 100_000


def text_size(text) -> "F.Column":
    """Number of words ended by white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place(doc_id, text, seed: int) -> "F.Column":
    """Seeded place of a row in the order of its shard."""
    return F.xxhash64(F.lit(seed), doc_id.cast("string"), F.coalesce(text, F.lit("")))


def capped_targets(sizes: list[int], weights: list[int], max_repeat: int = 3) -> list[Fraction]:
    """Shares of the total by weight, none above ``max_repeat`` times its size."""
    targets = [Fraction(0)] * len(sizes)
    left, free = Fraction(sum(sizes)), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > max_repeat * sizes[i] * weight]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = Fraction(max_repeat * sizes[i])
        left -= sum(targets[i] for i in over)
        free -= set(over)
    return targets


def sainte_lague(shares: list[float], seats: int) -> np.ndarray:
    """Seats by the highest quotients share / (2k + 1); ties go to the earlier share.

    All but a few seats each of the exact proportion are given at once, since the highest quotients
    include those; the rest one by one. Seats may be as many as the words of a corpus.
    """
    share = np.asarray(shares, float)
    out = np.zeros(len(share), np.int64)
    total = share.sum()
    if not seats or not total > 0:
        return out
    # A divisor that gives too few seats, then the quotients still open in order.
    divisor, step = total / seats, 0.0
    while True:
        quotient = share / divisor
        out = np.maximum(0, np.ceil(quotient - 0.5 - 1e-9 - 1e-12 * quotient)).astype(np.int64)
        if out.sum() <= seats:
            break
        step = max(2 * step, (out.sum() - seats + 1) / seats)
        divisor *= 1 + step
    import heapq

    heap = [(-s / (2 * k + 1), i) for i, (s, k) in enumerate(zip(share, out)) if s > 0]
    heapq.heapify(heap)
    for _ in range(int(seats - out.sum())):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-share[i] / (2 * out[i] + 1), i))
    return out


def mix(docs: DataFrame, weights=(1, 2, 3), max_repeat: int = 3, seed: int = SEED,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every row (and source and place, which name the
    row). ``weights`` repeat over sources."""
    spark = docs.sparkSession
    # One row each, without texts, since it is read three times.
    sized = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        text_size(F.col(text)).alias("size"),
        place(F.col(doc_id), F.col(text), seed).alias("place")), "sizes")
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1)
    sums = [tuple(r) for r in sums.collect()]
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [n for _, n, _ in sums]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], max_repeat)
    least = min((t for t in targets if t > 0), default=1)
    block = int(max(1, min(BLOCK, least // 64)))
    seats = sainte_lague([float(t) for t in targets], sum(sizes) // block)
    words = sainte_lague([float(t) for t in targets], sum(sizes))
    plan = spark.createDataFrame(
        [(s, n, float(t), int(k), int(w), int(min(MAX_SHARDS, 1 + max(n // SHARD_TOKENS, rows // SHARD_ROWS))))
         for (s, n, rows), t, k, w in zip(sums, targets, seats, words)],
        "source string, source_size long, target double, seats long, words long, shards int")
    # The plan has a row for each source, of which there are at most MAX_SOURCES.
    rows = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", sized["source"], "size", "place", "source_size", "target", "seats", "words",
        F.pmod(F.xxhash64("place"), "shards").cast("int").alias("shard"))

    def shard_quotas(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", ignore_index=True)
        most = group["shard_size"].to_numpy() * max_repeat
        quota = block * sainte_lague(list(group["shard_size"]), int(group["seats"].iloc[0]))
        quota = np.minimum(quota, most)
        # Settle in words what the blocks left over or took too much.
        left = int(group["words"].iloc[0]) - int(quota.sum())
        for i in np.argsort(quota - most if left > 0 else -quota, kind="stable"):
            if not left:
                break
            more = min(left, int(most[i] - quota[i])) if left > 0 else max(left, -int(quota[i]))
            quota[i] += more
            left -= more
        return group[["source", "shard"]].assign(quota=quota)

    quotas = (rows.groupBy("source", "shard")
              .agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"),
                   F.first("words").alias("words"))
              .groupBy("source").applyInPandas(shard_quotas, "source string, shard int, quota long"))
    q = quotas.select(F.col("source").alias("s"), F.col("shard").alias("h"), "quota")
    both = rows.join(q, rows["source"].eqNullSafe(q["s"]) & (rows["shard"] == q["h"])).select(
        "doc_id", "size", "source_size", "target", "source", "place", "shard", "quota")

    def take(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "size", "doc_id"], ignore_index=True)
        name = zlib.crc32(str(group["source"].iloc[0]).encode())
        return group[list(_TAKEN)[:-1]].assign(taken=taken_words(
            group["size"].to_numpy(), int(group["quota"].iloc[0]), block,
            np.random.default_rng([seed, name, int(group["shard"].iloc[0])])))

    kinds = {**dict(both.dtypes), "taken": "bigint"}
    return both.groupBy("source", "shard").applyInPandas(
        take, ", ".join(f"{c} {kinds[c]}" for c in _TAKEN)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "place")


_TAKEN = ("doc_id", "size", "source_size", "target", "source", "place", "taken")


def taken_words(sizes: np.ndarray, quota: int, block: int, rng) -> np.ndarray:
    """How many words of each document a shard's quota takes; documents stand one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total or not quota:
        return np.zeros(len(sizes), np.int64)
    whole, rest = divmod(quota, total)
    blocks = -(-total // block)
    lengths = np.full(blocks, block, np.int64)
    lengths[-1] = total - block * (blocks - 1)
    order = (rng.integers(blocks) + np.arange(blocks)) % blocks
    passed = np.cumsum(lengths[order])
    used = np.zeros(blocks, np.int64)
    used[order] = np.clip(rest - (passed - lengths[order]), 0, lengths[order])
    before = np.append(0, np.cumsum(used))

    def upto(x):  # words taken before place x
        b = np.minimum(x // block, blocks - 1)
        return before[b] + np.minimum(x - b * block, used[b])

    return whole * sizes + upto(ends) - upto(ends - sizes)


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it. A last copy that is taken
    in part ends after so many words, so a source comes to its target and not beyond it.

    Rows equal in id and text are alike to the mix, so their takings are handed out among them."""
    taken = mix(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                            F.col(source).alias("source")), **how)
    same = Window.partitionBy("key_of_row", "source_of_row").orderBy(F.lit(0))
    key = ("key_of_row", "source_of_row", "number_of_row")
    times = (taken.select(F.col("place").alias("key_of_row"), F.col("source").alias("source_of_row"),
                          F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size")))
                          .cast("int").alias("times_of_row"), "taken", "size")
             .withColumn("number_of_row", F.row_number().over(same))
             .where("times_of_row > 0")
             .select(*key, "times_of_row", (F.col("taken") - (F.col("times_of_row") - 1) * F.col("size"))
                     .alias("last_of_row"), F.col("size").alias("size_of_row")))
    rows = docs.withColumns({
        "key_of_row": place(F.col(doc_id), F.col(text), how.get("seed", SEED)),
        "source_of_row": F.col(source).cast("string")}).withColumn(
            "number_of_row", F.row_number().over(same))
    left, right = rows.alias("l"), times.alias("r")
    both = left.join(right, F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in key)))
    every = F.explode(F.sequence(F.lit(1), F.col("times_of_row")))
    copies = both.select("l.*", "times_of_row", "last_of_row", "size_of_row").withColumn("copy_of_row", every)
    cut = F.when((F.col("copy_of_row") == F.col("times_of_row")) & (F.col("last_of_row") < F.col("size_of_row")),
                 F.col("last_of_row"))
    return cut_texts(copies.select(*docs.columns, cut.alias("cut_of_row")), text)


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    words = Texts(pa.array([text]), PLAIN)
    return words.data[:words.ends[n - 1]].tobytes().decode()


def cut_texts(rows: DataFrame, text: str) -> DataFrame:
    """Rows without their last column, the texts cut to as many words as that says; null: whole."""
    schema = rows.drop("cut_of_row").schema

    def run(batches):
        for batch in batches:
            cut, body = batch.column("cut_of_row"), batch.drop_columns(["cut_of_row"])
            if cut.null_count < len(cut):
                at = body.schema.get_field_index(text)
                texts = body.column(at).to_pylist()
                for i, n in enumerate(cut.to_pylist()):
                    if n is not None:
                        texts[i] = first_words(texts[i], n)
                body = body.set_column(at, body.schema.field(at), pa.array(texts, body.schema.field(at).type))
            yield body

    return rows.mapInArrow(run, schema)
