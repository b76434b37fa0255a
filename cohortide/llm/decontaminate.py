"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised to lower-case words and words to numbers; a pattern is a window of an item, so
its nodes are words and a match begins and ends at word edges. Each document is scanned once. Matches
are word ranges, mapped back to character offsets of the original text. A worker process builds the
automaton of a pass once and keeps it for its tasks.

Cases: a null or empty text has no words and no hits. An item without words is ignored; one of
fewer words than the window is a single window. Items that repeat, or share windows, are all named.
A null item id is never named, but its windows count. Rows that repeat give a row each. Other
columns are not looked at. No items: nothing is hit. No documents: no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortide.llm.storage import materialize
from cohortide.llm.words import ALNUM, Texts, job_settings, slices

#: Item text for one automaton, in bytes. More items are scanned for in several passes. Measured:
#: 130 bytes of memory for a byte of text, so a worker holds about 270 MB at this size.
SHARD_BYTES = 2 << 20
RESULT = ("n_words long, hits array<struct<start:int,end:int>>, "
          "spans array<struct<start:int,end:int>>, items array<string>")


class Windows:
    """The automaton of the windows of some items, over numbers of words.

    A window adds at most one node for each of its words, of about 40 bytes. What a window tells is
    its length and the ids of its items. Words are numbered by 64-bit hash; a word that no item has is
    0, and there the automaton is back at its root. So only stretches of known words that are as long
    as the shortest window are scanned; numpy finds them."""

    def __init__(self, items, window: int):
        import ahocorasick

        items = list(items)
        texts = Texts(pa.array([text or "" for _, text in items], pa.string()), ALNUM, lower=True)
        self.words, numbers = np.unique(texts.hashes(), return_inverse=True)
        numbers = (numbers + 1).tolist()
        owners: dict[tuple, set] = {}
        for (key, _), a, b in zip(items, texts.first[:-1].tolist(), texts.first[1:].tolist()):
            ids = tuple(numbers[a:b])
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[i:i + window], set()).update(() if key is None else (key,))
        self.found, self.shortest = None, min(map(len, owners), default=0)
        if owners:
            self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            shared: dict[frozenset, frozenset] = {}
            for ids, keys in owners.items():
                keys = frozenset(keys)
                self.found.add_word(ids, (len(ids), shared.setdefault(keys, keys)))
            self.found.make_automaton()

    def matches(self, texts: Texts):
        """(text, first word, end, ids) of every occurrence, words counted over all texts."""
        h = texts.hashes()
        if self.found is None or not len(h):
            return
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        numbers = np.where(self.words[at] == h, at + 1, 0)
        known = np.concatenate([[False], numbers > 0, [False]])
        # A stretch begins at a known word after an unknown one or at a text's first word.
        first = np.zeros(len(h) + 1, bool)
        first[texts.first[:-1]] = True
        begin = np.flatnonzero(known[1:-1] & (~known[:-2] | first[:-1]))
        end = np.flatnonzero(known[1:-1] & (~known[2:] | np.append(first[1:-1], True))) + 1
        long = end - begin >= self.shortest
        owner = np.searchsorted(texts.first, begin[long], "right") - 1
        for t, a, b in zip(owner.tolist(), begin[long].tolist(), end[long].tolist()):
            for last, (length, keys) in self.found.iter(tuple(numbers[a:b].tolist())):
                yield t, a + last - length + 1, a + last + 1, keys


#: The automaton of this worker process, by the name of its shard. A task of the same pass finds it here.
_BUILT: dict[str, Windows] = {}


def windows_of(shared: tuple[str, list], window: int) -> Windows:
    """The automaton of a shard (its name, its items), built once in a worker; that of an earlier
    pass goes."""
    name, items = shared
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(items, window)
    return _BUILT[name]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open ranges joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(texts: Texts, windows: Windows) -> list[tuple[list, list, list]]:
    """For each text merged word ranges, their character spans, and ids of the items that occur."""
    found: dict[int, tuple[list, set]] = {}
    for t, a, b, keys in windows.matches(texts):
        ranges, owners = found.setdefault(t, ([], set()))
        ranges.append((a, b))
        owners |= keys
    out = [([], [], [])] * len(texts)
    for t, (ranges, owners) in found.items():
        ranges, first, base = merged(ranges), int(texts.first[t]), int(texts.at[t])
        body = texts.text(t)
        spans = [tuple(len(body[:int(x) - base].decode("utf-8", "replace"))
                       for x in (texts.starts[a], texts.ends[b - 1])) for a, b in ranges]
        out[t] = ([(a - first, b - first) for a, b in ranges], spans, sorted(owners))
    return out


def _pass(docs: DataFrame, shared, window: int) -> DataFrame:
    types = pa.schema([("n_words", pa.int64()), *[(c, pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32())]))) for c in ("hits", "spans")],
        ("items", pa.list_(pa.string()))])

    def run(batches):
        windows = windows_of(shared.value, window)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = Texts(batch.column("text"), ALNUM, lower=True)
                rows = scan(texts, windows)
                cols = [pa.array(texts.counts, pa.int64())]
                cols += [pa.array([[{"start": a, "end": b} for a, b in r[k]] for r in rows], types[k + 1].type)
                         for k in (0, 1)]
                cols.append(pa.array([r[2] for r in rows], types[3].type))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", *types.names])

    result = T.StructType([docs.schema["id"], *T.StructType.fromDDL(RESULT)])
    return docs.mapInArrow(run, result)


def item_shards(items: DataFrame, shard_bytes: int) -> list:
    """Broadcasts of about ``shard_bytes`` of item text (columns k and t) each, with a name."""
    spark = items.sparkSession
    size = items.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    shards, out = 1 + size // shard_bytes, []
    for s in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(shards)) == s)
        out.append(spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in own.toLocalIterator()])))
    return out


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id",
                   text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each document: id, n_words, hit word ranges, their character spans, and item ids.

    Items are broadcast in shards of about ``shard_bytes`` of text (a longer item is a shard of its
    own size); with more than one shard, each document's ranges are joined afterwards.
    """
    spark = docs.sparkSession
    job_settings(spark)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_id).cast("string").alias("k"),
                         F.col(item_text).cast("string").alias("t"))
    shared = item_shards(items, shard_bytes)
    shards = len(shared)
    if shards > 1:
        rows = rows.withColumn("id", F.struct("id", F.monotonically_increasing_id().alias("row")))
    parts = [_pass(rows, own, window) for own in shared]
    if shards == 1:
        return parts[0].withColumnRenamed("id", doc_id)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def joined(name):
        ordered = F.sort_array(F.flatten(F.collect_list(name)))
        step = F.aggregate(
            ordered, F.array().cast("array<struct<start:int,end:int>>"),
            lambda out, r: F.when(
                (F.size(out) > 0) & (r["start"] <= F.element_at(out, -1)["end"]),
                F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
                    F.element_at(out, -1)["start"].alias("start"),
                    F.greatest(r["end"], F.element_at(out, -1)["end"]).alias("end")))))
            .otherwise(F.concat(out, F.array(r))))
        return step.alias(name)

    return every.groupBy("id").agg(
        F.max("n_words").alias("n_words"), joined("hits"), joined("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select(
        F.col("id.id").alias(doc_id), "n_words", "hits", "spans", "items")


def digest(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and a hash of the item ids in place of the ranges."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"),
                        lambda n, r: n + (r["end"] - r["start"]).cast("long"))
    return hits.select(
        doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES
                      ) -> DataFrame:
    """The rows of ``docs``, all columns, that no window of an item occurs in.

    Each shard of items drops its rows in a pass over what the one before left, so no row is ever
    shuffled; what a pass keeps is written before the next."""
    job_settings(docs.sparkSession)
    rows = items.select(F.col(item_id).cast("string").alias("k"), F.col(item_text).cast("string").alias("t"))
    shared = item_shards(rows, shard_bytes)

    def keeping(own):
        def run(batches):
            windows = windows_of(own.value, window)
            for whole in batches:
                for batch in slices(whole, text, 1 << 20):
                    texts = Texts(batch.column(text).cast(pa.string()), ALNUM, lower=True)
                    clean = np.ones(len(texts), bool)
                    clean[[t for t, *_ in windows.matches(texts)]] = False
                    yield batch.filter(pa.array(clean))
        return run

    for number, own in enumerate(shared):
        docs = docs.mapInArrow(keeping(own), docs.schema)
        if number + 1 < len(shared):
            docs = materialize(docs, "clean-documents")
    return docs
