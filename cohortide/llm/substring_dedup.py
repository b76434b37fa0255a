"""Substring dedup: suffix automata of reference shards give matching statistics of documents.

Every document is a reference for those with larger ids, so the reference is the corpus and its
automata cannot be broadcast whole. It is sharded such that a match never spans shards: each window
of ``window`` words goes to the shard of its minimizer (the least hash among its word pairs), and
runs of windows with one minimizer go as one segment. Equal windows have equal minimizers, so all
copies of a passage meet in one shard, however many shards there are.

In a shard, hashes tell which windows are in several documents at all. For these a suffix automaton
is built over the reference segments, in ascending id order, so that each state knows the first
document of its substrings; automata hold about ``SHARD_WORDS`` words at a time. The other segments
are streamed through it: where the match is as long as a window and its first document is smaller,
the window is removed. Maximal spans of removed windows are then cut from the documents.

A passage of very many copies does not meet in one shard copy by copy. Of a window that several
documents of a slice have, only those of the smallest id are sent; for the others the verdict is
known. Windows of a minimizer that very many windows share, as those around such a passage do, are
dealt by their own content instead, so they spread over all shards and equal ones still meet. Which
minimizers these are is estimated on a part of the rows; it decides where windows go, not results.
In a shard, segments of one content are inserted and streamed once.

Cases: a null or empty text has no words. A text shorter than the window keeps all. Rows of one id
do not remove from each other; rows equal in id and text get equal results. A row without an id
removes nothing and loses nothing. Other columns are not looked at.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortide.llm.words import PLAIN, Texts, job_settings, mix, slices
from cohortide.llm.storage import materialize

WINDOW = 13
#: Text bytes whose windows share a shard.
BUCKET_BYTES = 10 << 20
#: Words in one automaton.
SHARD_WORDS = 50_000
#: Windows of one minimizer, above which they are dealt by content, and the part of rows (one in so
#: many) that this is estimated on.
DEALT, PART = 100_000, 16
#: Windows in one segment at most.
_RUN = 240
#: Words of so few bytes are common; pairs of them are minimizers last.
_SHORT = 3
U64 = np.uint64
_NAMES = ["bucket", "words", "runs", "starts", "docs", "ids", "gone"]
_KINDS = [pa.int32(), *[pa.binary()] * 6]
_SCHEMA = ("bucket int, words binary, runs binary, starts binary, docs binary, ids binary, "
           "gone binary")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start as many as its length."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def pair_ranks(words: np.ndarray) -> np.ndarray:
    """Hash rank of each word and the next; pairs of short words (odd numbers) come last."""
    a, b = words[:-1].astype(np.uint64), words[1:].astype(np.uint64)
    return (mix(a * U64(0x9E3779B97F4A7C15) + b) >> U64(1)) | ((a & b & U64(1)) << U64(63))


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= k:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = k - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def windows(texts: Texts, window: int):
    """Word numbers; and of every window the first word, and the minimizer."""
    short = (texts.ends - texts.starts <= _SHORT).astype(np.uint32)
    words = ((texts.hashes() >> U64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)) | short
    if len(words) < window:
        return words, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(texts.first[1:], texts.counts)[:len(words) - window + 1]
    at = np.flatnonzero(np.arange(len(last)) + window <= last)
    return words, at, sliding_min(pair_ranks(words), window - 1)[at]


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    n = len(words) - window + 1
    h = mix(words[:n].astype(np.uint64))
    wide = mix(words.astype(np.uint64))
    for j in range(1, window):
        h *= U64(0x9E3779B97F4A7C15)
        h += wide[j:j + n]
    return mix(h)


def known_gone(words, at, h, doc, window) -> np.ndarray:
    """Whether a document of smaller id has the window, among these windows; words are compared."""
    order = np.lexsort((doc, h))
    start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(order[start], np.diff(np.append(start, len(order))))
    asked = np.flatnonzero(doc[least] < doc)
    same = np.ones(len(asked), bool)
    for j in range(window):
        same &= words[at[asked] + j] == words[at[least[asked]] + j]
    gone = np.zeros(len(h), bool)
    gone[asked[same]] = True
    return gone


def common_minimizers(rows: DataFrame, window: int) -> np.ndarray:
    """Minimizers of about ``DEALT`` windows or more: as many as there are windows, over that."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                low, n = np.unique(windows(Texts(part.column("text"), PLAIN), window)[2],
                                   return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(n)], ["low", "n"])

    some = rows.where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(PART)) == 0)
    found = some.mapInArrow(run, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(
        F.col("n") >= max(1, DEALT // PART)).select("low").toArrow()
    return np.sort(found.column("low").to_numpy().view(np.uint64))


def send_segments(rows: DataFrame, window: int, bits: int, common: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"), PLAIN)
                words, at, low = windows(texts, window)
                if not len(at):
                    continue
                ids = np.column_stack([np.asarray(part.column("id")), np.asarray(part.column("key"))])
                # Rows equal in id and text have equal results: one of a slice stands for all.
                once = np.zeros(len(texts), bool)
                once[np.unique(ids[:, 1], return_index=True)[1]] = True
                owner = texts.owner()
                h = window_hashes(words, window)[at]
                use = once[owner[at]]
                at, low, h = at[use], low[use], h[use]
                gone = known_gone(words, at, h, ids[owner[at], 0], window)
                out = []
                if gone.any():
                    lost = at[gone]
                    key = ids[owner[lost], 1]
                    new = np.flatnonzero(np.append(
                        True, (lost[1:] != lost[:-1] + 1) | (owner[lost[1:]] != owner[lost[:-1]])))
                    triples = np.column_stack([key[new], lost[new] - texts.first[owner[lost[new]]],
                                               np.diff(np.append(new, len(lost)))]).astype(np.int64)
                    b = int(mix(key[:1].view(np.uint64))[0] >> U64(64 - bits))
                    out.append((b, b"", b"", b"", b"", b"", triples.tobytes()))
                at, low, h = at[~gone], low[~gone], h[~gone]
                deal = np.where(np.isin(low, shared.value), h, low)
                new = np.ones(len(at), bool)
                new[1:] = ((at[1:] != at[:-1] + 1) | (deal[1:] != deal[:-1])
                           | (owner[at[1:]] != owner[at[:-1]]))
                begin = np.flatnonzero(new)
                place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                begin = np.flatnonzero(place % _RUN == 0)
                runs = np.diff(np.append(begin, len(at)))
                at, bucket = at[begin], (mix(deal[begin]) >> U64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at, runs, bucket = at[order], runs[order], bucket[order]
                own = owner[at]
                edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    i, j = edges[b], edges[b + 1]
                    used, docs = np.unique(own[i:j], return_inverse=True)
                    out.append((int(b), words[ranges(at[i:j], runs[i:j] + window - 1)].tobytes(),
                                runs[i:j].astype(np.uint8).tobytes(),
                                (at[i:j] - texts.first[own[i:j]]).astype(np.uint32).tobytes(),
                                docs.astype(np.uint16).tobytes(), ids[used].tobytes(), b""))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)

    return rows.mapInArrow(run, _SCHEMA)


class SuffixAutomaton:
    """Of several word sequences; ``first`` is the document in which a state's strings came first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, moves: dict, length: int, first: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.first.append(first)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings through p that end in c, parted from the longer ones of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.first[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], document: int) -> None:
        moves, link = self.next, self.link
        last = 0
        for c in words:
            q = moves[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new, p = self._state({}, self.length[last] + 1, document), last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, c, moves[p][c])
            last = new

    def first_documents(self, words: list[int], window: int, none: int) -> list[int]:
        """For each window of ``words`` the first document that has it, or ``none``."""
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for i, c in enumerate(words):
            while state and c not in moves[state]:
                state = link[state]
                matched = length[state]
            to = moves[state].get(c)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(self.first[state] if matched >= window else none)
        return out


_NONE = np.iinfo(np.int64).max


def match_segments(words, offset, runs, doc, window):
    """For each segment's windows the first document that has it; of segments with shared windows.

    Returns numbers of segments, and their first documents one after the other.
    """
    at = ranges(offset, runs)
    h = window_hashes(words, window)[at]
    own = np.repeat(doc, runs)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    lengths = np.diff(np.append(start, len(order)))
    low = np.empty(len(h), np.int64)
    high = np.empty(len(h), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(own[order], start), lengths)
    high[order] = np.repeat(np.maximum.reduceat(own[order], start), lengths)
    segment = np.repeat(np.arange(len(runs)), runs)
    shared = low < high
    reference = np.zeros(len(runs), bool)
    reference[segment[shared & (own == low)]] = True
    asked = np.zeros(len(runs), bool)
    asked[segment[shared & (own > low)]] = True
    # Of equal segments the one of the smallest document stands for all.
    which = np.flatnonzero(reference | asked)
    first_hash = np.append(0, np.cumsum(runs))[which]
    spread = mix(h + U64(1)) * (np.arange(len(h)) - np.repeat(np.append(0, np.cumsum(runs))[:-1], runs)
                                + 1).astype(np.uint64)
    sums = np.append(U64(0), np.cumsum(spread, dtype=np.uint64))
    content = mix(sums[first_hash + runs[which]] - sums[first_hash] + runs[which].astype(np.uint64))
    by = np.lexsort((doc[which], content))
    which, content = which[by], content[by]
    head = np.append(True, content[1:] != content[:-1])[:len(which)]
    group = np.cumsum(head) - 1
    heads = which[head]
    is_reference = np.zeros(len(heads), bool)
    np.logical_or.at(is_reference, group, reference[which])
    is_asked = np.zeros(len(heads), bool)
    np.logical_or.at(is_asked, group, asked[which])
    # Segments with one minimizer stay in one automaton.
    pairs = ranges(offset[heads], np.full(len(heads), window - 1))
    ranks = pair_ranks(words)[pairs].reshape(-1, window - 1).min(1) if len(heads) else np.zeros(0, np.uint64)
    by = np.lexsort((doc[heads], ranks))
    results: list = [None] * len(heads)
    i = 0
    while i < len(by):
        j, size = i, 0
        while j < len(by) and (size < SHARD_WORDS or ranks[by[j]] == ranks[by[j - 1]]):
            size += runs[heads[by[j]]] + window - 1
            j += 1
        batch = sorted(by[i:j], key=lambda g: doc[heads[g]])
        shard = SuffixAutomaton()
        lists = {g: words[offset[heads[g]]:offset[heads[g]] + runs[heads[g]] + window - 1].tolist()
                 for g in batch}
        for g in batch:
            if is_reference[g]:
                shard.add(lists[g], int(doc[heads[g]]))
        for g in batch:
            if is_asked[g]:
                results[g] = shard.first_documents(lists[g], window, _NONE)
        i = j
    keep = np.array([results[g] is not None for g in group], bool) if len(group) else np.zeros(0, bool)
    return which[keep], [results[g] for g in group[keep]]


def remove_in_bucket(window: int):
    """A function from a bucket's segments to runs of removed windows: key, start, n."""

    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_pylist() for c in _NAMES[1:]]
        words = np.frombuffer(b"".join(cols[0]), np.uint32)
        runs = np.frombuffer(b"".join(cols[1]), np.uint8).astype(np.int64)
        starts = np.frombuffer(b"".join(cols[2]), np.uint32).astype(np.int64)
        ids = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in cols[4]]
        base = np.cumsum([0] + [len(x) for x in ids])[:-1]
        local = np.frombuffer(b"".join(cols[3]), np.uint16).astype(np.int64)
        local += np.repeat(base, [len(x) // 2 for x in cols[3]])
        ids = np.concatenate(ids)
        doc = ids[local, 0]
        sizes = runs + window - 1
        offset = np.cumsum(sizes) - sizes
        gone = np.frombuffer(b"".join(cols[5]), np.int64).reshape(-1, 3)
        which, found = match_segments(words, offset, runs, doc, window) if len(runs) else ([], [])
        if not len(which):
            return pa.table({"key": pa.array(gone[:, 0]), "start": pa.array(gone[:, 1].astype(np.int32)),
                             "n": pa.array(gone[:, 2].astype(np.int32))})
        first = np.array([x for f in found for x in f], np.int64)
        own = np.repeat(doc[which], runs[which])
        place = ranges(starts[which], runs[which])[first < own]
        key = np.repeat(ids[local[which], 1], runs[which])[first < own]
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (key[1:] != key[:-1]))[:len(key)])
        found = np.column_stack([key[new], place[new], np.diff(np.append(new, len(key)))])
        found = np.concatenate([gone, found.astype(np.int64)])
        return pa.table({"key": pa.array(found[:, 0]), "start": pa.array(found[:, 1].astype(np.int32)),
                         "n": pa.array(found[:, 2].astype(np.int32))})

    return run


def removed_runs(rows: DataFrame, window: int) -> DataFrame:
    """key, start and n of runs of removed windows. ``rows``: id, key, text."""
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(4, min(24, ceil(log2(1 + size / BUCKET_BYTES))))
    rows = rows.where("id is not null")
    sent = send_segments(rows, window, bits, common_minimizers(rows, window))
    return materialize(sent.groupBy("bucket").applyInArrow(
        remove_in_bucket(window), "key long, start int, n int"), "removed")


def cut(rows: DataFrame, window: int) -> DataFrame:
    """``rows``: id, text and runs (a list or null)."""
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            counts, gone, spans, kept = [], [], [], []
            for text, runs in zip(batch.column("text").fill_null("").cast(pa.binary()).to_pylist(),
                                  batch.column("runs").to_pylist()):
                words, own = text.split(), []
                for r in sorted((r["start"], r["start"] + r["n"] + window - 1) for r in runs or ()):
                    if own and r[0] <= own[-1][1]:
                        own[-1] = (own[-1][0], max(own[-1][1], r[1]))
                    else:
                        own.append(r)
                counts.append(len(words))
                gone.append(sum(b - a for a, b in own))
                spans.append([{"start": a, "end": b} for a, b in own])
                for a, b in reversed(own):
                    del words[a:b]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, spans_kind), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "removed", "kept_text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "runs").mapInArrow(
        run, f"id {kind}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, "
             "kept_text string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed spans (in words) and kept_text of every row."""
    job_settings(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    # Equal rows send equal runs, which the set holds once.
    removed = removed_runs(rows, window)
    runs = removed.groupBy(F.col("key").alias("of")).agg(
        F.collect_set(F.struct("start", "n")).alias("runs"))
    both = rows.join(runs, F.col("key") == F.col("of"), "left")
    return cut(both, window).withColumnRenamed("id", doc_id)


def digest(result: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return result.select(doc_id, "n_words", "n_removed",
                         F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
