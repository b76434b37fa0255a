"""Periodic runs of words, found on a grammar of the texts.

A run is a longest stretch of words that repeats with a period, here of at least 24 words and three
periods. The words of a slice of documents are compressed by Re-Pair: pairs of neighbouring symbols
that repeat are replaced by nonterminals until none is left that does, and the rest of each document is
folded in halves. Pairs go by class of frequency (powers of two), most frequent first, then by hash; all
pairs that precede their neighbours are replaced in one numpy step, where strict Re-Pair would go one
by one. A nonterminal is named by a hash of its two parts, so equal pairs share it across rounds and
documents.

Every run has one smallest nonterminal around it, whose boundary it crosses. So each nonterminal is
looked at once, at one of its places: a run that crosses the boundary holds 1.5 periods and 12 words
on one side, hence the four words there return one period on. Each return is a candidate, extended to
both sides by comparing prefix hashes, then word by word. What is found is translated to all places
of the nonterminal, and of the stretches of one period in a document the longest ones stay.

Nothing is shuffled: a document lies in one task, and a slice of a few MB is worked on at a time (a
longer text is a slice).

Cases: a null or empty text, or one without words, has no runs and an empty collapsed text. Rows that
repeat, or have no id, are handled each by itself. Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortide.llm.words import PLAIN, Texts, job_settings, mix, slices

MIN_WORDS = 24
MIN_PERIODS = 3
SLICE_BYTES = 2 << 20
U64 = np.uint64
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_BASE = 0x9E3779B97F4A7C15


class Grammar:
    """A straight-line grammar of the documents of a slice.

    ``words`` are hashes, those of document d from ``first[d]`` to ``first[d + 1]``. ``symbol``,
    ``start``, ``middle`` and ``end`` list the places of all nonterminals of ``least`` words or more.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, least: int):
        n = len(words)
        self.least = least
        self.name = words.copy()
        self.size = np.ones(n, np.int64)
        # Neighbours in the current sequences; n stands for none.
        self.next = np.arange(1, n + 1)
        self.prev = np.arange(-1, n - 1)
        ends = first[1:][first[1:] > first[:-1]]
        self.next[ends - 1] = n
        starts = first[:-1][first[1:] > first[:-1]]
        self.prev[starts] = n
        self.alive = np.ones(n, bool)
        self.places = []
        self._repair(n)
        self._fold(n)
        cols = zip(*self.places) if self.places else [[np.zeros(0, np.uint64)], *[[np.zeros(0, np.int64)]] * 3]
        self.symbol, self.start, self.middle, self.end = (np.concatenate(c) for c in cols)

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        return mix(self.name[at] * _LEFT + mix(self.name[self.next[at]] + _RIGHT))

    def _replace(self, at: np.ndarray, names: np.ndarray) -> None:
        """The symbols at these places and their right neighbours become one."""
        right = self.next[at]
        middle = at + self.size[at]
        self.name[at] = names
        self.size[at] += self.size[right]
        after = self.next[right]
        self.next[at] = after
        self.alive[right] = False
        inner = after < len(self.name)
        self.prev[after[inner]] = at[inner]
        long = self.size[at] >= self.least
        if long.any():
            self.places.append((names[long], at[long], middle[long], (at + self.size[at])[long]))

    def _repair(self, n: int) -> None:
        live = np.flatnonzero(self.next < n)
        rank = np.zeros(n + 1, np.uint64)  # of the pair that starts at a place; 0 for none
        while len(live):
            pairs = self._pairs(live)
            order = np.argsort(pairs)
            own = pairs[order]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            times = np.diff(np.append(new, len(own)))
            counts = np.empty(len(own), np.int64)
            counts[order] = np.repeat(times, times)
            twice = counts > 1
            rank[live] = 0
            live, pairs, counts = live[twice], pairs[twice], counts[twice]
            if not len(live):
                return
            # Class of frequency in the top bits, the pair's hash below.
            classes = np.log2(counts).astype(np.uint64)
            rank[live] = (classes << U64(58)) | (pairs >> U64(6)) | U64(1)
            r, left, right = rank[live], rank[self.prev[live]], rank[self.next[live]]
            # Of equal neighbours, as in a a a, every other one from the first.
            chained = np.append(False, (self.next[live[:-1]] == live[1:]) & (r[:-1] == r[1:]))
            index = np.arange(len(live))
            begin = np.maximum.accumulate(np.where(chained, 0, index))
            chosen = (r >= left) & (r >= right) & ((index - begin) % 2 == 0)
            at = live[chosen]
            gone = self.next[at]
            rank[at] = 0
            rank[gone] = 0
            self._replace(at, pairs[chosen])
            # Pairs that a replacement touches are new; a pair that does not repeat stays so.
            before = self.prev[at]
            live = np.unique(np.concatenate([live[self.alive[live]], before[before < n]]))
            live = live[self.next[live] < n]

    def _fold(self, n: int) -> None:
        """Halve what is left of every document, neighbour by neighbour, to one symbol."""
        places = np.flatnonzero(self.alive)
        while len(places):
            number = np.arange(len(places))
            begin = np.maximum.accumulate(np.where(self.prev[places] >= n, number, 0))
            left = places[((number - begin) % 2 == 0) & (self.next[places] < n)]
            self._replace(left, self._pairs(left))
            whole = (self.next[places] >= n) & (self.prev[places] >= n)
            places = places[self.alive[places] & ~whole]


class Repeats:
    """Longest common extensions of two places of a slice, by prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        up = np.full(len(words) + 1, _BASE, np.uint64)
        up[0] = 1
        self.up = np.cumprod(up, dtype=np.uint64)
        self.sums = np.append(U64(0), np.cumsum(words * self.up[:-1], dtype=np.uint64))

    def _equal(self, i, j, length):
        return (self.sums[i + length] - self.sums[i]) * self.up[j - i] == self.sums[j + length] - self.sums[j]

    def _longest(self, limit, equal):
        low, high = np.zeros(len(limit), np.int64), np.maximum(limit, 0)
        while (low < high).any():
            half = (low + high + 1) >> 1
            right = equal(half)
            low, high = np.where(right, half, low), np.where(right, high, half - 1)
        return low

    def extents(self, i, j, start, end):
        """The stretch around i and j, inside start to end, whose words equal those j - i on."""
        left = self._longest(i - start, lambda k: self._equal(i - k, j - k, k))
        right = self._longest(end - j, lambda k: self._equal(i, j, k))
        return i - left, j + right

    def exact(self, i: int, j: int, start: int, end: int, low: int, high: int) -> tuple[int, int]:
        """The same extent for one pair, by comparing words; low and high are what hashes gave."""
        w, q = self.words, j - i
        if np.array_equal(w[low:high - q], w[low + q:high]) and (low == start or w[low - 1] != w[low - 1 + q]) \
                and (high == end or w[high] != w[high - q]):
            return low, high
        same = w[start:end - q] == w[start + q:end]
        ahead, back = np.flatnonzero(~same[i - start:]), np.flatnonzero(~same[:i - start])
        return (int(start + back[-1] + 1) if len(back) else start,
                int(j + ahead[0]) if len(ahead) else end)


def _spread(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of low, low + 1, ... for ``count`` values of each row."""
    row = np.repeat(np.arange(len(low)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]


def boundary_runs(words, owner, start, middle, end, least: int, periods: int):
    """Runs over the boundaries of nodes, inside them: node, first word, end, smallest period."""
    gram = int(least * (periods - 2) / (2 * periods) + 1e-9)
    if gram < 1:
        raise ValueError("runs need at least three periods, and more words")
    n = len(words) - gram + 1
    none = [np.zeros(0, np.int64)] * 4
    if n <= 0 or not len(start):
        return none
    h = owner[:n].astype(np.uint64) * _RIGHT
    for k in range(gram):
        h *= U64(_BASE)
        h += words[k:n + k]
    order = np.argsort(mix(h), kind="stable")
    h = h[order]
    group = np.cumsum(np.append(False, h[1:] != h[:-1]))
    keys = group * (n + 1) + order
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # Returns of the words after the boundary, and of those before it.
    right = np.flatnonzero(middle <= end - gram)
    at = place[middle[right]]
    last = np.minimum(end - gram, middle + 2 * (end - middle) // periods)[right]
    low1, high1 = at + 1, np.searchsorted(keys, group[at] * (n + 1) + last, "right")
    left = np.flatnonzero(middle - gram >= start)
    at = place[middle[left] - gram]
    first = np.maximum(start, middle - gram - 2 * (middle - start) // periods)[left]
    low2, high2 = np.searchsorted(keys, group[at] * (n + 1) + first, "left"), at
    node = np.concatenate([right, left])
    low, count = np.concatenate([low1, low2]), np.maximum(np.concatenate([high1 - low1, high2 - low2]), 0)
    after = np.arange(len(node)) < len(right)
    some = count > 0
    node, low, count, after = node[some], low[some], count[some], after[some]
    if not len(node):
        return none
    repeats, found = Repeats(words), []
    begin = 0
    sums = np.cumsum(count)
    while begin < len(node):  # about a million candidates at a time
        stop = max(begin + 1, int(np.searchsorted(sums, sums[begin] - count[begin] + (1 << 20), "right")))
        row, index = _spread(low[begin:stop], count[begin:stop])
        row += begin
        k = node[row]
        other = order[index]
        i = np.where(after[row], middle[k], other + gram)
        j = np.where(after[row], other, middle[k])
        s, e = repeats.extents(i, j, start[k], end[k])
        good = np.flatnonzero(e - s >= np.maximum(least, periods * (j - i)))
        for x in good:
            lo, hi = repeats.exact(int(i[x]), int(j[x]), int(start[k[x]]), int(end[k[x]]), int(s[x]), int(e[x]))
            if hi - lo >= max(least, periods * int(j[x] - i[x])):
                found.append((int(k[x]), lo, hi, int(j[x] - i[x])))
        begin = stop
    if not found:
        return none
    node, s, e, q = np.array(found, np.int64).T
    order = np.lexsort((q, e, s, node))
    node, s, e, q = node[order], s[order], e[order], q[order]
    new = np.append(True, (node[1:] != node[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1]))
    return node[new], s[new], e[new], q[new]


def runs_of(words: np.ndarray, first: np.ndarray, least: int = MIN_WORDS, periods: int = MIN_PERIODS):
    """Document, start (from the document's first word), length and period of all runs, in order."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grammar = Grammar(words, first, least)
    order = np.argsort(grammar.symbol, kind="stable")
    symbol, place = grammar.symbol[order], grammar.start[order]
    new = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(symbol)))
    one = order[new]
    node, s, e, q = boundary_runs(words, owner, grammar.start[one], grammar.middle[one], grammar.end[one],
                                  least, periods)
    # To all places of the nonterminal.
    run, at = _spread(new[node], times[node])
    shift = place[at] - grammar.start[one][node][run]
    s, e, q = s[run] + shift, e[run] + shift, q[run]
    doc = owner[s] if len(s) else s
    # Of the stretches of one period that lie in one another the longest.
    order = np.lexsort((-e, s, q, doc))
    doc, s, e, q = doc[order], s[order], e[order], q[order]
    if len(s):
        group = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])))
        reach = np.maximum.accumulate(group * (len(words) + 1) + e)
        longest = np.append(True, group[1:] * (len(words) + 1) + e[1:] > reach[:-1])
        doc, s, e, q = doc[longest], s[longest], e[longest], q[longest]
        order = np.lexsort((q, e, s, doc))
        doc, s, e, q = doc[order], s[order], e[order], q[order]
        least_q = np.append(True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1]))
        doc, s, e, q = doc[least_q], s[least_q], e[least_q], q[least_q]
        order = np.lexsort((q, s, doc))
        doc, s, e, q = doc[order], s[order], e[order], q[order]
    return doc, s - first[doc], e - s, q


# --- documents ----------------------------------------------------------------------------------

def planted(doc_id, n: int) -> np.ndarray | None:
    """The words that the contract of the query puts in place of a document's; None for its own."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    own = np.arange(n)
    own[a:] = a + (own[a:] - a) % p
    return own


_SCHEMA = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
           "best struct<start: long, length: long, period: long>, collapsed_text string")
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def best_run(runs: list[tuple[int, int, int]]):
    """The run with the greatest length / period, compared exactly; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _named(run):
    return dict(zip(("start", "length", "period"), run)) if run else None


def periodic_runs(docs: DataFrame, reorder=None, least: int = MIN_WORDS, periods: int = MIN_PERIODS,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best run and the text with each run cut to its
    first period. ``reorder(doc_id, n)`` may give other words of the document in place of its own."""
    job_settings(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = part.column("doc_id").to_pylist()
                texts = Texts(part.column("text"), PLAIN)
                first, words = texts.first, texts.hashes()
                source = np.arange(len(words))
                moved = set()
                for t, key in enumerate(ids):
                    own = reorder(key, int(first[t + 1] - first[t])) if reorder else None
                    if own is not None:
                        source[first[t]:first[t + 1]] = first[t] + own
                        moved.add(t)
                doc, start, length, period = runs_of(words[source], first, least, periods)
                keep = np.ones(len(words), bool)
                runs = [[] for _ in ids]
                for d, s, k, q in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
                    runs[d].append((s, k, q))
                    keep[first[d] + s + q:first[d] + s + k] = False
                collapsed = []
                for t in range(len(ids)):
                    own = texts.text(t).split()
                    if runs[t] or t in moved:
                        at = source[first[t]:first[t + 1]][keep[first[t]:first[t + 1]]] - first[t]
                        own = [own[i] for i in at.tolist()]
                    collapsed.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(texts.counts, pa.int64()),
                     pa.array([[_named(r) for r in own] for own in runs], pa.list_(_RUN)),
                     pa.array([_named(best_run(own)) for own in runs], _RUN),
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "best", "collapsed_text"])

    return rows.mapInArrow(run, _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the best run and hashes of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
