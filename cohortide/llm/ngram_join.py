"""Similarity self-join of documents on the Jaccard index of their word n-grams.

1. Counting. Each task cuts its texts into chunks and sends the chunk's shingles, packed by hash
   bucket. A shingle of ``DENSE`` documents of a chunk is sent once, with their number; the documents
   that have it stay with the chunk. A bucket's task counts in how many documents each shingle is and
   sends back those of two or more. A document of which too few are shared can have no link and is
   settled.
2. Prefixes. Several global orders sort shingles by rarity class and then by a hash of their own.
   Two sets that link share a shingle among the first n - ceil(threshold * n) + 1 of each, under
   every order. Shingles of one document come first and never meet another's.
3. Linking. Equal sets are one vertex. Vertices that share a prefix shingle under the first order
   are a group. Some rounds check members against one pivot each. Then, wherever a group still holds
   several components, the members of the smaller are checked against the whole larger one. Every
   check first asks for shared prefix shingles under the other orders, then counts exactly. So all
   pairs between different components are covered, and pairs within one need no check.
4. Components of all links, spread to the copies.

No step brings a whole group together: checks run in cells of at most ``CELL`` by ``CELL`` vertices,
and what a group emits is links and (vertex, component) pairs, not pairs of members.

Cases: a null or empty text, or one without words, has no shingles and is its own component. A text
of fewer words than n has one shingle, the whole. Rows that repeat are vertices of one set and so
linked (unless empty). Rows without an id are left out. Other columns are not looked at.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortide.llm.components import components
from cohortide.llm.words import PLAIN, Texts, job_settings, mix, slices
from cohortide.llm.storage import materialize

N = 5
THRESHOLD = 80
#: Seeds of the global orders. The first makes candidates, the others filter them.
ORDERS = (1, 2, 3)
#: Text bytes whose shingles share a counting bucket.
BUCKET_BYTES = 12 << 20
#: Documents of a chunk from which on a shingle is added up before it is sent.
DENSE = 8
CELL = 256
PIVOT_ROUNDS = 2
#: Bits of a shingle's hash that are sent inside a bucket.
_LOW = 40
U64 = np.uint64


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every distinct shingle, sorted by owner."""
    words = texts.hashes()
    at, h = texts.window_hashes(n, words)
    owner = texts.owner()[at]
    for t in np.flatnonzero((texts.counts > 0) & (texts.counts < n)):
        own = words[texts.first[t]:texts.first[t + 1]]
        whole = np.array([len(own)], np.uint64)
        for i in range(len(own)):
            whole = mix(whole * U64(31) + own[i:i + 1])
        owner, h = np.append(owner, t), np.append(h, whole)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _rows(names, kinds, rows):
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


# What a packed row is: shingles one by one with their documents; the documents of a chunk; shingles
# that a chunk has added up, with numbers; and the documents of those.
ONE, HEAD, ADDED, HOLDERS = range(4)
_PACKED = ["bucket", "chunk", "kind", "body", "sizes", "ids"]
_PACKED_KINDS = [pa.int32(), pa.int64(), pa.int8(), pa.binary(), pa.binary(), pa.binary()]
_PACKED_SCHEMA = "bucket int, chunk long, kind tinyint, body binary, sizes binary, ids binary"


def _low_bytes(h: np.ndarray) -> np.ndarray:
    return (h & U64((1 << _LOW) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def pack(rows: DataFrame, n: int, bits: int, dense: int) -> DataFrame:
    """Chunks' shingles by bucket; and for each chunk a row with ids, set sizes and set hashes, and one
    with the documents of its dense shingles."""

    def run(batches):
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"), PLAIN, lower=True)
                if len(texts) > 1 << 16:
                    raise ValueError("a chunk numbers its documents in 16 bits")
                owner, h = shingle_sets(texts, n)
                counts = np.bincount(owner, minlength=len(texts))
                sums = np.append(U64(0), np.cumsum(mix(h ^ U64(0x5bd1e995)), dtype=np.uint64))
                ends = np.cumsum(counts)
                sets = mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))
                home = chunk % (1 << bits)
                out = [(home, chunk, HEAD, np.asarray(part.column("id")).tobytes(),
                        counts.astype(np.int64).tobytes(), sets.tobytes())]
                owner = owner.astype("<u2")
                order = np.argsort(h, kind="stable")
                own = h[order]
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(h)))
                many = times >= dense
                some = np.zeros(len(h), bool)
                some[order] = np.repeat(many, times)
                if many.any():
                    out.append((home, chunk, HOLDERS, own[new[many]].tobytes(),
                                owner[order][some[order]].tobytes(), times[many].astype("<u4").tobytes()))
                for kind, x, extra in ((ONE, h[~some], owner[~some]),
                                       (ADDED, own[new[many]], times[many].astype("<u4"))):
                    bucket = (x >> U64(64 - bits)).astype(np.int64)
                    # By bucket, and in it by document, which packs best.
                    by = np.argsort(bucket, kind="stable")
                    low, extra = _low_bytes(x[by]), extra[by]
                    edges = np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
                    for b in np.flatnonzero(np.diff(edges)):
                        i, j = edges[b], edges[b + 1]
                        out.append((int(b), chunk, kind, low[i:j].tobytes(), extra[i:j].tobytes(), None))
                yield _rows(_PACKED, _PACKED_KINDS, out)
                chunk += 1

    return rows.mapInArrow(run, _PACKED_SCHEMA)


def _unpack(bodies) -> np.ndarray:
    raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8")[:, 0]


def count_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket's shingles those in two or more documents, with rarity classes, by chunk."""
    rows = [r for r in zip(*(table.column(c).to_pylist() for c in _PACKED))]
    out = [r for r in rows if r[2] in (HEAD, HOLDERS)]
    rows = [r for r in rows if r[2] in (ONE, ADDED)]
    if rows:
        tokens = _unpack([r[3] for r in rows])
        weight = np.concatenate([np.frombuffer(r[4], "<u4").astype(np.int64) if r[2] == ADDED
                                 else np.ones(len(r[3]) // 5, np.int64) for r in rows])
        order = np.argsort(tokens, kind="stable")
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[order][1:] != tokens[order][:-1]
        start = np.flatnonzero(new)
        times = np.empty(len(tokens), np.int64)
        times[order] = np.repeat(np.add.reduceat(weight[order], start), np.diff(np.append(start, len(tokens))))
        kept = times >= 2
        rank = np.log2(np.maximum(times, 1)).astype(np.uint8)
        tokens |= U64(rows[0][0]) << U64(_LOW)
        at = 0
        for bucket, chunk, kind, body, extra, _ in rows:
            n = len(body) // 5
            k = kept[at:at + n]
            if k.any():
                out.append((bucket, chunk, kind, tokens[at:at + n][k].tobytes() + rank[at:at + n][k].tobytes(),
                            np.frombuffer(extra, "<u2")[k].tobytes() if kind == ONE else None, None))
            at += n
    return pa.Table.from_batches([_rows(_PACKED, _PACKED_KINDS, out)])


_SETS = ["doc_id", "set_id", "n", "shared", "common", "tokens", "prefix", "filters"]
_SETS_KINDS = [*[pa.int64()] * 5, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
_SETS_SCHEMA = ("doc_id long, set_id long, n long, shared long, common long, tokens binary, "
                "prefix array<long>, filters array<binary>")


def _orderings(orders):
    return [np.random.default_rng(s).integers(1, 1 << 63, dtype=np.uint64) for s in orders]


def assemble(threshold: int, orders, bits: int):
    """A function from a chunk's rows to its documents' sets and prefixes."""
    seeds = _orderings(orders)

    def counted(rows):
        """Tokens and rarity classes of rows that a bucket has sent back."""
        n_of = [len(r[3]) // 9 for r in rows]
        return (np.frombuffer(b"".join(r[3][:8 * k] for r, k in zip(rows, n_of)), np.uint64),
                np.frombuffer(b"".join(r[3][8 * k:] for r, k in zip(rows, n_of)), np.uint8))

    def run(table: pa.Table) -> pa.Table:
        by_kind = {k: [] for k in range(4)}
        for r in zip(*(table.column(c).to_pylist() for c in _PACKED)):
            by_kind[r[2]].append(r)
        head = by_kind[HEAD][0]
        ids, sizes = np.frombuffer(head[3], np.int64), np.frombuffer(head[4], np.int64)
        sets = np.frombuffer(head[5], np.int64)
        tokens, rank = counted(by_kind[ONE])
        owner = np.frombuffer(b"".join(r[4] for r in by_kind[ONE]), "<u2").astype(np.int64)
        for r in by_kind[HOLDERS]:
            # Their numbers come back apart, by the token that a bucket makes of a shingle.
            known, classes = counted(by_kind[ADDED])
            order = np.argsort(known)
            known, classes = known[order], classes[order]
            h, times = np.frombuffer(r[3], np.uint64), np.frombuffer(r[5], "<u4")
            own = (h & U64((1 << _LOW) - 1)) | ((h >> U64(64 - bits)) << U64(_LOW))
            tokens = np.concatenate([tokens, np.repeat(own, times)])
            rank = np.concatenate([rank, np.repeat(classes[np.searchsorted(known, own)], times)])
            owner = np.concatenate([owner, np.frombuffer(r[4], "<u2").astype(np.int64)])
        by = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[by], np.arange(len(ids) + 1))
        out = []
        for t in range(len(ids)):
            own, n = by[edges[t]:edges[t + 1]], int(sizes[t])
            if not n or 100 * len(own) < threshold * n:
                out.append((ids[t], sets[t], n, 0, 0, None, None, None))
                continue
            x, r = tokens[own], rank[own]
            # Of the prefix, what is left after the shingles that no other document has.
            p = n - -(-threshold * n // 100) + 1 - (n - len(own))
            firsts = [x[np.lexsort((mix(x ^ s), r))[:p]] for s in seeds]
            out.append((ids[t], sets[t], n, len(own), int(r.sum()), np.sort(x).tobytes(), firsts[0].astype(np.int64),
                        [np.sort(f).tobytes() for f in firsts[1:]]))
        return pa.Table.from_batches([_rows(_SETS, _SETS_KINDS, out)])

    return run


def document_sets(docs: DataFrame, n: int, threshold: int, orders, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    job_settings(spark)
    rows = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(4, min(20, ceil(log2(1 + size / BUCKET_BYTES))))
    shared = pack(rows, n, bits, DENSE).groupBy("bucket").applyInArrow(count_bucket, _PACKED_SCHEMA)
    return materialize(shared.groupBy("chunk").applyInArrow(assemble(threshold, orders, bits), _SETS_SCHEMA),
                       "shingle-sets")


# --- checks in cells ----------------------------------------------------------------------------

_CELL = ("target", "mblock", "qblock", "set_id", "n", "tokens", "filters")


def _inverted(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values of all parts, and the part of each."""
    values = np.frombuffer(b"".join(parts), np.uint64)
    owner = np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])
    order = np.argsort(values, kind="stable")
    return values[order], owner[order]


def _shared(index, x: np.ndarray, n: int) -> np.ndarray:
    """How many values of ``x`` each of the n parts holds."""
    values, owner = index
    a, b = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
    hit = np.flatnonzero(b > a)
    if not len(hit):
        return np.zeros(n, np.int64)
    lengths = (b - a)[hit]
    at = np.repeat(a[hit] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
    return np.bincount(owner[at], minlength=n)


def check_cells(threshold: int):
    """A function of (members, queries): a link for each query and target with a member near it."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        groups: dict = {}
        for side, table in enumerate((members, queries)):
            for r in zip(*(table.column(c).to_pylist() for c in _CELL)):
                groups.setdefault(r[:3], ([], []))[side].append(r[3:])
        a, b = [], []
        for own, asked in groups.values():
            if not own or not asked:
                continue
            sizes = np.array([m[1] for m in own], np.int64)
            index = _inverted([m[2] for m in own])
            filters = [_inverted([m[3][k] for m in own]) for k in range(len(own[0][3]))]
            for v, n, tokens, firsts in asked:
                fits = (100 * np.minimum(sizes, n) >= threshold * np.maximum(sizes, n))
                for f, first in zip(filters, firsts):
                    if not fits.any():
                        break
                    fits &= _shared(f, np.frombuffer(first, np.uint64), len(own)) > 0
                if not fits.any():
                    continue
                both = _shared(index, np.frombuffer(tokens, np.uint64), len(own))
                near = fits & (100 * both >= threshold * (sizes + n - both))
                if near.any():
                    a.append(v)
                    b.append(own[int(np.argmax(near))][0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def check(pairs: DataFrame, members: DataFrame, vertices: DataFrame, threshold: int) -> DataFrame:
    """Links between queries and targets. ``pairs``: v, target. ``members``: target, set_id."""
    pairs = materialize(pairs, "pairs")
    body = vertices.select("set_id", "n", "tokens", "filters")
    asked = pairs.groupBy("target").agg(F.count("*").alias("n_queries"))
    sizes = members.join(asked, "target", "left_semi").groupBy("target").agg(F.count("*").alias("n_members"))
    shape = asked.join(sizes, "target").select(
        "target", F.ceil(F.col("n_queries") / CELL).cast("int").alias("qblocks"),
        F.ceil(F.col("n_members") / CELL).cast("int").alias("mblocks"))
    shape = materialize(shape, "shapes")
    cells = shape.agg(F.sum(F.col("qblocks") * F.col("mblocks"))).head()[0] or 0
    rows = shape.agg(F.sum((F.col("qblocks") + F.col("mblocks")))).head()[0] or 0
    buckets = max(1, min(cells, max(pairs.count(), rows) // 200 + 1))
    # Both sides must hash one type.
    blocks = [F.col(c).cast("long") for c in ("target", "mblock", "qblock")]
    cell = F.pmod(F.xxhash64(*blocks), F.lit(buckets)).alias("cell")
    queries = (pairs.join(shape, "target")
               .withColumn("qblock", F.pmod(F.xxhash64("v"), "qblocks"))
               .join(body, F.col("v") == F.col("set_id")))
    queries = queries.withColumn("mblock", F.explode(F.sequence(F.lit(0), F.col("mblocks") - 1))).select(
        cell, *[F.col(c).alias(c) for c in _CELL])
    own = (members.join(shape, "target")
           .withColumn("mblock", F.pmod(F.xxhash64("set_id"), "mblocks"))
           .join(body, "set_id"))
    own = own.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1))).select(
        cell, *[F.col(c).alias(c) for c in _CELL])
    return materialize(own.groupBy("cell").cogroup(queries.groupBy("cell")).applyInArrow(
        check_cells(threshold), "a long, b long"), "found")


def may_link(n, shared, other_n, other_shared, threshold: int):
    """Whether two sets can reach the threshold if all that they share with any set is common.

    Holds for a whole component if the other set has its least size and largest shared part."""
    need = threshold * (F.col(n) + F.col(other_n))
    most = F.least(F.col(shared), F.col(other_shared))
    return (100 + threshold) * most >= need


def link(vertices: DataFrame, threshold: int) -> DataFrame:
    """node and root of every vertex that has a link."""
    own = ("set_id", "n", "shared", "common")
    first = materialize(vertices.select(*own, F.explode("prefix").alias("token")), "prefixes")
    busy = first.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    first = materialize(first.join(busy.select("token"), "token"), "prefixes")
    links, roots = None, None
    for r in range(PIVOT_ROUNDS + 1):
        rows = first.withColumn("root", F.col("set_id")) if roots is None else (
            first.join(roots, first["set_id"] == roots["node"], "left")
            .select(*own, "token", F.coalesce("root", "set_id").alias("root")))
        # The first pivot is the member of the most widespread shingles, often the copied text itself.
        rank = F.lit(0.0) if r else F.col("common") / F.col("n")
        mixed = rows.groupBy("token").agg(
            F.max(F.struct(rank, F.xxhash64(F.lit(r), "set_id"), *own, "root")).alias("p"),
            F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        if r < PIVOT_ROUNDS:
            fits = may_link("n", "shared", "p.n", "p.shared", threshold)
            near = (rows.join(mixed, "token").where((F.col("root") != F.col("p.root")) & fits)
                    .groupBy(F.col("set_id").alias("v"), F.col("p.set_id").alias("target"))
                    .agg(F.count("*").alias("k")))
            best = near.groupBy("v").agg(F.max(F.struct("k", "target")).alias("best"))
            pairs = best.select("v", F.col("best.target").alias("target"))
            members = pairs.select("target").distinct().withColumn("set_id", F.col("target"))
        else:
            # Members of a smaller component against the whole of a larger one.
            size = materialize(rows.select("root", "set_id").distinct().groupBy("root").agg(
                F.count("*").alias("size")), "sizes")
            left = materialize(rows.join(mixed.select("token"), "token", "left_semi").join(size, "root"),
                               "mixed")
            there = left.groupBy("token", F.col("root").alias("target"),
                                 F.col("size").alias("target_size")).agg(
                F.min("n").alias("least_n"), F.max("shared").alias("most_shared"))
            larger = (F.col("target_size") > F.col("size")) | (
                (F.col("target_size") == F.col("size")) & (F.col("target") > F.col("root")))
            fits = may_link("n", "shared", "least_n", "most_shared", threshold)
            pairs = (left.join(there, "token").where(larger & fits)
                     .select(F.col("set_id").alias("v"), "target").distinct())
            members = rows.select(F.col("root").alias("target"), "set_id").distinct()
        found = check(pairs, members, vertices, threshold)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    return roots


def similarity_components(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, orders=ORDERS,
                          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the component) of every row."""
    sets = document_sets(docs, n, threshold, orders, doc_id, text)
    vertices = materialize(
        sets.where("tokens is not null").groupBy("set_id").agg(
            *[F.first(c).alias(c) for c in _SETS[2:]]), "vertices")
    roots = link(vertices, threshold)
    named = (sets.select("doc_id", "set_id", "n").join(roots, F.col("set_id") == F.col("node"), "left")
             .select("doc_id", "n", F.coalesce("root", "set_id").alias("root")))
    lows = named.where("n > 0").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("low"))
    return named.join(lows, (F.col("root") == F.col("of")) & (F.col("n") > 0), "left").select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.coalesce("low", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Of each component one row, all columns; and every row without an id.

    A row is known by id and text, so an id on rows of unlinked texts keeps a row for each of them.
    The row kept is that of the smallest id, of several texts under it that of the least hash; of
    rows equal in both any one."""
    key = F.xxhash64(F.lit(11), F.col(doc_id).cast("string"), F.col(text))
    rows = docs.where(F.col(doc_id).isNotNull()).withColumn("key_of_row", key)
    plain = rows.select(F.col("key_of_row").alias("doc_id"), F.col(text).alias("text"))
    found = similarity_components(plain, **how).select(
        F.col("doc_id").alias("key"), F.col("component_id").alias("class")).distinct()
    ids = rows.groupBy("key_of_row").agg(F.first(doc_id).alias("id"))
    kept = found.join(ids, F.col("key") == F.col("key_of_row")).groupBy("class").agg(
        F.min(F.struct("id", "key")).alias("least")).select(F.col("least.key").alias("key"))
    rows = rows.join(kept, F.col("key_of_row") == F.col("key"), "left_semi").dropDuplicates(["key_of_row"])
    return rows.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
