"""Token ids of documents in Parquet list columns, and reads of single columns back.

A folder of token files holds rows in ascending id order: ``doc_id``, ``ids`` (list of int),
``n_tokens``, ``part`` (number of its file) and ``local_start`` (ids of earlier rows of that file).
Ids are dictionary encoded, as they take few values; the others are delta encoded (writer version
2). Row groups and pages have set sizes and page indexes, so a read of some documents, or of the
counts alone, touches only their pages. A global start needs only the counts: the sum over earlier
files, one row a file, plus ``local_start``.

Rows are range partitioned by id before they are encoded, so what is shuffled is text; each task
encodes its range in order and writes one file by Spark's own committer, so a lost executor costs
a task.

Cases: a null or empty text gives the end id alone. A null id sorts first. Repeated rows and ids
are written as often as they come, ordered by text. Other columns are not looked at. An empty table
gives a folder without ids.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.llm.words import PLAIN, Texts, job_settings, slices
from cohortide.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker keeps the ids of, about 30 bytes each, and runs of letters, about 150 bytes
#: each, in each of two generations.
KNOWN = 1_000_000
PARTS = 40_000
#: Words of so many characters go through the whole tokenizer.
LONG = 64
SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, local_start long"

#: One run of letters that normalisation only lower-cases, then perhaps marks (no apostrophe, which
#: may begin a contraction): a text piece whose ids can be looked up in two parts.
_SIMPLE = re.compile(r"([A-Za-zÄÖÜßÀ-ÂÇ-ÏÑ-ÔÙ-Ûà-âäç-ïñ-ôöù-ûü]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known:
    """Ids of known words, by the words' 64-bit hashes, in sorted arrays.

    New words go to a small table that is merged into the large one as it grows. Beyond ``KNOWN``
    words the large table is dropped and the small one goes on."""

    def __init__(self):
        self.tables = [self._empty(), self._empty()]
        self.pool = np.zeros(0, np.int32)

    @staticmethod
    def _empty():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is known, where its ids begin in ``pool``, and how many they are."""
        known = np.zeros(len(hashes), bool)
        start, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for own, starts, sizes in self.tables:
            if len(own):
                at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                hit = own[at] == hashes
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
                known |= hit
        return known, start, size

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Words that are not known yet: their ids one after the other, and how many each has."""
        start = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, ids])
        self.tables[1] = self._merged(self.tables[1], (hashes, start, size))
        if len(self.tables[1][0]) > max(1 << 15, len(self.tables[0][0]) // 4):
            if len(self.tables[0][0]) > KNOWN:
                keep = self.tables[1]
                first = int(keep[1].min())  # of the pool only what the small table points to
                self.pool = self.pool[first:]
                self.tables = [(keep[0], keep[1] - first, keep[2]), self._empty()]
            else:
                self.tables = [self._merged(*self.tables), self._empty()]

    @staticmethod
    def _merged(a, b):
        order = np.argsort(both := np.concatenate([a[0], b[0]]), kind="stable")
        return both[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:]))


class Encoder:
    """Encodes the words of many texts at once, words being what ASCII white space separates.

    Exact for tokenizers that drop white space and never join across it; ``by_piece`` tells. Others
    encode whole texts. Words are hashed and looked up in arrays; of those not known yet, one run of
    letters with perhaps a mark behind it goes to the model straight, all others through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.letters = byte_letters()
        self.known = Known()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probe = "Ab, c.d 'll  \n\té1 x"
        self.by_piece = self._whole(probe) == b"".join(map(self._whole, probe.split()))
        words = ("abc", "über", "señal", "ça")
        self.simple = self.by_piece and all(self._word(w) == self._whole(w) for w in words)

    def _whole(self, text: str) -> bytes:
        return array("i", self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _part(self, key: str, make) -> bytes:
        """Ids of a run of letters or of marks, which many words share."""
        ids = self.new.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is None:
                ids = make(key)
            if len(self.new) >= PARTS:
                self.old, self.new = self.new, {}
            self.new[key] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """Its ids as 32-bit integers."""
        if self.simple and len(piece) < LONG and (m := _SIMPLE.fullmatch(piece)):
            ids = self._part(m[1].lower(), self._word)
            return ids + self._part(m[2], self._whole) if m[2] else ids
        return self._whole(piece)

    def encode(self, texts: pa.Array, tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each ended by ``tail``; and how many each has."""
        if not self.by_piece:
            end = array("i", tail).tobytes()
            ids = [self._whole(t or "") + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        words = Texts(texts, PLAIN)
        distinct, at, index = np.unique(words.hashes(), return_index=True, return_inverse=True)
        known, start, size = self.known.find(distinct)
        if not known.all():
            new = np.flatnonzero(~known)
            body = words.data.tobytes()
            ids = [self.piece(body[a:b].decode()) for a, b in
                   zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist())]
            # Held apart, as adding may drop words that were found before.
            base, own = len(self.known.pool), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            size[new], start[new] = own, base + np.cumsum(own) - own
            fresh = np.frombuffer(b"".join(ids), np.int32)
            pool = np.concatenate([self.known.pool, fresh])
            self.known.add(distinct[new], fresh, own)
        else:
            pool = self.known.pool
        # Every text ends in a word of its own, the tail.
        start, size = np.append(start, len(pool)), np.append(size, len(tail))
        pool = np.concatenate([pool, np.array(tail, np.int32)])
        order = np.insert(index, words.first[1:], len(distinct))
        size, start = size[order], start[order]
        ends = np.cumsum(size)
        flat = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        last = ends[words.first[1:] + np.arange(len(words))] if len(words) else ends
        return flat, np.diff(last, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of token files, each partition a range of ids in ascending order."""
    spark = docs.sparkSession
    job_settings(spark)
    path = tokenizer or tokenizer_path()
    tail = [] if end_id is None else [end_id]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
               .withColumn("part", F.spark_partition_id()))
    names = ["doc_id", "ids", "n_tokens", "part", "local_start"]

    def run(batches):
        code, before = encoder(path), 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                flat, n = code.encode(batch.column("text"), tail)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), lists, pa.array(n), batch.column("part"),
                     pa.array(before + ends - n)], names)
                before += int(ends[-1])

    return ordered.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, row_group_bytes: int = 16 << 20,
                 page_bytes: int = 64 << 10, codec: str = "zstd", **encode) -> None:
    """Encode ``docs`` and write the token files. ``encode``: see ``encode_documents``."""
    writer = (encode_documents(docs, **encode).write.mode("errorifexists")
              .option("compression", codec).option("parquet.writer.version", "v2")
              .option("parquet.block.size", row_group_bytes)
              .option("parquet.page.size", page_bytes)
              .option("parquet.enable.dictionary", "true"))
    for column in ("doc_id", "n_tokens", "part", "local_start"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns=("doc_id", "ids", "n_tokens", "start")):
    """Chosen columns of token files; ``start`` counts the ids of all earlier documents."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if "start" not in columns:
        return rows.select(*columns)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a file, so the sums are as bounded as the number of files.
    sums, before = {}, 0
    for part, n in sorted(map(tuple, files.collect())):
        sums[part], before = before, before + n
    base = spark.createDataFrame(list(sums.items()) or [(-1, 0)], "part int, base long")
    return (rows.join(F.broadcast(base), "part")
            .withColumn("start", F.col("base") + F.col("local_start")).select(*columns))


def checksums(rows: DataFrame) -> DataFrame:
    """Adds the unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    job_settings(rows.sparkSession)
    names = [*(c for c in rows.columns if c != "ids"), "ids_crc32"]

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            at = np.asarray(ids.offsets)
            flat = np.ascontiguousarray(np.asarray(ids.values), "<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:-1]), pa.array(crc, pa.int64())], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names))


def token_digest(docs: DataFrame, **encode) -> DataFrame:
    """Write token files to the shared folder and report on what they hold."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **encode)
    rows = read_tokens(docs.sparkSession, path)
    return checksums(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
