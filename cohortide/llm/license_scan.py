"""License scan by diagonal voting.

All rolling word k-grams of all texts, hashed, are joined by Spark to the k-grams of the license
templates. A hit votes for the diagonal text position - template position. Votes are added up by
diagonal, neighbouring diagonals of a template are merged, and spans with enough votes are verified
word by word against the text.

The template table is given, so its size is too (``MAX_TEMPLATE_WORDS``); it is broadcast. Nothing
else is shuffled before the join but counts of hits. Texts are read a second time to verify: where
the rows with candidate spans are at most ``MAX_BROADCAST``, by broadcasting these, else by a join.

Cases: a null or empty text has no words and no spans. Rows equal in id and text are counted once
and all get the result. Texts shorter than k have no hits. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortide.llm.words import ALNUM, Texts, slices, job_settings
from cohortide.llm.storage import materialize

K = 2
#: Every place of these phrases is reported, under these labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that are found although some words differ.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 you may not use this file except "
                  "in compliance with the license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this "
           "software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Share of a template's words that a span must hold.
LEAST = 0.6
#: Diagonals so near each other are one span, as words may be left out or put in.
NEIGHBOURS = 3
MAX_TEMPLATE_WORDS = 1_000_000
MAX_BROADCAST = 100_000


def words_of(text: str) -> list[bytes]:
    t = Texts(pa.array([text]), ALNUM, lower=True)
    return [t.data[a:b].tobytes() for a, b in zip(t.starts, t.ends)]


def template_grams(spark, templates: dict[str, str], k: int) -> DataFrame:
    """gram, name, place and length of every k-gram of the templates."""
    rows = []
    for name, text in templates.items():
        t = Texts(pa.array([text]), ALNUM, lower=True)
        at, h = t.window_hashes(k)
        rows += [(int(x), name, int(i), len(t.starts)) for i, x in zip(at, h.view(np.int64))]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    return spark.createDataFrame(rows, "gram long, name string, place int, length int")


def text_grams(rows: DataFrame, k: int) -> DataFrame:
    """Every k-gram of every text; and for each text a row at -1 with its word count as the gram."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                t = Texts(part.column("text"), ALNUM, lower=True)
                at, h = t.window_hashes(k)
                owner = t.owner()[at]
                key = np.asarray(part.column("key"))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(np.concatenate([key[owner], key])),
                    "pos": pa.array(np.concatenate([at - t.first[owner], np.full(len(t), -1)])
                                    .astype(np.int32)),
                    "gram": pa.array(np.concatenate([h.view(np.int64), t.counts]))})

    return rows.mapInArrow(run, "key long, pos int, gram long")


def matched(words: list[bytes], template: list[bytes]) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and where its first and last word stand."""
    best = [(0, -1, -1)] * (len(template) + 1)
    for i, w in enumerate(words):
        left = (0, -1, -1)
        corner = best[0]
        for j, x in enumerate(template, 1):
            above = best[j]
            if w == x:
                n, first, _ = corner
                new = (n + 1, first if n else i, i)
            else:
                new = max(above, left, key=lambda c: (c[0], c[1]))
            corner, left, best[j] = above, new, new
    return best[-1]


def verify(rows: DataFrame, templates: dict[str, str], least: float, phrases: dict[str, str]) -> DataFrame:
    """Candidate spans that hold on the words themselves. ``rows``: key, text and spans."""
    known = {n: words_of(t) for n, t in templates.items()}

    def run(batches):
        for batch in batches:
            out = []
            texts = Texts(batch.column("text"), ALNUM, lower=True)
            for t, (key, spans) in enumerate(zip(batch.column("key").to_pylist(),
                                                 batch.column("spans").to_pylist())):
                a, b = texts.first[t], texts.first[t + 1]
                for s in spans:
                    want = known[s["name"]]
                    low, high = max(0, s["start"]), min(int(b - a), s["end"])
                    have = [texts.data[x:y].tobytes() for x, y in
                            zip(texts.starts[a + low:a + high], texts.ends[a + low:a + high])]
                    if s["name"] in phrases:
                        if have == want:
                            out.append((key, s["name"], low, high, 1.0))
                        continue
                    n, first, last = matched(have, want)
                    if n >= least * len(want):
                        out.append((key, s["name"], low + first, low + last + 1, n / len(want)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["key", "name", "start", "end", "score"])

    return rows.mapInArrow(run, "key long, name string, start int, end int, score double")


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None,
                  phrases: dict[str, str] | None = None, k: int = K, least: float = LEAST,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, n_words and spans (name, start, end in words, score)."""
    spark = docs.sparkSession
    job_settings(spark)
    phrases = PHRASES if phrases is None else phrases
    every = (TEMPLATES if templates is None else templates) | {p: p for p in phrases}
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn(
        "key", F.xxhash64(F.col("id").cast("string"), F.coalesce("text", F.lit(""))))
    grams = F.broadcast(template_grams(spark, every, k))
    hits = materialize(text_grams(rows.select("key", "text"), k).join(grams, "gram", "left")
                       .where((F.col("pos") == -1) | F.col("name").isNotNull()), "hits")
    votes = (hits.where("pos >= 0").groupBy("key", "name", "length",
                                            (F.col("pos") - F.col("place")).alias("diagonal"))
             .agg(F.countDistinct("place").alias("votes")))
    whole = F.col("length") - k + 1
    is_phrase = F.col("name").isin(list(phrases))
    exact = votes.where(is_phrase & (F.col("votes") == whole)).select(
        "key", "name", F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("length")).alias("end"))
    by_name = Window.partitionBy("key", "name").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_name) > NEIGHBOURS
    loose = (votes.where(~is_phrase).withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
             .withColumn("run", F.sum("apart").over(by_name))
             .groupBy("key", "name", "length", "run")
             .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"),
                  F.max("diagonal").alias("high"))
             # Each wrong word spoils k grams.
             .where(F.col("votes") >= F.greatest(
                 F.lit(1), F.ceil(whole - k * (1 - F.lit(least)) * F.col("length"))))
             .select("key", "name", F.col("low").alias("start"),
                     (F.col("high") + F.col("length")).alias("end")))
    found = materialize(exact.unionByName(loose).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("name", "start", "end"))).alias("spans")), "spans")
    once = found.withColumnRenamed("key", "of")
    if found.count() <= MAX_BROADCAST:
        once = F.broadcast(once)
    good = verify(rows.join(once, F.col("key") == F.col("of")).select("key", "text", "spans"),
                  every, least, phrases)
    spans = good.groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "name", "score"))).alias("spans"))
    sizes = hits.where("pos = -1").groupBy("key").agg(F.max("gram").alias("n_words"))
    return (rows.select("id", "key").join(sizes, "key").join(spans, "key", "left")
            .select(F.col("id").alias(doc_id), "n_words", F.coalesce("spans", F.array().cast(
                spans.schema["spans"].dataType)).alias("spans")))


def digest(spans: DataFrame, phrases: dict[str, str] | None = None, doc_id: str = "doc_id") -> DataFrame:
    phrases = PHRASES if phrases is None else phrases
    label = F.create_map(*[F.lit(x) for p in phrases.items() for x in p])
    base = F.filter("spans", lambda s: s["name"].isin(list(phrases)))
    named = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(
        rows, lambda s: F.coalesce(label[s["name"]], s["name"])))), ",")
    return spans.select(
        doc_id, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base)["start"].cast("long").alias("first_word"),
        F.array_max(base)["start"].cast("long").alias("last_word"),
        named(base).alias("base_labels"), named(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
        .alias("score"))
