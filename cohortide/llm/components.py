"""Connected components of links held in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortide.llm.storage import materialize

#: Links that one task contracts at a time.
LINKS_PER_TASK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the smallest node that it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        # Hook the root of the larger side to that of the smaller, then shorten all paths.
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            return nodes, nodes[root]


def contract(links: DataFrame) -> DataFrame:
    """The links of each task as a forest of depth one: ``a`` and its root ``b``, roots included."""

    def run(batches):
        node = root = np.zeros(0, np.int64)
        held = []
        for batch in batches:
            held.append(batch)
            if sum(r.num_rows for r in held) >= LINKS_PER_TASK:
                node, root = merge(node, root, held)
                held = []
        node, root = merge(node, root, held)
        for i in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[i:i + (1 << 16)]),
                                              pa.array(root[i:i + (1 << 16)])], ["a", "b"])

    def merge(node, root, held):
        return stars(np.concatenate([node, *[np.asarray(r.column("a")) for r in held]]),
                     np.concatenate([root, *[np.asarray(r.column("b")) for r in held]]))

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) of every node of ``links``.

    ``links``: a, b. Tasks of ``LINKS_PER_TASK`` links first contract what they hold to a forest.
    One such task settles everything. Where there are more, large-star and small-star steps
    alternate until nothing changes; each is two grouped minima, so a node of very many links is
    summed up before it is shuffled. Every round is written, which cuts the lineage.
    """
    pairs = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long"))
                        .where("a <> b"), "links")
    tasks = -(-pairs.count() // LINKS_PER_TASK)
    forest = materialize(contract(pairs.coalesce(max(1, tasks))), "forest")
    if tasks <= 1:
        return forest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    pairs = forest.where("a <> b").distinct()
    before = None
    while True:
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = low.select("a", F.col("m").alias("b")).unionByName(small).where("a <> b").distinct()
        pairs = materialize(new, "links")
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return (pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))
