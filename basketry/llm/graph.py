"""Connected components by large-star and small-star steps between local contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.scratch import ship, stored

EDGES = "u long, v long"


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: every node with the smallest node it reaches there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                root.setdefault(min(a, b), min(a, b))
    pairs = [(x, find(x)) for x in list(root)]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _is_stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    return seen.agg(F.max((F.col("up") + F.col("top") > 1).cast("int"))).first()[0] != 1


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of a link other than a component's smallest node, which is its name.

    Each round contracts the links of every partition to stars, then moves every node to the smallest node around
    it (large star) and ties smallest nodes together (small star), all as joins and grouped minima. A hub's links are
    spread by the join (Spark splits a skewed key) and minima are combined before the shuffle. Every round is
    written, so lineage stays short; the loop ends when all links are stars.
    """
    ship(links.sparkSession)
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    edges = stored(edges.mapInArrow(_contracted, EDGES), "links")
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = stored(small.mapInArrow(_contracted, EDGES), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
