"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fitgauge.llm.shared import stored


def _stars(pairs: DataFrame) -> DataFrame:
    """Hooks every neighbour ``v`` of ``u`` to the least node around ``u``. Rows: u, v; a node may be hot.

    The least neighbour is a partial aggregate; the join back to the neighbours is one that adaptive execution can split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has two bigint columns ``u``, ``v``. Returns ``node``, ``root`` (least node of its component) for every
    node of an edge, roots included. Loops and repeated edges count once; without edges the result is empty.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        hooked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = small.select("u", F.col("m").alias("v"))
        edges = stored(hooked.union(kept).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
