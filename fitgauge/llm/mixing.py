"""Mixes sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fitgauge.llm.shared import packed, text_bytes, unpacked

#: Means above this are drawn as a sum of independent parts, so that exp(-mean) stays a normal number.
LARGEST_MEAN = 256
#: With at most so many sources their rates are sent to every executor (a name and a number each).
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons; null counts as empty."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(mean: Column, seed: int, *key: Column) -> Column:
    """The Poisson quantile of the key's hashed number: the least k whose cumulative probability exceeds it."""
    parts = F.greatest(F.ceil(mean / LARGEST_MEAN).cast("int"), F.lit(1))
    share = mean / parts

    def draw(part: Column) -> Column:
        u = uniform(F.lit(seed), part, *key)
        last = F.ceil(share + 12 * F.sqrt(share) + 40).cast("int")  # beyond it lies less than 2 ** -52
        first = F.struct(F.exp(-share).alias("p"), F.exp(-share).alias("c"), F.lit(0).alias("n"))

        def step(a: Column, k: Column) -> Column:
            p = a["p"] * share / k
            return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.when(a["c"] <= u, k).otherwise(a["n"]).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda a: a["n"])

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda total, part: total + draw(part))


def tempered_rates(docs: DataFrame, exponent: float = 0.5, budget: float = 1.0, by: str = "source") -> DataFrame:
    """``by``, ``rate``: mean repetitions that give each source a weight in proportion to its bytes to the power ``exponent``,
    for ``budget`` times the bytes of the input in all. A source without bytes gets rate 0."""
    sizes = docs.groupBy(F.col(by).alias("group")).agg(F.sum(text_bytes()).cast("double").alias("size"))
    weights = F.sum(F.when(F.col("size") > 0, F.pow("size", F.lit(exponent))))
    whole = sizes.agg(F.struct(F.sum("size").alias("all"), weights.alias("weights")))
    sizes = sizes.withColumn("whole", whole.scalar())
    share = F.pow("size", F.lit(exponent)) / F.col("whole.weights")
    rate = F.when(F.col("size") > 0, F.col("whole.all") * budget * share / F.col("size"))
    return sizes.select(F.col("group").alias(by), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def replicated(docs: DataFrame, rates: DataFrame, seed: int = 42, by: str = "source") -> DataFrame:
    """Each document as often as its Poisson count says, in one global random order.

    ``rates`` has ``by`` and ``rate`` (null sources have a row too); a source without rate is left out. Adds ``copy`` (from
    1) and ``shuffle_key`` (bigint, the order) to the columns of ``docs``, replacing columns of those names; columns of all other names stay. The count
    depends on seed and ``doc_id`` alone: repeated rows get equal counts, a null id counts as empty. Empty and null texts
    are documents like others. An empty table gives an empty result.
    """
    named = rates.select(F.col(by).alias("_group"), F.col("rate").cast("double").alias("_rate"))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = F.broadcast(named) if few else named
    docs = docs.drop("copy", "shuffle_key")
    columns, docs = docs.columns, packed(docs, by)
    drawn = docs.join(named, docs[by].eqNullSafe(F.col("_group"))).withColumn(
        "_count", poisson_count(F.col("_rate"), seed, F.col("doc_id")))
    copies = drawn.where("_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy"), F.lit("order"))
    key = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    copies = copies.select(*(F.col(f"`{c}`") for c in docs.columns), "copy", key.alias("shuffle_key"))
    return unpacked(copies.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy"), columns)
