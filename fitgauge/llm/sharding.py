"""Histogram sort: shards of equal bytes, cut at key boundaries that histograms find.

The order is a 60-bit hash of the text, then one of the id, then one of the row's position; equal texts stand together.
Rounds count exact bytes and rows below candidate boundaries: each round splits only the candidate intervals that hold a
wanted cut, by 12 further bits of the key, until a cut is within the tolerance or its interval holds a single row. Then every
row's place follows from the cuts, and rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fitgauge.llm.shared import packed, unpacked, stored, text_bytes

#: Bits of the key that one round tells apart, and rounds for each of the three 60-bit key columns.
STEP_BITS, STEPS = 12, 5
KEYS = ("_k1", "_k2", "_k3")
#: Shards larger than this are cut into parts of about this size, each sorted by a task of its own.
PART_BYTES = 256 << 20


def hash60(value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Cut:
    """Rows whose key digits are below ``digits`` (compared over its length) come before the cut."""

    digits: tuple[int, ...]
    rows: int


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "_size": text_bytes() + 16,
        "_k1": hash60(F.col("text")),
        "_k2": hash60(F.col("doc_id")),
        "_k3": hash60(F.monotonically_increasing_id()),
    })


def _digit(level: int) -> Column:
    shift = STEP_BITS * (STEPS - 1 - level % STEPS)
    return F.shiftright(F.col(KEYS[level // STEPS]), shift).bitwiseAND(F.lit((1 << STEP_BITS) - 1))


def _prefix(level: int) -> Column:
    return F.concat_ws(",", *(_digit(i) for i in range(level)))


def find_cuts(sizes: DataFrame, pieces: int, tolerance: float = 0.0) -> list[Cut]:
    """The ``pieces - 1`` cuts: the first key with ``i / pieces`` of all bytes before it, within ``tolerance`` times the bytes
    of a piece. At most one histogram of 4096 cells for each open cut reaches the driver in a round."""
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    cuts: list[Cut | None] = [None] * (pieces - 1)
    open_ = {i: ((), 0, 0) for i in range(pieces - 1)}  # cut -> digits of its interval, bytes and rows before that
    for level in range(STEPS * len(KEYS)):
        inside = {digits for digits, _, _ in open_.values()}
        if not inside or not total:
            break
        rows = sizes
        if level:
            rows = sizes.where(_prefix(level).isin([",".join(map(str, d)) for d in inside]))
        cells = rows.groupBy(_prefix(level).alias("prefix") if level else F.lit("").alias("prefix"), _digit(level).alias("digit")).agg(
            F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
        histograms: dict[str, list] = {}
        for c in cells:
            histograms.setdefault(c.prefix, []).append((c.digit, c.bytes, c.rows))
        for h in histograms.values():
            h.sort()
        left = {}
        for i, (digits, bytes_, count) in open_.items():
            target = total * (i + 1)  # in units of 1 / pieces
            for digit, size, n in histograms[",".join(map(str, digits))]:
                if (bytes_ + size) * pieces < target:
                    bytes_, count = bytes_ + size, count + n
                    continue
                # the last row before the wanted cut lies in this cell
                if n == 1 or size * pieces <= tolerance * total or level == STEPS * len(KEYS) - 1:
                    cuts[i] = Cut((*digits, digit + 1), count + n)
                else:
                    left[i] = ((*digits, digit), bytes_, count)
                break
        open_ = left
    return [c or Cut((0,), 0) for c in cuts]


def _boundary(cut: Cut) -> list[int]:
    """The cut as values of the three key columns; -1 where it does not look further."""
    values = []
    for k in range(len(KEYS)):
        digits = cut.digits[k * STEPS : (k + 1) * STEPS]
        value = 0
        for d in digits:
            value = (value << STEP_BITS) + d
        values.append(value << STEP_BITS * (STEPS - len(digits)) if digits else -1)
    return values


def _place(cuts: list[Cut]) -> Column:
    """How many cuts lie at or before the row, by binary search."""
    if not cuts:
        return F.lit(0)
    sides = [F.array(*map(F.lit, side)) for side in zip(*map(_boundary, cuts))]
    key = F.struct(*(F.col(k) for k in KEYS))

    def halved(range_: Column, _: Column) -> Column:
        mid = F.shiftright(range_["low"] + range_["high"], 1)
        cut = F.struct(*(F.get(side, mid).alias(k) for k, side in zip(KEYS, sides)))
        open_, below = range_["low"] < range_["high"], key < cut
        return F.struct(
            F.when(open_ & ~below, mid + 1).otherwise(range_["low"]).alias("low"),
            F.when(open_ & below, mid).otherwise(range_["high"]).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), whole, halved, lambda r: r["low"])


def sharded(docs: DataFrame, shards: int = 40, tolerance: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Law: bytes. A shard's bytes are UTF-8 bytes of its texts plus 16 a row (null text: none). Shard i starts at the first key
    with i / ``shards`` of all bytes before it, so that with tolerance 0 a shard is off by less than its last document.
    Columns ``shard`` and ``slot`` of the input are replaced, all others kept. Equal texts are neighbours; a group of them is
    divided only where a cut falls into it. Repeated rows are told apart by their position, so ``docs`` has to be a table
    that gives rows in the same order when it is read again. An empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    columns, docs = docs.columns, with_keys(packed(docs))
    sizes = stored(docs.select("_size", *KEYS), "sizes")
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    parts = max(1, -(-total // (shards * part_bytes)))
    cuts = find_cuts(sizes, shards * parts, tolerance)
    starts = [0, *(c.rows for c in cuts)]
    first = [starts[i] - starts[i // parts * parts] for i in range(shards * parts)]
    order = Window.partitionBy("_part").orderBy(*KEYS)
    placed = docs.withColumn("_part", _place(cuts).cast("int")).withColumn("_row", F.row_number().over(order) - 1)
    base = F.lit(0).cast("long") if parts == 1 else F.element_at(F.array(*map(F.lit, first)), F.col("_part") + 1).cast("long")
    placed = placed.withColumns({"shard": F.floor(F.col("_part") / parts).cast("int"), "slot": base + F.col("_row")})
    return unpacked(placed.drop("_size", *KEYS, "_part", "_row"), columns)
