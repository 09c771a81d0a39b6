"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits by its own quantiles, the curve index of the
cell is computed with shifts and two small tables, rows are sorted by it, and the order is
cut into runs of equal length. A shard then covers a small box of every dimension, so
that file statistics prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundspark.llm.common import POSITION, positioned, stage

ACCURACY = 1_000_000


def text_cuts(df: DataFrame, name: str, bits: int) -> list[str]:
    """The cut points of a string column: of whole values in code-point order, those at which the rows
    so far reach a further multiple of 2**-bits of all, once for each; fewer than 2**bits.

    Only distinct values with their counts are sorted, in ranges.
    """
    counts = stage(df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")), "values")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    placed = stage(
        counts.repartitionByRange("value").sortWithinPartitions("value").withColumns(
            {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
        ),
        "placed",
    )
    # One row per range: the only window without a key.
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = placed.groupBy("part").agg(F.sum("n").alias("rows")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("within", F.sum("n").over(within)).join(F.broadcast(ranges), "part")
    # In whole numbers: the multiples reached with this value and without it.
    cells, to = 1 << bits, F.col("before") + F.col("within")
    reached = F.least(F.floor(to * cells / F.lit(total)), F.lit(cells - 1))
    new = (reached - F.floor((to - F.col("n")) * cells / F.lit(total))).alias("times")
    return sorted(value for value, n in summed.select("value", new).filter("times > 0").collect() for _ in range(n))


def _below(points: Column, value: Column) -> Column:
    return F.size(F.filter(points, lambda x: x < value))


def quantised(df: DataFrame, dimensions: list[str], bits: int) -> dict[str, Column]:
    """For each dimension the number of its cut points that lie below the value.

    Cut points are the quantiles at multiples of 2**-bits, at most 2**bits - 1 values a
    dimension; one that many rows share counts as often as it occurs, so that a dimension of few
    values reaches over all cells, too. Strings are compared as a whole. NULL and NaN are cell 0.
    """
    shares, kinds = [i / (1 << bits) for i in range(1, 1 << bits)], dict(df.dtypes)
    texts = {n: F.col(n) for n in dimensions if kinds[n] == "string"}
    numbers = {n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in dimensions if n not in texts}
    cuts: dict[str, list] = {n: text_cuts(df, n, bits) for n in texts}
    if numbers:
        found = df.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(n) for n, c in numbers.items()]).first()
        cuts |= {n: [float(x) for x in sorted(found[n] or [])] for n in numbers}
    cells = {}
    for name in dimensions:
        value = texts[name] if name in texts else numbers[name]
        points = F.array(*map(F.lit, cuts[name])).cast(f"array<{'string' if name in texts else 'double'}>")
        cells[name] = F.coalesce(F.when(value.isNotNull(), _below(points, value)), F.lit(0)).cast("long")
    return cells


def _curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For state (entry, direction) and the coordinates' bits: the place on the curve and the next state.

    The rules are those of Hamilton and Rau-Chaplin, "Compact Hilbert indices" (2008).
    """
    size = 1 << n
    full = size - 1
    turn = lambda x, k: ((x >> (k % n)) | (x << (n - k % n))) & full
    gray = lambda x: x ^ (x >> 1)
    back = {gray(x): x for x in range(size)}
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    way = lambda w: 0 if w == 0 else (ones(w) if w % 2 else ones(w - 1)) % n
    place, after = [], []
    for e in range(size):
        for d in range(n):
            for bits in range(size):
                w = back[turn(bits ^ e, d + 1)]
                place.append(w)
                after.append((e ^ turn(entry(w), n - (d + 1) % n)) * n + (d + way(w) + 1) % n)
    return place, after


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index of a cell on the Hilbert curve of ``len(cells)`` dimensions and ``bits`` levels."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the index has to fit into 62 bits")
    place, after = (F.array(*[F.lit(x) for x in t]) for t in _curve_tables(n))

    def level(state: Column, i: Column) -> Column:
        bit = F.lit(0).cast("long")
        for j, cell in enumerate(cells):
            bit = bit + F.call_function("shiftright", cell, i).bitwiseAND(F.lit(1)) * (1 << j)
        slot = (state["state"] * (1 << n) + bit).cast("int")
        return F.struct(
            F.element_at(after, slot + 1).cast("long").alias("state"),
            (state["index"] * (1 << n) + F.element_at(place, slot + 1)).alias("index"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("index"))
    levels = F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)])
    return F.aggregate(levels, zero, level, lambda s: s["index"])


def hilbert_shards(
    df: DataFrame, dimensions: list[str], tie: list[str], shards: int = 8, bits: int = 6
) -> DataFrame:
    """``df`` with ``curve_index``, ``shard`` and ``slot``.

    Rows are ordered by curve index, then by the columns ``tie``; shard counts differ by one
    at most and slots are gapless from 0 in each shard. Rows that agree in all these columns
    may swap places; a hot cell is spread like any run of rows. NULLs form cell 0 of their
    dimension. An empty table gives no rows. Other columns pass through, except those named
    like the three new ones, which are replaced.
    """
    new = ["curve_index", "shard", "slot"]
    kept = [c for c in df.columns if c not in new]
    cells = quantised(df, dimensions, bits)
    indexed = df.select(*kept, *[c.alias(f"_cell_{n}") for n, c in cells.items()]).select(
        *kept, hilbert_index([F.col(f"_cell_{n}") for n in cells], bits).alias("curve_index")
    )
    placed = positioned(indexed, F.col("curve_index"), *[F.col(c) for c in tie])
    total = placed.count()
    short, longer = divmod(total, shards)
    # The first `longer` shards hold one row more.
    border = longer * (short + 1)
    at = F.col(POSITION)
    rest = F.lit(0) if not short else F.floor((at - border) / short) + longer
    shard = F.when(at < border, F.floor(at / (short + 1))).otherwise(rest).cast("int")
    first = F.col("shard") * short + F.least(F.col("shard"), F.lit(longer))
    return placed.withColumn("shard", shard).withColumn("slot", at - first).drop(POSITION)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Store each shard as a folder of Parquet files in slot order.

    A file is a run along the curve, so that its statistics are narrow in every dimension and
    filters on any of them skip files. Rows are written by the tasks that read them.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
