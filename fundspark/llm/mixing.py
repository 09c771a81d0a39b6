"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (one per combination of the dimensions) with their tokens.
Raking scales the cells until the marginal of every dimension meets its target; the ratio of
raked to present tokens is a cell's weight. Documents are then sampled with a probability in
proportion to the weight, capped at 1 and calibrated so that the expected tokens meet the
budget. All that loops works on cells, whose number follows the categories and not the rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundspark.llm.common import stage

#: The gap at which raking ends.
TOLERANCE = 1e-12
#: Raking fails when it needs more rounds, and has settled when no share moves by more.
ROUNDS, SETTLED = 50_000, 2.0**-52
#: So many cells are raked in one task; more are raked by windows, written every few rounds.
TOGETHER = 50_000
STEPS = 4
CAPPING_ROUNDS = 20
_RANGE = 1 << 32


def cells_of(docs: DataFrame, dimensions: list[str], tokens: str) -> DataFrame:
    """The present tokens of each cell; NULL categories are categories of their own."""
    named = [F.col(d).alias(d) for d in dimensions]
    return docs.groupBy(*named).agg(F.sum(tokens).cast("double").alias("present"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets in proportion to each category's tokens to a power below 1: small ones gain."""
    return cells.groupBy(dimension).agg(F.pow(F.sum("present"), F.lit(power)).alias("target"))


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    iterations: int = ROUNDS,
    tolerance: float = TOLERANCE,
    together: int = TOGETHER,
) -> DataFrame:
    """``cells`` with ``share``: their raked part of all tokens.

    ``targets`` maps a dimension to a frame (dimension, target) of positive numbers; they are
    scaled to the categories that occur, and categories without a target get no share. Ends
    when no marginal was off by more than ``tolerance``. Targets that contradict each other on
    the cells that occur leave a gap that no round closes: when the shares stand still
    there is a warning with the gap. Anything else that is not met after so many
    iterations is an error. Up to ``together`` cells are raked in one task.
    """
    whole = cells.agg(F.sum("present")).first()[0] or 1.0
    raked = cells.withColumn("share", F.col("present") / F.lit(whole))
    for d, target in targets.items():
        there = cells.select(F.col(d).alias("_d")).distinct().join(
            target.select(F.col(d).alias("_c"), F.col("target").cast("double").alias(f"_t_{d}")), F.col("_d").eqNullSafe(F.col("_c"))
        )
        there = stage(there.select("_d", f"_t_{d}"), "targets")
        scale = there.agg(F.sum(f"_t_{d}")).first()[0] or 1.0
        raked = raked.join(there.withColumn(f"_t_{d}", F.col(f"_t_{d}") / F.lit(scale)), F.col(d).eqNullSafe(F.col("_d")), "left").drop("_d")
    raked = stage(raked, "raked")
    found = _in_one_task if raked.count() <= together else _by_windows
    raked, gap, moved = found(raked, list(targets), iterations, tolerance)
    if gap > tolerance:
        if moved > SETTLED:
            raise ArithmeticError(f"a marginal is still off by {gap:.3g} after {iterations} rounds of raking")
        warnings.warn(f"the targets contradict each other on these cells: a marginal stays off by {gap:.3g}", stacklevel=2)
    return raked.select(*cells.columns, "share")


def _in_one_task(raked: DataFrame, dimensions: list[str], iterations: int, tolerance: float) -> tuple[DataFrame, float, float]:
    """Raked cells, the largest gap and the largest move of the last round; all rounds are one expression."""
    placed = raked.coalesce(1)
    for i, d in enumerate(dimensions):
        placed = placed.withColumn(f"_c{i}", F.dense_rank().over(Window.orderBy(d)) - 1)
    codes = [f"_c{i}" for i in range(len(dimensions))]
    placed = stage(placed.withColumn("_at", F.row_number().over(Window.orderBy(*codes)) - 1), "placed").coalesce(1)
    row = placed.agg(F.sort_array(F.collect_list(F.struct("_at", *codes, *raked.columns))).alias("_cells"))
    for i, d in enumerate(dimensions):
        # Of each category its number, its target and the places of its cells.
        kinds = placed.groupBy(f"_c{i}").agg(
            F.coalesce(F.first(f"_t_{d}"), F.lit(0.0)).alias("aim"), F.sort_array(F.collect_list("_at")).alias("places")
        )
        row = row.crossJoin(kinds.agg(F.sort_array(F.collect_list(F.struct(f"_c{i}", "aim", "places"))).alias(f"_k{i}")))
    kinds = [
        F.struct(
            F.col("_cells").getField(f"_c{i}").alias("of"),
            F.col(f"_k{i}").getField("aim").alias("aims"),
            F.col(f"_k{i}").getField("places").alias("places"),
        )
        for i in range(len(dimensions))
    ]
    row = stage(row.withColumn("_dims", F.array(*kinds)).select("_cells", "_dims"), "row")
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def fitted(state: Column, dim: Column) -> Column:
        share = state["share"]
        sums = F.transform(dim["places"], lambda at: F.aggregate(at, F.lit(0.0), lambda a, i: a + share[i]))

        def scaled(now: Column) -> Column:
            off = F.array_max(F.zip_with(now, dim["aims"], lambda n, t: F.abs(t - n)))
            factors = F.zip_with(now, dim["aims"], lambda n, t: F.when(n > 0, t / n).otherwise(0.0))
            new = lambda f: F.transform(share, lambda x, i: x * f[dim["of"][i]])
            return F.struct(once(factors, new).alias("share"), F.greatest(state["off"], off).alias("off"))

        return once(sums, scaled)

    def round_(state: Column) -> Column:
        start = F.struct(state["share"].alias("share"), F.lit(0.0).alias("off"))
        moved = lambda s: F.array_max(F.zip_with(s["share"], state["share"], lambda x, y: F.abs(x - y)))
        return once(
            F.aggregate("_dims", start, fitted),
            lambda s: F.struct(s["share"].alias("share"), s["off"].alias("off"), moved(s).alias("moved")),
        )

    going = lambda s: (s["off"] > tolerance) & (s["moved"] > SETTLED)
    start = F.struct(
        F.col("_cells").getField("share").alias("share"),
        F.lit(math.inf).alias("off"), F.lit(math.inf).alias("moved"),
    )
    end = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda s, _: F.when(going(s), round_(s)).otherwise(s))
    ended = stage(row.select("_cells", end.alias("_end")), "raked")
    gap, moved = ended.select("_end.off", "_end.moved").first()
    each = ended.select(F.explode(F.arrays_zip("_cells", F.col("_end.share").alias("to"))).alias("_x"))
    names = [F.col(f"_x._cells.{c}").alias(c) for c in raked.columns if c != "share"]
    out = stage(each.select(*names, F.col("_x.to").alias("share")), "raked")
    return (out, gap, moved) if gap is not None and not math.isinf(gap) else (out, 0.0, 0.0)


def _by_windows(raked: DataFrame, dimensions: list[str], iterations: int, tolerance: float) -> tuple[DataFrame, float, float]:
    """The same for any number of cells. A task sums the cells of one category."""
    done, gap, moved = 0, math.inf, math.inf
    while done < iterations and gap > tolerance and moved > SETTLED:
        for _ in range(min(STEPS, iterations - done)):
            done += 1
            off = F.lit(0.0)
            raked = raked.withColumn("_from", F.col("share"))
            for d in dimensions:
                aim = F.coalesce(F.col(f"_t_{d}"), F.lit(0.0))
                raked = raked.withColumn(f"_now_{d}", F.sum("share").over(Window.partitionBy(d)))
                off = F.greatest(off, F.abs(aim - F.col(f"_now_{d}")))
                scaled = F.col("share") * aim / F.nullif(F.col(f"_now_{d}"), F.lit(0.0))
                raked = raked.withColumn("share", F.coalesce(scaled, F.lit(0.0)))
            raked = raked.withColumns({"_off": off, "_moved": F.abs(F.col("share") - F.col("_from"))})
            raked = raked.drop("_from", *[f"_now_{d}" for d in dimensions])
        raked = stage(raked, "raked")
        gap, moved = (x or 0.0 for x in raked.agg(F.max("_off"), F.max("_moved")).first())
        raked = raked.drop("_off", "_moved")
    return raked, gap, moved


def calibrated(raked: DataFrame, budget: float | None = None) -> DataFrame:
    """``raked`` with ``weight`` and ``probability``.

    The weight is raked over present share. Probabilities are ``min(1, c * weight)`` with c
    such that the expected tokens are ``budget`` (all that is there if less); without one the
    largest c that keeps every probability at most 1, so that no target is missed.
    """
    total, = raked.agg(F.sum("present")).first()
    weight = F.coalesce(F.col("share") * F.lit(total or 0.0) / F.nullif(F.col("present"), F.lit(0.0)), F.lit(0.0))
    weighed = raked.withColumn("weight", weight)
    if budget is None:
        most = weighed.agg(F.max("weight")).first()[0] or 1.0
        return weighed.withColumn("probability", F.col("weight") / F.lit(most))
    c = 0.0
    for _ in range(CAPPING_ROUNDS):
        over = F.col("weight") * c >= 1
        capped, free = weighed.agg(
            F.sum(F.when(over, F.col("present"))), F.sum(F.when(~over, F.col("present") * F.col("weight")))
        ).first()
        after = (budget - (capped or 0.0)) / free if free else math.inf
        if after <= c:
            break
        c = after
    scaled = F.lit(1.0) if math.isinf(c) else F.least(F.lit(1.0), F.col("weight") * c)
    return weighed.withColumn("probability", F.when(F.col("weight") > 0, scaled).otherwise(0.0))


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / _RANGE


def mix(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | Mapping[str, float],
    tokens: str = "tokens",
    key: str = "doc_id",
    budget_share: float | None = None,
) -> DataFrame:
    """``docs`` with ``weight``, ``probability`` and ``kept``.

    ``targets`` gives each dimension a frame of targets or the power of :func:`tempered`.
    ``docs`` should be cheap to read twice. NULL categories are categories; NULL tokens count
    as none. Rows with one key share their fate, NULL keys that of an empty string. The
    cells are joined back on all dimensions; Spark broadcasts them when they are small and
    splits hot cells otherwise. An empty table gives no rows.
    """
    dimensions = list(targets)
    counted = docs.withColumn(tokens, F.coalesce(F.col(tokens), F.lit(0)))
    cells = stage(cells_of(counted, dimensions, tokens), "cells")
    frames = {d: tempered(cells, d, t) if isinstance(t, int | float) else t for d, t in targets.items()}
    raked = rake(cells, frames)
    total = cells.agg(F.sum("present")).first()[0] or 0.0
    solved = calibrated(raked, None if budget_share is None else budget_share * total)
    solved = solved.select(*[F.col(d).alias(f"_{d}") for d in dimensions], "weight", "probability")
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dimensions]
    kept = uniform(F.coalesce(F.col(key).cast("string"), F.lit(""))) < F.col("probability")
    others = [c for c in docs.columns if c not in ("weight", "probability", "kept")]
    joined = counted.select(*others).join(solved, same, "left")
    return joined.select(*others, "weight", "probability", kept.alias("kept"))


#: Fixed marker strings; a document's topic is the most frequent of them in its whole text.
TOPIC_MARKERS = ("th", "en", "on", "er", "an", "re", "in", "st")


def marker_topic(text: Column, markers: tuple[str, ...] = TOPIC_MARKERS) -> Column:
    """The marker with most occurrences in the lower-case text (ties: the first), else ``none``."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    count = lambda t, m: ((F.char_length(t) - F.char_length(F.replace(t, F.lit(m), F.lit("")))) / len(m)).cast("long")
    pick = lambda c: F.when(F.array_max(c) > 0, F.element_at(
        F.array(*map(F.lit, markers)), F.array_position(c, F.array_max(c)).cast("int")
    )).otherwise(F.lit("none"))
    counts = F.transform(F.array(lower), lambda t: F.array(*[count(t, m) for m in markers]))
    return F.transform(counts, pick)[0]
