"""Exact top-k search by inner product with a three-phase uniform threshold (Cao and Wang, TPUT).

The dimensions are cut into ``LISTS`` groups. A group gives every query a list of all rows by
their part of the inner product, and the score is the sum over the lists.

1. Every block of rows gathers the best entries of its local lists and sends the best of
   them with their sums. The k-th best sum of a query is a safe cutoff: k rows reach it.
2. The cutoff goes with the queries to all blocks. A row that reaches it has a part of at least
   cutoff / LISTS in one list, so that only such entries are collected; where their parts, and
   just that much for the lists in which they were not seen, fall short of the cutoff they go.
3. The missing parts of the others are resolved and what reaches the cutoff is ranked.

Queries and rows meet in blocks of bounded size: each pair of blocks is a task's unit of work. The
rows move once per block of queries, the queries once per block of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundspark.llm.common import stage

LISTS = 4
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
#: Query and row pairs that a task scores at once.
TOGETHER = 1 << 20
FOUND = "query bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
BLOCK = "block bigint, rows binary, ids binary, width int, vectors binary"


def vectors(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """``row, vec_id, vector``: the rows that take part, scaled; searching takes the floor of the components.

    Rows without vec_id, without a vector or with a NULL or non-finite component take no part.
    ``row`` tells rows of one vec_id apart.
    """
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.lit(scale))
    return table.filter(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("vector")
    )


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The rows in blocks of about ``size``, and the number of blocks."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
    return stage(dealt.groupBy("block").applyInArrow(_block, BLOCK), "block"), n


def _block(group: pa.Table) -> pa.Table:
    lists = group.column("vector").combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    width = int(lengths.max())
    held = np.zeros((len(lengths), width))
    held[np.arange(width) < lengths[:, None]] = np.floor(np.asarray(lists.flatten()))
    small = np.abs(held).max(initial=0) < 1 << 31
    as_kept = held.astype(np.int32) if small else held
    return pa.table(
        {
            "block": group.column("block")[:1].cast(pa.int64()),
            "rows": [group.column("row").to_numpy().astype("<i8").tobytes()],
            "ids": [group.column("vec_id").to_numpy().astype("<i8").tobytes()],
            "width": pa.array([width if small else -width], pa.int32()),
            "vectors": [as_kept.tobytes()],
        }
    )


class _Held:
    """A block's rows: numbers, ids and the vectors as a matrix."""

    def __init__(self, table: pa.Table):
        self.rows, self.ids = (np.frombuffer(table.column(c)[0].as_py(), dtype="<i8") for c in ("rows", "ids"))
        width = table.column("width")[0].as_py()
        kind = np.int32 if width >= 0 else np.float64
        self.matrix = np.frombuffer(table.column("vectors")[0].as_py(), dtype=kind).reshape(len(self.rows), abs(width))


def _lists(queries: np.ndarray, rows: np.ndarray, lists: int) -> np.ndarray:
    """The part of every list in every score (list, query, row), exact: in floating point where
    no partial sum can leave its integers, else in Python's integers. Shorter vectors count as
    if zeros followed."""
    width = max(queries.shape[1], rows.shape[1])
    most = width * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    shared = min(queries.shape[1], rows.shape[1])
    cuts = np.linspace(0, shared, lists + 1).astype(int)
    as_kind = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) if kind is object else m.astype(kind)
    q, r = as_kind(queries[:, :shared]), as_kind(rows[:, :shared])
    parts = [q[:, a:b] @ r[:, a:b].T if b > a else np.zeros((len(q), len(r)), dtype=kind) for a, b in zip(cuts, cuts[1:])]
    return np.stack(parts)


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best entries of each query; ties go to the smaller id."""
    order = np.lexsort((ids[row], -score, query))
    starts = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - starts < k]


def _slices(n_queries: int, n_rows: int) -> list[slice]:
    step = max(1, TOGETHER // max(1, n_rows))
    return [slice(at, at + step) for at in range(0, n_queries, step)]


def _found(q: _Held, at: slice, r: _Held, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.Table:
    columns = (q.rows[at][query], q.ids[at][query], r.ids[row], r.rows[row], score)
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "row", "score"])


_NONE = pa.table([pa.array([], pa.int64())] * 5, ["query", "query_id", "vec_id", "row", "score"])


def _gather(k: int, lists: int):
    """Phase 1: the best rows of the local lists, the best of them with their sums."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NONE
        r, q, out = _Held(left), _Held(right), [_NONE]
        for at in _slices(len(q.rows), len(r.rows)):
            parts = _lists(q.matrix[at], r.matrix, lists)
            own = q.rows[at][:, None] == r.rows[None, :]
            n = len(r.rows)
            seen = np.zeros(own.shape, dtype=bool)
            for part in parts:
                if k + 1 >= n or part.dtype == object:
                    seen[:] = True
                    break
                # One more than k: the query's own row may be among them.
                top = np.argpartition(part, n - k - 1, axis=1)[:, n - k - 1 :]
                np.put_along_axis(seen, top, True, axis=1)
            query, row = np.nonzero(seen & ~own)
            score = parts[:, query, row].sum(axis=0).astype(np.int64)
            kept = _best(query, row, score, r.ids, k)
            out.append(_found(q, at, r, query[kept], row[kept], score[kept]))
        return pa.concat_tables(out)

    return run


def _resolve(k: int, lists: int):
    """Phases 2 and 3: entries above the uniform threshold, pruned by their bounds, then summed."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NONE
        r, q, out = _Held(left), _Held(right), [_NONE]
        cuts = {c["query"]: (c["score"], c["vec_id"]) for c in right.column("cutoffs")[0].as_py() or ()}
        for at in _slices(len(q.rows), len(r.rows)):
            cut = [cuts.get(x) for x in q.rows[at].tolist()]
            parts = _lists(q.matrix[at], r.matrix, lists)
            exact = parts.dtype == object
            least = [c[0] if c else -(1 << 200) for c in cut] if exact else [c[0] if c else -np.inf for c in cut]
            floor_ = np.array(least, dtype=object if exact else np.float64)[:, None]
            # Parts are integers, so the floor of the threshold stands for it.
            threshold = floor_ // lists if exact else np.floor(floor_ / lists)
            seen = parts >= (threshold if exact else threshold.astype(parts.dtype))
            own = q.rows[at][:, None] == r.rows[None, :]
            query, row = np.nonzero(seen.any(axis=0) & ~own)
            part, there = parts[:, query, row], seen[:, query, row]
            if not exact:
                part = part.astype(np.float64)
            able = np.where(there, part, threshold[query, 0]).sum(axis=0) >= floor_[query, 0]
            query, row = query[able], row[able]
            score = part[:, able].sum(axis=0).astype(np.int64)
            ids = np.array([c[1] if c else (1 << 63) - 1 for c in cut], dtype=np.int64)
            reach = (score > floor_[query, 0]) | ((score == floor_[query, 0]) & (r.ids[row] <= ids[query]))
            query, row, score = query[reach], row[reach], score[reach]
            kept = _best(query, row, score, r.ids, k)
            out.append(_found(q, at, r, query[kept], row[kept], score[kept]))
        return pa.concat_tables(out)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with ``rank`` from 1."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int,
    lists: int = LISTS,
    row_block: int = ROW_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest inner product for each query.

    ``rows`` has ``row, vec_id, vector`` (see :func:`vectors`); the queries are those where
    ``is_query`` holds. Candidates are all rows but the query's own; ties go to the smaller
    vec_id. A vec_id that repeats is a row each time: each is a query, and the others are its
    candidates. Fewer than ``k`` candidates give all of them; no queries or no rows give none.
    Vectors may differ in length (zeros follow the shorter one; an empty one scores 0). Scores are
    exact; one beyond 64 bits is an error. Copies of one vector cost no more than other rows.
    """
    rows = stage(rows.select("row", "vec_id", "vector"), "vectors")
    queries, n_queries = _blocks(rows.filter(is_query), query_block)
    everything, n_rows = _blocks(rows, row_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = everything.withColumnRenamed("block", "row_block").withColumn("query_block", every(n_queries))

    def met(asked: DataFrame, step) -> DataFrame:
        right = asked.withColumnRenamed("block", "query_block").withColumn("row_block", every(n_rows))
        pair = ["row_block", "query_block"]
        return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(step(k, lists), FOUND)

    gathered = _ranked(met(queries, _gather), k).filter(F.col("rank") == k)
    cutoffs = gathered.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_queries))).groupBy("block").agg(
        F.collect_list(F.struct("query", "score", "vec_id")).alias("cutoffs")
    )
    cut = stage(queries.join(cutoffs, "block", "left"), "cutoffs")
    return _ranked(met(cut, _resolve), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
