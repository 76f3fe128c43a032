"""Block joins of two vector tables, the ground of every scoring operator.

Two tables are scored against each other in blocks of bounded size: each task
multiplies one block of targets by one block of visitors and emits only what
its kernel keeps.  Where bounds can rule blocks out, ``ball_tree`` does so.

A side small enough to hold in every executor skips all that and is broadcast;
its size is read first, never assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast up to this many bytes of double vectors.
BROADCAST_BYTES = 64 << 20
# Rows of one side in one task of a block join.
BLOCK_ROWS = 2048
# Rows of the first, size-finding read of a side.
_FIRST_READ = 1024

Kernel = Callable[[pa.Table, pa.Table], pa.Table]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a double matrix, one row per vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    widths = pc.min_max(pc.list_value_length(column))
    if column.null_count or widths["min"] != widths["max"]:
        raise ValueError("vectors of one table must be present and of one width")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def longs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array)
                      else column.to_numpy(), dtype=np.int64)


def doubles(column) -> np.ndarray:
    return np.asarray(column.to_pandas(), dtype=np.float64)


@dataclass(frozen=True)
class Held:
    """A whole small side, collected after its size was checked."""

    ids: np.ndarray
    vectors: np.ndarray
    extra: dict[str, np.ndarray]


def hold_if_small(
    df: DataFrame, id_col: str, vec_col: str, extra: list[str] = (),
    max_bytes: int = BROADCAST_BYTES, width: int | None = None,
) -> Held | None:
    """The side as arrays when it fits ``max_bytes``, else None.

    A short first read settles small sides and gives the width; the second
    stops one row past the bound, so an oversized side is never pulled in.  A
    caller that knows the ``width`` saves the first read.
    """
    columns = df.select(id_col, vec_col, *extra)
    first = _FIRST_READ if width is None else max(1, max_bytes // (8 * width))
    table = columns.limit(first + 1).toArrow()
    if table.num_rows == 0:
        return Held(np.zeros(0, np.int64), np.zeros((0, 0)), {c: np.zeros(0) for c in extra})
    width = len(table[vec_col][0].as_py())
    bound = max(1, max_bytes // (8 * max(1, width)))
    if table.num_rows > bound:
        return None
    if table.num_rows > first:
        table = columns.limit(bound + 1).toArrow()
        if table.num_rows > bound:
            return None
    return Held(longs(table[id_col]), matrix(table[vec_col]),
                {c: table[c].to_numpy() for c in extra})


# ------------------------------------------------------------------ plain grid

def grid_join(
    left: DataFrame, right: DataFrame, kernel: Kernel, schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every block of ``left`` meets every block of ``right`` once.

    For kernels that need each score (a log-sum, an exact rank), where no pair
    can be skipped.  Rows fall into blocks by a hash of their ``id``, so a hot
    source or copy group spreads over blocks like any other rows.
    """
    n_left = max(1, -(-left.count() // block_rows))
    n_right = max(1, -(-right.count() // block_rows))
    a = _side(left, 0).withColumn("lb", _block(F.col("id"), n_left)).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    b = _side(right, 1).withColumn("rb", _block(F.col("id"), n_right)).withColumn(
        "lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("lb", "rb").applyInArrow(_two_sided(kernel), schema)


def _side(df: DataFrame, side: int) -> DataFrame:
    return df.withColumn("side", F.lit(side))


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _two_sided(kernel: Kernel):
    def run(table: pa.Table) -> pa.Table:
        side = longs(table["side"])
        return kernel(table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)))
    return run
