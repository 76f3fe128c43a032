"""A ball tree over a vector table: which groups of rows can matter to a query.

The tree grows level by level from the data.  A cell that has more rows than a leaf
should is split around pivots drawn, by hash, from its own rows; it ends when all
cells fit, when a cell is nothing but copies of one direction, or when the pivots
would outgrow ``TREE_BYTES`` (leaves then are larger).  Each leaf knows the widest
angle to its pivot, the least and greatest norm and, if rows carry an offset, its
least and greatest value, and so bounds every score between a query and its rows.

Only the tree reaches the driver.  In a visit the rows of a leaf stay in one copy, cut
into tiles that fit a task, or packed into one with its neighbours; visitors are copied,
once for each tile of which their bounds name a leaf, and stream past the tile in sorted
order, so a task holds a tile and one batch.  Tiles that more visitors ask for than
``CROWD`` tiles of rows are copied once for each such crowd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.operators.vector_blocks import doubles, longs, matrix
from siftwork.session import reliable_checkpoint

# Doubles of all pivots: what every task holds.
TREE_BYTES = 32 << 20
# Children of a cell in one level.
FAN = 64
# Levels after which a leaf may have twice as many rows.
LEVELS = 4
# Doubles of one tile.
TILE_BYTES = 16 << 20
# Visitors that share a copy of a tile, in tiles of rows.
CROWD = 64
# Visitors of a crowd, at least.
LEAST_CROWD = 1024
# Scores computed at once.
SCORES = 1 << 22
# A visitor of one row in so many of a tile meets the whole tile at once.
DENSE = 8
# Slack on angles, far above the rounding of a double dot product.
SLACK = 1e-6


def tile_rows(width: int) -> int:
    return max(1, TILE_BYTES // (8 * max(1, width)))


@dataclass
class Tree:
    """Nodes in the order they were made; node 0 holds everything."""

    pivots: np.ndarray
    first: np.ndarray  # first child, 0 for a leaf
    children: np.ndarray
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))
    norms: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: from the root down, to the nearest child."""
        node = np.zeros(len(vectors), np.int64)
        inner = np.arange(len(vectors))
        while True:
            inner = inner[self.children[node[inner]] > 0]
            if not len(inner):
                return node
            for at in np.unique(node[inner]):
                mine = inner[node[inner] == at]
                span = slice(self.first[at], self.first[at] + self.children[at])
                node[mine] = self.first[at] + angles(vectors[mine], self.pivots[span]).argmin(axis=1)

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest score of each vector with the rows of each leaf, and the angles to the
        pivots.  Columns follow ``leaves``."""
        at = self.leaves
        if not len(at):
            return (np.zeros((len(vectors), 0)),) * 3
        norm = np.linalg.norm(vectors, axis=1)[:, None]
        angle, reach = angles(vectors, self.pivots[at]), self.reach[at] + SLACK
        near = np.cos(np.maximum(0.0, angle - reach))
        far = np.cos(np.minimum(np.pi, angle + reach))
        low, high = self.norms[at, 0], self.norms[at, 1]
        most = norm * np.where(near >= 0, near * high, near * low) - self.offsets[at, 0]
        least = norm * np.where(far >= 0, far * low, far * high) - self.offsets[at, 1]
        return least - SLACK, most + SLACK, angle


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between directions; a zero vector is at a right angle to all."""
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1.0)
    return np.arccos(np.clip(unit(vectors) @ unit(pivots).T, -1.0, 1.0))


def build(df: DataFrame, leaf_rows: int, offset: str | None = None,
          tree_bytes: int = TREE_BYTES) -> tuple[DataFrame, Tree]:
    """``df`` (id, embedding, ...) with ``cell``, its leaf, written once; and the tree."""
    spark = df.sparkSession
    first = df.select("embedding").limit(1).toArrow()
    width = len(first["embedding"][0].as_py()) if first.num_rows else 0
    most = max(FAN, tree_bytes // (8 * max(1, width)))
    tree = Tree(np.zeros((1, width)), np.zeros(1, np.int64), np.zeros(1, np.int64))
    final: set[int] = set()
    for level in count():
        handle = spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                m, t = matrix(batch["embedding"]), handle.value
                cell = t.place(m)
                turn = np.empty(len(m))
                for at in np.unique(cell):
                    turn[cell == at] = angles(m[cell == at], t.pivots[at:at + 1])[:, 0]
                norm = np.linalg.norm(m, axis=1)
                # Score 0 whatever the angle, which the least norm tells.
                turn[norm == 0] = 0.0
                yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column(
                    "_turn", pa.array(turn)).append_column("_norm", pa.array(norm))

        schema = T.StructType(df.schema.fields + T.StructType.fromDDL("cell int, _turn double, _norm double").fields)
        placed = df.mapInArrow(place, schema)
        _measure(tree, placed, offset)
        # Each level is a pass over all rows: the longer it takes, the more rows a leaf may keep.
        crowded = [(int(c), int(min(FAN, -(-tree.rows[c] // leaf_rows)))) for c in tree.leaves
                   if tree.rows[c] > leaf_rows << level // LEVELS and (tree.reach[c] > SLACK or c == 0) and int(c) not in final]
        room = most - len(tree.rows)
        want = []
        for cell, fan in sorted(crowded, key=lambda x: -tree.rows[x[0]]):
            if 2 <= fan <= room:
                want.append((cell, fan))
                room -= fan
        if not want:
            return reliable_checkpoint(placed.drop("_turn", "_norm")), tree
        drawn = _drawn(placed, want)
        for cell, _ in want:
            pivots = drawn.get(cell)
            if pivots is None or len(pivots) < 2:
                final.add(cell)  # copies of one direction: no pivot divides them
                continue
            tree.first[cell], tree.children[cell] = len(tree.pivots), len(pivots)
            tree.pivots = np.concatenate([tree.pivots, pivots])
            tree.first = np.append(tree.first, np.zeros(len(pivots), np.int64))
            tree.children = np.append(tree.children, np.zeros(len(pivots), np.int64))


def _measure(tree: Tree, placed: DataFrame, offset: str | None) -> None:
    """One row of figures for each leaf."""
    figures = [F.count(F.lit(1)).alias("n"), F.max("_turn").alias("turn"),
               F.min("_norm").alias("low"), F.max("_norm").alias("high")]
    if offset:
        value = F.col(offset).cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        figures += [F.min(F.when(finite, value)).alias("least"), F.max(F.when(finite, value)).alias("most"),
                    F.count_if(~finite).alias("odd")]
    n = len(tree.pivots)
    tree.rows, tree.reach = np.zeros(n, np.int64), np.zeros(n)
    tree.norms, tree.offsets = np.zeros((n, 2)), np.zeros((n, 2))
    for r in placed.groupBy("cell").agg(*figures).collect():
        c = r["cell"]
        tree.rows[c], tree.norms[c] = r["n"], (r["low"], r["high"])
        tree.reach[c] = r["turn"] if np.any(tree.pivots[c]) else np.pi
        if offset:
            # A row without a finite offset never ranks: it can't be counted on.
            tree.offsets[c] = (np.inf if r["least"] is None else r["least"],
                               np.inf if r["odd"] or r["most"] is None else r["most"])
    tree.leaves = np.flatnonzero((tree.children == 0) & (tree.rows > 0))


def _drawn(placed: DataFrame, want: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Different pivots for each cell: its rows of least hash.  At most as many as the tree has room for."""
    spark = placed.sparkSession
    asked = spark.createDataFrame(want, "cell int, fan int")
    order = Window.partitionBy("cell").orderBy(F.xxhash64("embedding"), "id")
    rows = placed.select("id", "embedding", "cell").withColumn("pos", F.row_number().over(order)).where(
        F.col("pos") <= FAN).join(F.broadcast(asked), "cell").where("pos <= fan")
    table = rows.select("cell", "embedding").toArrow()
    cells, vectors = longs(table["cell"]), matrix(table["embedding"])
    return {int(c): np.unique(vectors[cells == c], axis=0) for c in np.unique(cells)} if len(cells) else {}


# ----------------------------------------------------------------------- visits

#: (batch, least, most, angles, tree) -> which leaves to visit, and further columns.
Rule = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, Tree], tuple[np.ndarray, dict]]


def routes(tree: Tree, visitors: DataFrame, rule: Rule, more: str = "") -> DataFrame:
    """``visitors`` with ``targets``, the leaves that the rule names, and the rule's own columns."""
    handle = visitors.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = handle.value
        step = max(1, SCORES // max(1, len(t.leaves)))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                named, columns = rule(batch, *t.bounds(matrix(batch["embedding"])), t)
                who, leaf = np.nonzero(named)
                ends = np.append(0, np.cumsum(np.bincount(who, minlength=len(batch))))
                targets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(t.leaves[leaf], pa.int32()))
                batch = batch.append_column("targets", targets)
                for name, values in columns.items():
                    batch = batch.append_column(name, pa.array(values))
                yield batch

    fields = visitors.schema.fields + T.StructType.fromDDL("targets array<int>" + more).fields
    return visitors.mapInArrow(route, T.StructType(fields))


#: (visitors, homes, home matrix) -> results.
Kernel = Callable[[pa.RecordBatch, pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def masked(kernel: Kernel) -> Kernel:
    """A kernel with a fourth argument, which of the homes each visitor meets: it may be given whole tiles."""
    kernel.masked = True
    return kernel


def _packed(tree: Tree, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the groups of leaves begin, and their end; group of each leaf; rows of each group.  Leaves that
    stand side by side are a group, of at most ``rows`` rows together or one leaf."""
    starts, sizes = [], []
    for k, n in enumerate(tree.rows[tree.leaves].tolist()):
        if not sizes or sizes[-1] + n > rows:
            starts.append(k)
            sizes.append(0)
        sizes[-1] += n
    bounds = np.array([*starts, len(tree.leaves)], np.int64)
    return bounds, np.repeat(np.arange(len(sizes)), np.diff(bounds)), np.array(sizes, np.int64)


def _asks(targets: pa.Array, leaves: np.ndarray) -> np.ndarray:
    """Which visitor (row) names which leaf (column)."""
    named = np.zeros((len(targets), len(leaves)), bool)
    lengths = targets.value_lengths().to_numpy(zero_copy_only=False)
    named[np.repeat(np.arange(len(targets)), lengths), np.searchsorted(leaves, longs(targets.flatten()))] = True
    return named


def visit(tree: Tree, homes: DataFrame, routed: DataFrame, kernel: Kernel, schema: str,
          rows: int) -> DataFrame:
    """Run the kernel for the visitors of each leaf on its rows, or on tiles of at most ``rows`` rows or so.
    Small leaves share a tile, and a visitor is copied once for each tile, however many of its leaves it
    names.  ``routed`` is read twice and should be a written table."""
    spark, leaves = homes.sparkSession, tree.leaves
    bounds, group, sizes = _packed(tree, rows)
    if not len(sizes):
        return spark.createDataFrame([], schema)
    step = max(1, SCORES // len(leaves))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                yield batch, _asks(batch["targets"], leaves)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(sizes), np.int64)
        for _, named in parts(batches):
            seen += np.logical_or.reduceat(named, bounds[:-1], axis=1).sum(axis=0)
        yield pa.record_batch({"target": np.arange(len(sizes), dtype=np.int32), "n": seen})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, named in parts(batches):
            batch = batch.drop_columns(["targets"])
            for g in range(len(sizes)):
                mine = named[:, bounds[g]:bounds[g + 1]]
                who = np.flatnonzero(mine.any(axis=1))
                if len(who):
                    bits = [row.tobytes() for row in np.packbits(mine[who], axis=1)]
                    yield batch.take(pa.array(who)).append_column("_leaves", pa.array(bits, pa.binary())).append_column(
                        "target", pa.array(np.full(len(who), g, np.int32)))

    crowd = routed.select("targets").mapInArrow(asking, "target int, n long").groupBy("target").agg(
        F.sum("n").alias("n")).where("n > 0").collect()  # one row for each group
    plan = [(r["target"], max(1, -(-int(sizes[r["target"]]) // rows)), max(1, -(-r["n"] // (CROWD * rows))), r["n"]) for r in crowd]
    # Few tiles are copied for more crowds, so that all cores have one.
    spare = -(-2 * max(1, spark.sparkContext.defaultParallelism) // max(1, sum(t for _, t, _, _ in plan)))
    plan = [(g, tiles, max(crowds, min(spare, -(-n // LEAST_CROWD)))) for g, tiles, crowds, n in plan]
    tasks = max(1, 2 * sum(tiles * crowds for _, tiles, crowds in plan))
    cells = F.broadcast(spark.createDataFrame(plan, "target int, tiles int, crowds int"))
    placed = F.broadcast(spark.createDataFrame(list(zip(leaves.tolist(), group.tolist(), strict=True)), "cell int, target int"))

    def share(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    fields = [f for f in routed.schema.fields if f.name != "targets"] + T.StructType.fromDDL(
        "_leaves binary, target int").fields
    coming = routed.mapInArrow(dealt, T.StructType(fields)).join(cells, "target").withColumns(
        {"_crowd": share("crowds"), "_tile": each("tiles"), "_side": F.lit(1)})
    at_home = homes.join(placed, "cell").join(cells, "target").withColumns(
        {"_tile": share("tiles"), "_crowd": each("crowds"), "_side": F.lit(0)})
    place = ["target", "_tile", "_crowd"]
    both = coming.drop("tiles", "crowds").unionByName(at_home.drop("tiles", "crowds"), allowMissingColumns=True)
    # The number is given: small tiles are much work and must not be put together by their bytes.
    return both.repartition(tasks, *place).sortWithinPartitions(*place, "_side").mapInArrow(
        _streamed(kernel, place, leaves, bounds), schema)


class _Tile:
    """The rows of a tile, leaf by leaf."""

    def __init__(self, parts: list[pa.RecordBatch], leaves: np.ndarray):
        table = pa.Table.from_batches(parts)
        cell = longs(table["cell"])
        order = np.argsort(cell, kind="stable")
        self.table, cell = table.take(pa.array(order)).combine_chunks(), cell[order]
        self.vectors = matrix(self.table["embedding"])
        found, begin = np.unique(cell, return_index=True)
        self.ends = np.append(begin, len(cell))
        self.leaves = np.searchsorted(leaves, found)
        # What a visitor brings forth may be a few rows for each leaf.
        self.step = max(1, SCORES // max(int(np.diff(self.ends).max()), 8 * len(found)))


def _streamed(kernel: Kernel, place: list[str], leaves: np.ndarray, bounds: np.ndarray):
    """Tiles come before their visitors: hold the one, stream the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tile = None, [], None
        for batch in batches:
            keys = np.stack([longs(batch[c]) for c in (*place, "_side")], axis=1)
            cuts = np.append(0, np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                if hi == lo:
                    continue
                *key, side = keys[lo].tolist()
                if key != now:
                    now, parts, tile = key, [], None
                part = batch.slice(lo, hi - lo)
                if side == 0:
                    parts.append(part)
                elif parts:
                    tile = tile or _Tile(parts, leaves)
                    first, last = bounds[key[0]:key[0] + 2]
                    for at in range(0, hi - lo, tile.step):
                        yield from _met(kernel, part.slice(at, tile.step), tile, int(first), int(last - first))

    return run


def _met(kernel: Kernel, visitors: pa.RecordBatch, tile: _Tile, first: int, leaves: int) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(b"".join(visitors["_leaves"].to_pylist()), np.uint8).reshape(len(visitors), -1)
    named = np.unpackbits(bits, axis=1, count=leaves).astype(bool)[:, tile.leaves - first]
    sizes = np.diff(tile.ends)
    # Visitors of a good part of the tile meet all of it at once, under a mask; the others leaf by leaf.
    whole = (DENSE * (named @ sizes) >= len(tile.vectors)) & getattr(kernel, "masked", False)
    dense, step = np.flatnonzero(whole), max(1, SCORES // len(tile.vectors))
    for lo in range(0, len(dense), step):
        who = dense[lo:lo + step]
        mask = None if named[who].all() else np.repeat(named[who], sizes, axis=1)
        yield from kernel(visitors.take(pa.array(who)), tile.table, tile.vectors, mask)
    named &= ~whole[:, None]
    for k in np.flatnonzero(named.any(axis=0)):
        some, lo, hi = visitors.take(pa.array(np.flatnonzero(named[:, k]))), tile.ends[k], tile.ends[k + 1]
        yield from kernel(some, tile.table.slice(lo, hi - lo), tile.vectors[lo:hi])


def offsets_of(table, offset: str | None) -> np.ndarray | None:
    return doubles(table[offset]) if offset else None
