"""Exact similarity: pairs above a threshold, nearest neighbours, ranks.

Inputs are ``(id, embedding)`` tables of unit vectors.  Scores are cosines in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators import ball_tree
from siftwork.operators import vector_blocks as vb
from siftwork.session import reliable_checkpoint, spread

PAIR_SCHEMA = "a_id long, b_id long, score double"
HIT_SCHEMA = "query_id long, id long, score double"
_CHUNK = 512
# Columns that a row meets at once, at least.
_PIECE = 4096


def chunk(others: int) -> int:
    """Rows scored at once against so many others: what a task holds does not grow with them."""
    return min(_CHUNK, max(1, ball_tree.SCORES // max(1, others)))


# --------------------------------------------------------------- pairs above t

def pairs_above(
    vectors: DataFrame, threshold: float, max_bytes: int = vb.BROADCAST_BYTES,
    block_rows: int = vb.BLOCK_ROWS,
) -> DataFrame:
    """Every pair with cosine strictly above ``threshold``: ``a_id < b_id, score``."""
    vectors = vectors.select("id", "embedding")
    held = vb.hold_if_small(vectors, "id", "embedding", max_bytes=max_bytes)
    if held is not None:
        return _pairs_against_held(vectors, held, threshold)

    homes, tree = ball_tree.build(vectors, block_rows)
    rank = np.full(len(tree.pivots), -1)
    rank[tree.leaves] = np.arange(len(tree.leaves))

    def can_hold_partner(batch, least, most, angles, t):
        # Pairs between two leaves are found from the lower-numbered one.
        own = rank[batch["cell"].to_numpy(zero_copy_only=False)]
        return (own[:, None] <= np.arange(len(t.leaves))) & (most > threshold), {}

    @ball_tree.masked
    def kernel(visitors: pa.RecordBatch, table: pa.Table, hm: np.ndarray, mask: np.ndarray | None = None):
        va, ha = vb.longs(visitors["id"]), vb.longs(table["id"])
        i, j, scores = over_line(vb.matrix(visitors["embedding"]), hm, threshold, mask)
        within = vb.longs(visitors["cell"])[i] == vb.longs(table["cell"])[j]
        keep = ~within | (va[i] < ha[j])
        i, j = i[keep], j[keep]
        yield pa.record_batch({"a_id": np.minimum(va[i], ha[j]), "b_id": np.maximum(va[i], ha[j]),
                               "score": scores[keep]})

    routed = reliable_checkpoint(ball_tree.routes(tree, homes, can_hold_partner))
    return ball_tree.visit(tree, homes, routed, kernel, PAIR_SCHEMA, _tile(tree))


def over_line(q: np.ndarray, c: np.ndarray, threshold: float,
              mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the pairs above the threshold, of those in the mask.  Single precision rules
    most out; where many are left they are all scored in double precision."""
    slack = margin(q, c)
    if slack == slack:
        with np.errstate(over="ignore", invalid="ignore"):
            may = q.astype(np.float32) @ c.astype(np.float32).T >= _below(np.array([threshold - slack]))
        if mask is not None:
            may &= mask
        if np.count_nonzero(may) <= may.size // 8:
            i, j = np.nonzero(may)
            scores = np.round(pair_dots(q, c, i, j), 12)  # copies of a vector tie
            keep = scores > threshold
            return i[keep], j[keep], scores[keep]
    scores = np.round(q @ c.T, 12)
    over = scores > threshold
    if mask is not None:
        over &= mask
    i, j = np.nonzero(over)
    return i, j, scores[i, j]


def _tile(tree: ball_tree.Tree) -> int:
    return ball_tree.tile_rows(tree.pivots.shape[1])


def _pairs_against_held(vectors: DataFrame, held: vb.Held, threshold: float) -> DataFrame:
    handle = vectors.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = handle.value
        for batch in batches:
            ids, m = vb.longs(batch["id"]), vb.matrix(batch["embedding"])
            step = chunk(len(side.ids))
            for lo in range(0, len(ids), step):
                i, j, scores = over_line(m[lo:lo + step], side.vectors, threshold)
                keep = ids[lo + i] < side.ids[j]
                i, j = i[keep], j[keep]
                yield pa.record_batch({"a_id": ids[lo + i], "b_id": side.ids[j],
                                       "score": scores[keep]})

    return spread(vectors).mapInArrow(run, PAIR_SCHEMA)


# ------------------------------------------------------------------------ top-k

def best_columns(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` best ids by (score down, id up), padded with -inf."""
    rows, n = scores.shape
    out_ids = np.full((rows, k), np.iinfo(np.int64).max)
    out_scores = np.full((rows, k), -np.inf)
    if n == 0:
        return out_ids, out_scores
    cut = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(rows, -np.inf)
    r, c = np.nonzero((scores >= cut[:, None]) & np.isfinite(scores))
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    pos = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    keep = pos < k
    out_ids[r[keep], pos[keep]] = ids[c[keep]]
    out_scores[r[keep], pos[keep]] = scores[r[keep], c[keep]]
    return out_ids, out_scores


def merge_best(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([a[0], b[0]], axis=1)
    scores = np.concatenate([a[1], b[1]], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def margin(q: np.ndarray, c: np.ndarray, off: np.ndarray | None = None) -> float:
    """How far a score of single precision may be from the one of double precision; NaN if there is no telling."""
    if not len(q) or not len(c):
        return 0.0
    with np.errstate(all="ignore"):
        size = np.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", c, c).max())
        size = size + (np.abs(off).max() if off is not None else 0.0)
        most = max(np.abs(q).max(), np.abs(c).max(), size)
    return 2.0 ** -23 * (q.shape[1] + 8) * size + 1e-11 if most < 1e15 else np.nan


def _below(thresholds: np.ndarray) -> np.ndarray:
    """Single-precision values not above the given ones."""
    return np.nextafter(thresholds.astype(np.float32), np.float32(-np.inf))


def pair_dots(q: np.ndarray, c: np.ndarray, r: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dot products of the rows ``r`` of one side with the rows ``at`` of the other, a bounded number at once."""
    out = np.empty(len(r))
    for lo in range(0, len(r), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        out[part] = np.einsum("ij,ij->i", q[r[part]], c[at[part]])
    return out


class Best:
    """The ``k`` best columns that each row has met, by (score down, id up); non-finite scores never rank.

    Scores of single precision tell which columns may reach the row's k-th best, or the ``floor`` given; only
    these are scored in double precision, rounded so that copies of a vector tie, and merged.  Where many may,
    as among copies, or values are out of range, a piece is scored in double precision as a whole."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool = False,
                 floor: np.ndarray | None = None):
        self.q_ids, self.q, self.k, self.exclude_self = q_ids, q, k, exclude_self
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(q), k), -np.inf)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor.copy()

    def meet(self, ids: np.ndarray, vectors: np.ndarray, off: np.ndarray | None = None,
             mask: np.ndarray | None = None) -> None:
        """``mask``: which of the columns a row meets, if not all."""
        if off is not None:
            fine = np.isfinite(off)
            if not fine.all():
                ids, vectors, off = ids[fine], vectors[fine], off[fine]
                mask = None if mask is None else mask[:, fine]
        if not len(ids) or not len(self.q):
            return
        slack = margin(self.q, vectors, off)
        width = min(len(ids), max(_PIECE, 64 * self.k))
        step = max(1, ball_tree.SCORES // width)
        with np.errstate(over="ignore", invalid="ignore"):
            single = vectors.astype(np.float32)
        for at in range(0, len(self.q), step):
            rows = slice(at, at + step)
            for lo in range(0, len(ids), width):
                part = slice(lo, lo + width)
                self._piece(rows, ids[part], vectors[part], single[part], None if off is None else off[part], slack,
                            None if mask is None else mask[rows, part])

    def _piece(self, rows: slice, ids, vectors, single, off, slack: float, mask=None) -> None:
        q, floor = self.q[rows], self.floor[rows]
        own = _same(self.q_ids[rows], ids) if self.exclude_self else None
        if slack == slack:
            s = q.astype(np.float32) @ single.T
            if off is not None:
                s -= off.astype(np.float32)[None, :]
            if own is not None:
                s[own] = -np.inf
            if mask is not None:
                s[~mask] = -np.inf
            least = floor - slack
            fresh = np.flatnonzero(np.isneginf(floor))
            if len(fresh) and len(ids) > self.k:
                some = s if len(fresh) == len(s) else s[fresh]
                if self.k == 1:
                    kth = some.max(axis=1)
                else:
                    kth = np.partition(some, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                least[fresh] = kth.astype(float) - 2 * slack
            may = s >= _below(least)[:, None]
            if mask is not None:
                may &= mask
            if np.count_nonzero(may) <= max(may.size // 8, 2 * self.k * len(may)):
                r, c = np.divmod(np.flatnonzero(may), len(ids))
                del s, may
                scores = np.round(pair_dots(q, vectors, r, c), 12)
                if off is not None:
                    scores -= off[c]
                if own is not None:
                    real = self.q_ids[rows][r] != ids[c]
                    r, c, scores = r[real], c[real], scores[real]
                self._merge(rows, r, ids[c], scores)
                return
            del s, may
        step = max(1, ball_tree.SCORES // (2 * len(ids)))
        for lo in range(0, len(q), step):
            scores = np.round(q[lo:lo + step] @ vectors.T, 12)  # copies of a vector tie
            if off is not None:
                scores = scores - off[None, :]
            if own is not None:
                mine = (own[0] >= lo) & (own[0] < lo + step)
                scores[own[0][mine] - lo, own[1][mine]] = -np.inf
            if mask is not None:
                scores[~mask[lo:lo + step]] = -np.inf
            scores[~np.isfinite(scores)] = -np.inf
            found, best = best_columns(scores, ids, self.k)
            r, c = np.nonzero(np.isfinite(best))
            self._merge(rows, r + lo, found[r, c], best[r, c])

    def _merge(self, rows: slice, r: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take what reaches the floor of its row, in order of rows."""
        keep = np.isfinite(scores) & (scores >= self.floor[rows][r])
        r, ids, scores = r[keep], ids[keep], scores[keep]
        if not len(r):
            return
        mine = np.unique(r)
        at = mine + rows.start
        old, (i, j) = self.scores[at], np.nonzero(np.isfinite(self.scores[at]))
        who = np.concatenate([i, np.searchsorted(mine, r)])
        ids, scores = np.concatenate([self.ids[at][i, j], ids]), np.concatenate([old[i, j], scores])
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        pos = np.arange(len(who)) - np.searchsorted(who, who, side="left")
        keep = pos < self.k
        self.scores[at[who[keep]], pos[keep]] = scores[keep]
        self.ids[at[who[keep]], pos[keep]] = ids[keep]
        self.floor[at] = np.maximum(self.floor[at], self.scores[at, self.k - 1])

    def hits(self) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // self.k)
        for lo in range(0, len(self.q), step):
            scores = self.scores[lo:lo + step]
            real = np.isfinite(scores)
            who = np.repeat(self.q_ids[lo:lo + step], real.sum(axis=1))
            yield pa.record_batch({"query_id": who, "id": self.ids[lo:lo + step][real], "score": scores[real]})


def _same(q_ids: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an id of the one side is one of the other: rows and columns."""
    order = np.argsort(c_ids, kind="stable")
    held = c_ids[order]
    first, last = np.searchsorted(held, q_ids, "left"), np.searchsorted(held, q_ids, "right")
    n = last - first
    rows = np.repeat(np.arange(len(q_ids)), n)
    return rows, order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def best_in_tasks(hits: DataFrame, k: int, most: int = 1 << 20) -> DataFrame:
    """Hits without those that ``k`` better ones of the same query and task rule out; they never reach a
    shuffle.  Past ``most`` rows that all stay, a task hands them on and starts anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        rows, due = 0, most

        def cut() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            q, ids, scores = vb.longs(table["query_id"]), vb.longs(table["id"]), table["score"].to_numpy()
            order = np.lexsort((ids, -scores, q))
            at = q[order]
            order = order[np.arange(len(at)) - np.searchsorted(at, at, side="left") < k]
            return table.take(pa.array(order)).combine_chunks().to_batches()[0]

        for batch in batches:
            if not len(batch):
                continue
            parts.append(batch)
            rows += len(batch)
            if rows > due:
                parts = [cut()]
                rows = len(parts[0])
                due = max(most, 2 * rows)
                if rows > most:
                    yield parts[0]
                    parts, rows, due = [], 0, most
        if rows:
            yield cut()

    return hits.mapInArrow(run, hits.schema)


def ranked(hits: DataFrame, k: int | None = None, key: str = "query_id") -> DataFrame:
    """Add ``rank`` from 1 by (score down, id up); the limit is pushed below
    the shuffle by the window group limit."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("id"))
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def knn(
    corpus: DataFrame, queries: DataFrame, k: int, *, exclude_self: bool = False,
    penalty: str | None = None, max_bytes: int = vb.BROADCAST_BYTES,
    block_rows: int = vb.BLOCK_ROWS, width: int | None = None,
) -> DataFrame:
    """Exact top-k of ``corpus`` per query: ``query_id, id, score, rank``.

    ``queries`` is ``(query_id, embedding)``.  A filter belongs on ``corpus``
    before the call, so that it acts inside the ranking.  ``penalty`` names a
    corpus column subtracted from the cosine; the score returned is the one
    that ranked.  Non-finite scores never rank.
    """
    extra = [penalty] if penalty else []
    corpus = corpus.select("id", "embedding", *extra)
    queries = queries.select("query_id", "embedding")
    held = vb.hold_if_small(queries, "query_id", "embedding", max_bytes=max_bytes, width=width)
    best_bytes = np.inf if held is None else 16 * k * len(held.ids)
    if 4 * best_bytes <= max_bytes:
        return ranked(_knn_held_queries(corpus, held, k, exclude_self, penalty), k)
    # Each task would bring forth a list of every query: a corpus that fits is held instead.
    side = vb.hold_if_small(corpus, "id", "embedding", extra, max_bytes=max_bytes)
    if side is not None:
        hits = _knn_held_corpus(queries, side, k, exclude_self, penalty)
    elif best_bytes <= 2 * max_bytes:
        hits = _knn_held_queries(corpus, held, k, exclude_self, penalty)
    else:
        hits = _knn_blocks(corpus, queries, k, exclude_self, penalty, block_rows)
    return ranked(hits, k)


def _knn_held_queries(corpus, held, k, exclude_self, penalty):
    """Queries in every task, corpus streamed past them; one top-k per task.
    The caller has checked that queries times k fit a task."""
    handle = corpus.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        best = Best(handle.value.ids, handle.value.vectors, k, exclude_self)
        for batch in batches:
            if len(batch) and len(best.q):
                best.meet(vb.longs(batch["id"]), vb.matrix(batch["embedding"]),
                          vb.doubles(batch[penalty]) if penalty else None)
        yield from best.hits()

    return spread(corpus).mapInArrow(run, HIT_SCHEMA)


def _knn_held_corpus(queries, held, k, exclude_self, penalty):
    handle = queries.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        c = handle.value
        step = max(1, ball_tree.SCORES // (4 * k))
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                best = Best(vb.longs(batch["query_id"]), vb.matrix(batch["embedding"]), k, exclude_self)
                best.meet(c.ids, c.vectors, np.asarray(c.extra[penalty], float) if penalty else None)
                yield from best.hits()

    return spread(queries).mapInArrow(run, HIT_SCHEMA)


def _knn_blocks(corpus, queries, k, exclude_self, penalty, block_rows):
    """Both sides large.  A query first visits the leaf it is nearest to; the k-th best score there, or
    what the leaves' own bounds guarantee, then says which other leaves can still rank."""
    want = k + 1 if exclude_self else k
    homes, tree = ball_tree.build(corpus, block_rows, penalty)

    @ball_tree.masked
    def kernel(visitors: pa.RecordBatch, table: pa.Table, hm: np.ndarray, mask: np.ndarray | None = None):
        floor = vb.doubles(visitors["floor"]) if "floor" in visitors.schema.names else None
        best = Best(vb.longs(visitors["id"]), vb.matrix(visitors["embedding"]), k, exclude_self, floor)
        best.meet(vb.longs(table["id"]), hm, ball_tree.offsets_of(table, penalty), mask)
        yield from best.hits()

    def nearest(batch, least, most, angles, t):
        named = np.zeros(angles.shape, bool)
        if len(t.leaves):
            # With penalties the best promise, not the angle, tells where good scores are.
            home = most.argmax(axis=1) if penalty else angles.argmin(axis=1)
            named[np.arange(len(named)), home] = True
            guaranteed = _guaranteed(least, t.rows[t.leaves], want)
        else:
            home, guaranteed = np.zeros(len(named), np.int64), np.full(len(named), -np.inf)
        return named, {"seen": home.astype(np.int32), "floor": guaranteed}

    asked = queries.withColumnRenamed("query_id", "id")
    first = reliable_checkpoint(ball_tree.routes(tree, asked, nearest, ", seen int, floor double"))
    hits = reliable_checkpoint(best_in_tasks(
        ball_tree.visit(tree, homes, first.drop("seen", "floor"), kernel, HIT_SCHEMA, _tile(tree)), k))

    def can_rank(batch, least, most, angles, t):
        floor = vb.doubles(batch["floor"])
        named = most >= floor[:, None]
        named[np.arange(len(named)), vb.longs(batch["seen"])] = False
        return named, {}

    # With k hits or more, the k-th is a floor (ties of it may still rank by id).
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    kth = hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("kth"))
    onward = first.drop("targets").join(kth, "id", "left").withColumn(
        "floor", F.greatest("floor", F.coalesce("kth", F.lit(float("-inf"))))).drop("kth")
    if len(tree.leaves) < 2:
        return hits
    routed = reliable_checkpoint(ball_tree.routes(tree, onward, can_rank).drop("seen"))
    return hits.unionByName(best_in_tasks(
        ball_tree.visit(tree, homes, routed, kernel, HIT_SCHEMA, _tile(tree)), k))


def _guaranteed(least: np.ndarray, rows: np.ndarray, want: int) -> np.ndarray:
    """The score that ``want`` rows are sure to reach, from the leaves' least scores and sizes alone."""
    order = np.argsort(-least, axis=1)
    enough = np.cumsum(rows[order], axis=1) >= want
    at = np.argmax(enough, axis=1)
    who = np.arange(len(least))
    return np.where(enough.any(axis=1), least[who, order[who, at]], -np.inf)


def similar_to(vectors: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Neighbours of stored items, self left out: ``queries`` holds ``id``."""
    asked = vectors.join(queries.select("id").distinct(), "id", "left_semi")
    return knn(vectors, asked.withColumnRenamed("id", "query_id"), k,
               exclude_self=True, **options)


def isolation(vectors: DataFrame, k: int = 10, **options) -> DataFrame:
    """``id, isolation``: one minus the mean cosine of the k nearest others.
    With fewer than k others all of them count; a lone vector has no row."""
    near = knn(vectors, vectors.withColumnRenamed("id", "query_id"), k,
               exclude_self=True, **options)
    return near.groupBy(F.col("query_id").alias("id")).agg(
        (F.lit(1.0) - F.avg("score")).alias("isolation"))


def exact_ranks(
    corpus: DataFrame, queries: DataFrame, penalty: str | None = None,
    max_bytes: int = vb.BROADCAST_BYTES, block_rows: int = vb.BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank0``: corpus rows scoring strictly above the query's own
    target.  ``queries`` is ``(query_id, embedding, own)``, the target's score.
    """
    extra = [penalty] if penalty else []
    corpus = corpus.select("id", "embedding", *extra)
    queries = queries.select("query_id", "embedding", "own")
    schema = "query_id long, above long"
    held = vb.hold_if_small(queries, "query_id", "embedding", ["own"], max_bytes=max_bytes)

    def above(qm, own, cm, off, mask=None):
        out, own = np.zeros(len(qm), np.int64), np.round(own, 12)  # copies of the target tie with it
        if off is not None:
            fine = np.isfinite(off) | np.isneginf(off)  # others bring no score above anything
            cm, off = cm[fine], off[fine]
            mask = None if mask is None else mask[:, fine]
        if not len(cm) or not len(qm):
            return out
        step, slack = chunk(len(cm)), margin(qm, cm, off)
        single = cm.astype(np.float32) if slack == slack else None
        for lo in range(0, len(qm), step):
            q, mine = qm[lo:lo + step], own[lo:lo + step]
            if single is not None:
                # Single precision settles all but the scores next to the own one.
                s = q.astype(np.float32) @ single.T
                if off is not None:
                    s -= off.astype(np.float32)[None, :]
                over = s > -_below(-mine - slack)[:, None]
                near = (s >= _below(mine - slack)[:, None]) & ~over
                if mask is not None:
                    over &= mask[lo:lo + step]
                    near &= mask[lo:lo + step]
                if np.count_nonzero(near) <= near.size // 8:
                    r, c = np.nonzero(near)
                    scores = pair_dots(q, cm, r, c)
                    if off is not None:
                        scores -= off[c]
                    sure = np.round(scores, 12) > mine[r]
                    out[lo:lo + step] = over.sum(axis=1) + np.bincount(r[sure], minlength=len(q))
                    continue
            scores = q @ cm.T
            if off is not None:
                scores = scores - off[None, :]
            more = np.round(scores, 12) > mine[:, None]
            out[lo:lo + step] = (more if mask is None else more & mask[lo:lo + step]).sum(axis=1)
        return out

    if held is not None:
        handle = corpus.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            q = handle.value
            total = np.zeros(len(q.ids), np.int64)
            for batch in batches:
                if len(batch) and len(q.ids):
                    off = vb.doubles(batch[penalty]) if penalty else None
                    total += above(q.vectors, q.extra["own"], vb.matrix(batch["embedding"]), off)
            yield pa.record_batch({"query_id": q.ids, "above": total})

        parts = spread(corpus).mapInArrow(run, schema)
    else:
        homes, tree = ball_tree.build(corpus, block_rows, penalty)

        def undecided(batch, least, most, angles, t):
            # A leaf wholly above counts by its size, one wholly below not at all.
            mine = vb.doubles(batch["own"])[:, None]
            over = least > mine
            return ~over & (most > mine), {"sure": over.astype(np.int64) @ t.rows[t.leaves]}

        @ball_tree.masked
        def kernel(visitors: pa.RecordBatch, table: pa.Table, hm: np.ndarray, mask: np.ndarray | None = None):
            yield pa.record_batch({"query_id": vb.longs(visitors["id"]), "above": above(
                vb.matrix(visitors["embedding"]), vb.doubles(visitors["own"]), hm,
                ball_tree.offsets_of(table, penalty), mask)})

        routed = reliable_checkpoint(ball_tree.routes(
            tree, queries.withColumnRenamed("query_id", "id"), undecided, ", sure long"))
        parts = ball_tree.visit(tree, homes, routed.drop("sure"), kernel, schema, _tile(tree)).unionByName(
            routed.select(F.col("id").alias("query_id"), F.col("sure").alias("above")))
    return parts.groupBy("query_id").agg(F.sum("above").alias("rank0"))


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame) -> Column | DataFrame:
    """Cosine of listed pairs ``(a_id, b_id)`` by two equi-joins."""
    from siftwork.functions.vector import dot

    a = left.select(F.col("id").alias("a_id"), F.col("embedding").alias("_a"))
    b = right.select(F.col("id").alias("b_id"), F.col("embedding").alias("_b"))
    return pairs.join(a, "a_id").join(b, "b_id").withColumn(
        "score", dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")
