"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are integers, floor(1024 * x).  The index is a table of blocks of up to
``BLOCK`` candidates, built once and written.  In a block every dimension has two
posting lists, of the values above and of those below the block's median, each
ordered by distance from the median; postings fall into segments of equal quantised
distance.  The impact of a segment is the query's weight times that distance.

A query takes the segments of all dimensions in descending order of impact, in
steps, and adds their quantised contributions to the block's accumulators.  After
each step a vector's score is known but for the quantisation of what it has been
given, and for the dimensions it has not been given yet, none of which adds or takes
more than the impact that the step has come to.  The best so far are scored exactly,
which gives a score that members must reach (or one is known from blocks before).
Vectors that cannot reach it are out: that is the proof.  Processing stops when what
is left is cheaper to score exactly than the postings that remain; all of it is then
scored from the integers.  Ties go to the smaller id.

Queries are a stated set; they reach the executors in blocks of about
``QUERIES`` rows (a fixed size), each against the whole index.  Within a task the
k-th score found so far carries over from block to block.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do those of another dimension than the query's;
a repeated id is a candidate once for each row and a query once for each distinct
vector; a query never meets rows of its own id; fewer than k candidates give all
of them.  Scores are 64-bit sums, exact for components below 2**20.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK = 8192
QUERIES = 4096
#: Segments on either side of the median.
LEVELS = 32
#: Steps: shares of the largest impact down to which segments are taken before the proof is tried again.
STEPS = (0.4, 0.2, 0.12, 0.07, 0.04, 0.02, 0.0)


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the integer vector, of rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(finite).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(1024.0) * e.cast("double")).cast("long")).alias("v"))


def _matrices(batch):
    """(ids, matrix) for each dimension among a batch's rows."""
    ids = np.asarray(batch.column("vec_id"))
    lists = batch.column("v")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    at = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), ids[rows], flat[at[rows][:, None] + np.arange(n)]


class Block:
    """Postings of some candidates: per dimension, rows in ascending order of value, their levels, and where each level begins on either side."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        n, dims = m.shape
        self.middle = np.sort(m, axis=0)[n // 2]
        away = m - self.middle
        self.width = np.maximum(1, -(-(np.abs(away).max(axis=0) + 1) // LEVELS))
        order = np.argsort(away, axis=0, kind="stable")
        ordered = np.take_along_axis(away, order, axis=0).T
        self.order = order.T.astype(np.uint16 if n <= 1 << 16 else np.int32)
        self.level = (np.abs(ordered) // self.width[:, None]).astype(np.uint8)
        # Postings above the middle of level k and more are those from above[k] on, those below it of level k and more those before below[k].
        edges = np.arange(LEVELS + 1)[None, :] * self.width[:, None]
        self.above = np.stack([np.searchsorted(row, e) for row, e in zip(ordered, edges, strict=True)])
        self.below = np.stack([np.searchsorted(row, np.minimum(-e, -1), side="right") for row, e in zip(ordered, edges, strict=True)])

    _PARTS = ("ids", "m", "middle", "width", "order", "level", "above", "below")

    def to_row(self) -> dict:
        """The block as a row of bytes; `of_row` takes it back."""
        small = self.m.astype(np.int32) if np.abs(self.m).max(initial=0) < 1 << 31 else self.m
        arrays = [small if name == "m" else getattr(self, name) for name in self._PARTS]
        return {"dims": self.m.shape[1], "rows": self.m.shape[0], **{name: x.tobytes() for name, x in zip(self._PARTS, arrays, strict=True)}}

    @classmethod
    def of_row(cls, row: dict) -> Block:
        self, n, dims = cls.__new__(cls), row["rows"], row["dims"]
        kinds = {"m": np.int32 if len(row["m"]) == 4 * n * dims else np.int64, "order": np.uint16 if n <= 1 << 16 else np.int32, "level": np.uint8}
        shapes = {"ids": (n,), "m": (n, dims), "middle": (dims,), "width": (dims,), "above": (dims, LEVELS + 1), "below": (dims, LEVELS + 1)}
        for name in cls._PARTS:
            setattr(self, name, np.frombuffer(row[name], kinds.get(name, np.int64)).reshape(shapes.get(name, (dims, n))))
        return self

    def search(self, q: np.ndarray, k: int, floor: int | None, own: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and exact scores of every vector that can be among the k best at or above floor, and the share of postings that was processed."""
        n, dims = self.m.shape
        mine = self.ids == own
        others = n - int(mine.sum())
        if others <= k or n < 4 * k:
            members = np.flatnonzero(~mine)
            return self._exact(members, q, floor, 0.0)
        used = np.flatnonzero(q)
        weight = np.abs(q[used])
        width = self.width[used]
        unit = weight * width
        acc = np.full(n, float((q * self.middle).sum()))  # whole numbers below 2**53
        acc[mine] = -np.inf  # never a member
        given = np.zeros(n, np.int64)
        wrong = int((weight * (width // 2)).sum())  # what quantisation can hide
        top = np.full(len(used), LEVELS)  # levels from here on are processed
        largest = int((unit * LEVELS).max(initial=0))
        done, tried, members = 0, np.empty(0, np.int64), np.arange(n)
        for step in STEPS:
            down_to = np.minimum(top, -(-int(step * largest) // np.maximum(unit, 1)))
            # The step's postings, of all dimensions: a run on either side of the middle of each.
            at = np.concatenate((self.above[used, down_to], self.below[used, top])) + np.tile(used * n, 2)
            size = np.concatenate((self.above[used, top] - self.above[used, down_to], self.below[used, down_to] - self.below[used, top]))
            place = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
            rows = self.order.ravel()[place]
            signed = np.concatenate((q[used], -q[used])).astype(np.float64)
            both = np.tile(width, 2)
            acc += np.bincount(rows, np.repeat(signed * both, size) * self.level.ravel()[place] + np.repeat(signed * (both // 2), size), n)
            given += np.bincount(rows, minlength=n)
            done += len(rows)
            top = down_to
            # A posting that has not been given lies below its dimension's level: no impact is larger than this.
            most = int((weight * np.maximum(top * width - 1, 0)).max(initial=0))
            if step > 0:
                tried = np.union1d(tried, np.argpartition(acc, n - 4 * k)[n - 4 * k :])
                tried = tried[~mine[tried]]
                if len(tried) >= k:
                    kth = int(np.partition(self.m[tried].astype(np.int64) @ q, len(tried) - k)[len(tried) - k])
                    floor = kth if floor is None else max(floor, kth)
            members = np.arange(n) if floor is None else np.flatnonzero(acc + wrong + (len(used) - given) * most >= floor)
            if floor is not None and len(members) * len(used) <= n * len(used) - done:
                break
        return self._exact(members[~mine[members]], q, floor, done / max(1, n * len(used)))

    def _exact(self, members: np.ndarray, q: np.ndarray, floor: int | None, share: float):
        scores = self.m[members].astype(np.int64) @ q
        if floor is not None:
            keep = scores >= floor
            members, scores = members[keep], scores[keep]
        return self.ids[members], scores, share


_INDEX = "dims int, rows int, " + ", ".join(f"{name} binary" for name in Block._PARTS)


def _build(batches, size: int):
    """The task's candidates in blocks."""
    names = ("dims", "rows", *Block._PARTS)
    types = [pa.int32(), pa.int32()] + [pa.binary()] * len(Block._PARTS)

    def out(block: Block) -> pa.RecordBatch:
        row = block.to_row()
        return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in zip(names, types, strict=True)], names=list(names))

    held: dict[int, list] = {}
    for batch in batches:
        for n, ids, m in _matrices(batch):
            held.setdefault(n, []).append((ids, m))
            while sum(len(i) for i, _ in held[n]) >= size:
                ids, m = (np.concatenate(x) for x in zip(*held[n], strict=True))
                yield out(Block(ids[:size], m[:size]))
                held[n] = [(ids[size:], m[size:])]
    for parts in held.values():
        ids, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(ids):
            yield out(Block(ids, m))


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The index of every row that takes part, as a table in the shared folder."""
    return written(usable(vectors, key, vector).mapInArrow(functools.partial(_build, size=block), _INDEX), "index")


def _search(batches, ids, vectors, k: int):
    """The task's k best for each query; ids and vectors: arrays of the queries of each dimension."""
    best = {n: [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids[n]) for n in ids}
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_buffer() if pa.types.is_binary(batch.column(c).type) else batch.column(c)[at].as_py() for c in batch.schema.names}
            n = row["dims"]
            if n not in ids:
                continue
            block = Block.of_row(row)
            for j, (own, q) in enumerate(zip(ids[n], vectors[n], strict=True)):
                have_ids, have = best[n][j]
                got_ids, got, _ = block.search(q, k, int(have[-1]) if len(have) == k else None, own)
                all_ids, all_scores = np.concatenate((have_ids, got_ids)), np.concatenate((have, got))
                keep = np.lexsort((all_ids, -all_scores))[:k]
                best[n][j] = all_ids[keep], all_scores[keep]
    rows = [(int(own), int(i), int(s), j + (n << 32)) for n in ids for j, (own, (found, scores)) in enumerate(zip(ids[n], best[n], strict=True)) for i, s in zip(found, scores, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1, 2, 3)], names=["query_id", "vec_id", "score", "query_row"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    return search_index(index(vectors, key, vector), queries, k, key, vector)


def search_index(table: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The same, over an index made before."""
    spark = table.sparkSession
    asked = written(usable(queries, key, vector).distinct(), "queries")
    n = asked.count()
    blocks = max(1, -(-n // QUERIES))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect() if n else []
        if not rows:
            continue
        dims = sorted({len(r["v"]) for r in rows})
        ids = {d: np.array([r["vec_id"] for r in rows if len(r["v"]) == d]) for d in dims}
        vecs = {d: np.array([r["v"] for r in rows if len(r["v"]) == d], np.int64) for d in dims}
        found = table.mapInArrow(functools.partial(_search, ids=ids, vectors=vecs, k=k), "query_id long, vec_id long, score long, query_row long")
        best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
        one = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
