"""Best-fit packing of tokenised documents into sequences, with vector capacities.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared piece lengths).  Pieces go, longest first, to the open sequence that
fits best under every constraint: the one whose residual, after the piece, has
the least weighted norm (``rule="norm"``), or whose residual has the largest
weighted dot product with the piece's demand (``rule="dot"``).

A piece's demand depends on its length alone, so packing needs only how many
pieces each length has: at most ``capacity`` numbers, whatever the corpus holds.
The driver packs that histogram, handling equal sequences as one group with a
count; a placement step ends a length or a group, so the plan's size depends on
the number of lengths and not on the number of documents.  Tasks number their
pieces of each length, running sums over the tasks make that a rank, and the
n-th piece of a length goes where the plan's n-th place of that length is.

A limit on documents ends sequences of very short pieces, one on attention cost those
of few long ones; a whole piece costs the square of the token capacity, so no smaller
cost holds all pieces (a piece that fits nowhere is an error), and at that cost only
the other two limits can end a sequence.

Only documents longer than the capacity are cut, into pieces of the capacity
after a first piece that takes the remainder.

Defined results: a null or empty text is its end token alone; equal rows are
packed each on their own; an empty table gives an empty plan.  Which of the
pieces of one length takes which of its places follows the order of the input's
partitions and rows.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from . import tokens
from .shared import written

CAPACITY = 2048
END = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches, path: str, capacity: int, end: int, packed: bytes):
    tokens.take(packed)
    e = tokens.encoder(path)
    part = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)  # this task's pieces of each length so far
    tail = np.array([end], "<u4")
    for batch in K.each(batches, K.SLICE):
        ids_column = batch.column(0)
        column = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        for a in range(0, len(column), 256):
            texts = column[a : a + 256].to_pylist()
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            for row, ids in e.encode(texts):
                parts[row].append(ids)
            out = []
            for row, got in enumerate(parts):
                ids = np.concatenate([*got, tail]).astype("<u4", copy=False)
                bounds = piece_bounds(len(ids), capacity)
                out += [(row, k, s, t - s, zlib.crc32(ids[s:t])) for k, (s, t) in enumerate(zip(bounds, bounds[1:], strict=False))]
            rows, length = [o[0] for o in out], np.array([o[3] for o in out])
            nth = _nth(length) + seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [ids_column[a : a + 256].take(pa.array(rows)), *(pa.array([o[j] for o in out], t) for j, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64())))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(out), pa.int32()), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


def _nth(values: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    return out


def piece_bounds(n: int, capacity: int) -> list[int]:
    """Cuts of a document of n tokens: the remainder first, then whole pieces."""
    if n <= capacity:
        return [0, n]
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


@dataclass
class Plan:
    """Runs of places: the pieces of `length` numbered from `rank` on go, one each, to `count` sequences from `sequence` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> Plan:
    """Pack a histogram of lengths, longest first, each to the best fit under all three capacities."""
    documents = documents or capacity
    cost = cost or capacity * capacity
    runs: list[tuple[int, int, int, int, int]] = []
    # Groups of equal open sequences by residual tokens; within, by (documents, cost) left: [first sequence, count].
    open_: dict[int, dict[tuple[int, int], list[list[int]]]] = {}
    sequences = 0

    def put(tokens_left: int, docs_left: int, cost_left: int, first: int, count: int) -> None:
        if tokens_left > 0 and docs_left > 0 and cost_left > 0:
            open_.setdefault(tokens_left, {}).setdefault((docs_left, cost_left), []).append([first, count])

    def value(left: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        shares = [(l / c, n / c) for l, n, c in zip(left, need, (capacity, documents, cost), strict=True)]
        if rule == "dot":
            return -sum(w * l * n for w, (l, n) in zip(weights, shares, strict=True))
        return sum(w * (l - n) ** 2 for w, (l, n) in zip(weights, shares, strict=True))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        need = (length, 1, length * length)
        if length > capacity or need[2] > cost:
            raise ValueError(f"a piece of {length} tokens fits in no sequence")
        # The candidates change only as groups are used up, so they are ranked once for each length.
        fits = [(value((t, d, c), need), t, d, c) for t in open_ if t >= length for d, c in open_[t] if d >= 1 and c >= need[2]]
        heapq.heapify(fits)
        while todo and fits:
            _, t, d, c = heapq.heappop(fits)
            groups = open_[t][d, c]
            while todo and groups:
                first, count = groups.pop()
                used = min(count, todo)
                if used < count:
                    groups.append([first + used, count - used])
                runs.append((length, rank, used, first, capacity - t))
                rank += used
                todo -= used
                put(t - length, d - 1, c - need[2], first, used)
                if t - length >= length and d > 1 and c >= 2 * need[2] and open_[t - length][d - 1, c - need[2]] == [[first, used]]:
                    heapq.heappush(fits, (value((t - length, d - 1, c - need[2]), need), t - length, d - 1, c - need[2]))
            if not groups:
                del open_[t][d, c]
                if not open_[t]:
                    del open_[t]
        if todo:
            # New sequences take as many pieces of this length as they hold; the last may take fewer.
            each = min(capacity // length, documents, cost // need[2])
            full, rest = divmod(todo, each)
            for count, size in ((full, each), (1 if rest else 0, rest)):
                if count:
                    for k in range(size):
                        runs.append((length, rank, count, sequences, k * length))
                        rank += count
                    put(capacity - size * length, documents - size, cost - size * need[2], sequences, count)
                    sequences += count
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(columns[0], columns[1], columns[2], columns[3], columns[4], sequences)


def _place(batches, p: Plan, key: np.ndarray, stride: int):
    for batch in batches:
        length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
        at = np.searchsorted(key, length * stride + rank, side="right") - 1
        sequence = p.sequence[at] + rank - p.rank[at]
        names = [c for c in batch.schema.names if c != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(p.offset[at])], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, documents: int | None = None, cost: int | None = None, rule: str = "norm") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(functools.partial(_pieces, path=path, capacity=capacity, end=end, packed=tokens.packed_classes()), f"{PIECES}, part int, nth long")
    # Few numbers a document, written once: tokens are made once, and the numbering reads what the histogram has read.
    table = written(cut, "pieces")
    sizes = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    p = plan(totals, capacity, documents, cost, rule=rule)
    stride = max(totals.values(), default=0) + 1
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(columns).mapInArrow(functools.partial(_place, p=p, key=p.length * stride + p.rank, stride=stride), f"{PIECES}, sequence_id long, offset long")
