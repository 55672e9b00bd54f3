"""Sketches and near-duplicates of texts (survey A7, A9-A13, A19, J14, J15, F15, E6)."""

from __future__ import annotations

import functools
import mmap

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import settle

SEEDS, BANDS = 64, 8


#: Seeds are lines over 32-bit digests, modulo the next prime over 2**32.
_PRIME = 4294967311


def _lines(seeds: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, seeds + 1, dtype=np.uint64)
    return (np.uint64(1103515245) * i) % np.uint64(2147483647), np.uint64(12345) * i


#: Bytes of a text whose grams are listed at once, and rows whose sketches are made at once.
_PIECE, _ROWS = 1 << 20, 500


@functools.cache
def _known() -> tuple[np.ndarray, np.ndarray]:
    """Digests of 3-byte grams, filled in as a worker meets them, and which are filled in."""
    pages = lambda n: mmap.mmap(-1, n, flags=mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS)  # noqa: E731  only those that are touched take memory; numpy asks for huge ones
    return np.frombuffer(pages(4 << 24), np.uint32), np.frombuffer(pages(1 << 24), bool)


def _digests(raw) -> np.ndarray:
    """Digests of the distinct 3-byte grams of a text (1-byte grams under 3 bytes)."""
    import hashlib

    digest = lambda g: int.from_bytes(hashlib.md5(g.hex().upper().encode()).digest()[:4])
    if len(raw) < 3:
        return np.array([digest(bytes([c])) for c in set(bytes(raw))], np.uint64)
    grams = np.zeros(0, np.uint32)
    for at in range(0, len(raw) - 2, _PIECE):
        v = np.frombuffer(raw, np.uint8, min(_PIECE + 2, len(raw) - at), at).astype(np.uint32)
        grams = np.union1d(grams, v[:-2] << 16 | v[1:-1] << 8 | v[2:]) if at else np.unique(v[:-2] << 16 | v[1:-1] << 8 | v[2:])
    digests, known = _known()
    new = grams[~known[grams]]
    if len(new):
        digests[new] = [digest(int(g).to_bytes(3)) for g in new]
        known[new] = True
    return digests[grams].astype(np.uint64)


def _least(batches, seeds: int):
    """Sketches made where the text is: for each seed the least value of its distinct grams; a few rows at a time, as long texts and sketches take memory."""
    a, b = _lines(seeds)
    for batch in (part.slice(at, _ROWS) for part in batches for at in range(0, len(part), _ROWS)):
        least = np.full((len(batch), seeds), np.iinfo(np.int64).max, np.uint64)
        none = np.zeros(len(batch), bool)
        for i, v in enumerate(batch.column(1).cast(pa.large_binary())):
            h = _digests(v.as_buffer() if v.is_valid else b"")
            none[i] = not len(h)
            for at in range(0, len(h), 512):
                np.minimum(least[i], ((h[at : at + 512, None] * a + b) % np.uint64(_PRIME)).min(axis=0), out=least[i])
        values = pa.array(least.astype(np.int64).ravel(), mask=np.repeat(none, seeds))
        lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * seeds, values)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "sketch"])
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def minhash(df: DataFrame, key: str, text: str, seeds: int = SEEDS) -> DataFrame:
    """For each seed the least digest of the text's grams: key, sketch; null digests for empty texts.  One row in, one row out: no gram is ever a row."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.encode(text, "UTF-8").alias("raw")).mapInArrow(functools.partial(_least, seeds=seeds), f"`{key}` {kind}, sketch array<long>")


def bands(sketches: DataFrame, key: str, seeds: int = SEEDS, n: int = BANDS, more: tuple[str, ...] = ()) -> DataFrame:
    """A10: (key, band, value of the band's rows), with more columns of the sketches where asked for."""
    rows = seeds // n
    each = F.array(*[F.struct(F.lit(b).alias("band"), F.slice("sketch", b * rows + 1, rows).alias("slot")) for b in range(n)])
    return sketches.select(key, *more, F.explode(each).alias("x")).select(key, *more, "x.band", "x.slot")


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def lsh_links(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Links between distinct texts that share a band and reach the threshold."""
    return links_of_sketches(minhash(df, key, text).where("sketch[0] IS NOT NULL"), key, threshold)


#: Members of a slot that meet in one task, about; those of a larger slot are dealt into blocks, and each two blocks meet.
BLOCK = 2048
#: Pairs and rows that a task gets, about.
PAIRS_A_TASK, ROWS_A_TASK = 12_000_000, 50_000


def links_of_sketches(sketches: DataFrame, key: str, threshold: float, seeds: int = SEEDS, n: int = BANDS) -> DataFrame:
    """(a, b, similarity) of class representatives.

    Equal sketches are joined once: a class is named by its smallest key, and
    ``classes`` says which key is of which class.  So a thousand copies of a text
    are one row here, and no link between different texts is lost.

    Sketches go to their slots, and all pairs of a slot are compared there; only links
    leave the task.  A pair belongs to the first band that it shares, so none is made
    twice and nothing has to be made distinct afterwards.
    """
    kind = sketches.schema[key].dataType.simpleString()
    distinct = settle(sketches.groupBy("sketch").agg(F.min(key).alias("rep")))
    slotted = lambda df: bands(df, "rep", seeds, n, ("sketch",)).withColumn("slot", F.xxhash64("slot"))  # noqa: E731  values are compared where members meet
    sizes = settle(slotted(distinct).groupBy("band", "slot").agg(F.count("*").alias("n")).where("n > 1"))
    pairs = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    tasks = max(sketches.sparkSession.sparkContext.defaultParallelism, distinct.count() * n // ROWS_A_TASK)
    members = slotted(distinct.repartition(int(tasks), "rep"))  # what a task sends is held in memory
    large = sizes.where(F.col("n") > BLOCK).select("band", "slot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))  # n / BLOCK rows a band at most
    own = members.join(F.broadcast(large), ["band", "slot"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    met = own.select("slot", "band", "own", "rep", "sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = met.select("slot", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", (F.col("own") > F.col("other")).alias("second"), "sketch")
    dealt = cells.repartition(int(max(tasks, pairs // PAIRS_A_TASK)), "slot", "band", "i", "j").sortWithinPartitions("slot", "band", "i", "j", "rep")
    return dealt.mapInArrow(functools.partial(_linked, seeds=seeds, n=n, threshold=threshold), f"a {kind}, b {kind}, similarity double")


#: Members of a cell whose pairs are made one by one, with those of other cells; entries of a rectangle of comparisons, and links in a batch.
FEW, RECTANGLE, LINKS = 64, 1 << 16, 1 << 16


def _linked(batches, seeds: int, n: int, threshold: float):
    """The links of each cell: rows come sorted by cell, then by representative."""
    kept = None
    for batch in batches:
        batch = batch if kept is None else pa.concat_batches([kept, batch])
        ends = _cell_ends(batch)
        kept = batch.slice(ends[-2]) if len(ends) > 1 else batch  # its last cell may go on
        yield from _links_of(batch.slice(0, ends[-2] if len(ends) > 1 else 0), seeds, n, threshold)
    if kept is not None:
        yield from _links_of(kept, seeds, n, threshold)


def _cell_ends(batch) -> np.ndarray:
    differs = np.zeros(max(len(batch) - 1, 0), bool)
    for c in ("slot", "band", "i", "j"):
        v = batch.column(c).to_numpy()
        differs |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(differs) + 1, len(batch)) if len(batch) else np.zeros(0, np.int64)


def _links_of(batch, seeds: int, n: int, threshold: float):
    """The links of whole cells."""
    if not len(batch):
        return
    rep, found, waiting = batch.column("rep"), [], 0
    for x, y, same in _compared(batch, seeds, n, threshold):
        found.append((x, y, same))
        waiting += len(x)
        if waiting >= LINKS:
            yield _as_links(rep, found, seeds)
            found, waiting = [], 0
    if waiting:
        yield _as_links(rep, found, seeds)


def _as_links(rep, found: list, seeds: int):
    x, y, same = (np.concatenate(v) for v in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([rep.take(pa.array(x)), rep.take(pa.array(y)), pa.array(same / seeds)], names=["a", "b", "similarity"])


def _compared(batch, seeds: int, n: int, threshold: float):
    """(row, later row, equal positions) of the links of whole cells; the rows of a cell are sorted by representative."""
    values = batch.column("sketch").flatten().to_numpy().reshape(-1, seeds)
    values = values.astype(np.uint32) if values.min() >= 0 and values.max() < 1 << 32 else values
    band, second = batch.column("band").to_numpy(), batch.column("second").to_numpy(zero_copy_only=False)
    within = batch.column("i").to_numpy() == batch.column("j").to_numpy()
    ends = _cell_ends(batch)
    starts = np.append(0, ends[:-1])
    rows = seeds // n
    least = next((c for c in range(seeds + 1) if c / seeds >= threshold), seeds + 1)
    few = ends - starts <= FEW
    row = np.concatenate([np.arange(0)] + [np.arange(s, e) for s, e in zip(starts[few], ends[few], strict=True) if e - s > 1])
    last = np.repeat(ends[few], ends[few] - starts[few])[np.repeat(ends[few] - starts[few], ends[few] - starts[few]) > 1]
    step = max(1, RECTANGLE // FEW // 8)
    for at in range(0, len(row), step):
        r, more = row[at : at + step], last[at : at + step] - row[at : at + step] - 1  # each row meets those after it in its cell
        x = np.repeat(r, more)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(more) - more, more)
        met = within[x] | (second[x] != second[y])
        x, y = x[met], y[met]
        equal = values[x] == values[y]
        shared = equal[:, : n * rows].reshape(-1, n, rows).all(axis=2)
        same = equal.sum(axis=1)
        ok = shared[np.arange(len(x)), band[x]] & (shared.argmax(axis=1) == band[x]) & (same >= least)
        yield x[ok], y[ok], same[ok]
    for s, e in zip(starts[~few], ends[~few], strict=True):
        here = np.arange(s, e, dtype=np.int32)
        left, right = (here, here) if within[s] else (here[~second[s:e]], here[second[s:e]])
        across, down = np.ascontiguousarray(values[left].T), np.ascontiguousarray(values[right].T)
        step = max(1, RECTANGLE // max(1, len(right)))
        for at in range(0, len(left), step):
            past = at if within[s] else 0  # below the diagonal all are met already
            same, ok = _rectangle(across[:, at : at + step], down[:, past:], band[s], rows, n)
            ok &= same >= least
            if within[s]:
                ok &= np.arange(ok.shape[1]) > np.arange(ok.shape[0])[:, None]
            x, y = np.repeat(left[at : at + step], ok.sum(axis=1)), np.broadcast_to(right[past:], ok.shape)[ok]
            yield (x, y, same[ok]) if within[s] else (np.minimum(x, y), np.maximum(x, y), same[ok])


def _rectangle(across: np.ndarray, down: np.ndarray, band: int, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal positions of each two sketches, and whether the band is the first that they share."""
    shape = across.shape[1], down.shape[1]
    same, first = np.zeros(shape, np.uint8 if len(across) < 256 else np.int32), np.ones(shape, bool)
    equal, shared = np.empty(shape, bool), np.empty(shape, bool)
    for at in range(len(across)):  # positions beyond the last band count, too
        k = at // rows
        np.equal(across[at, :, None], down[at], out=equal)
        np.add(same, equal.view(np.uint8), out=same)
        if k > band or k >= n:
            continue
        if at % rows:
            shared &= equal
        else:
            shared[:] = equal
        if at % rows == rows - 1:
            first &= shared if k == band else ~shared
    return same, first


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rep): the class of equal sketches of each key."""
    sketches = minhash(df, key, text).where("sketch[0] IS NOT NULL")
    reps = sketches.groupBy("sketch").agg(F.min(key).alias("rep"))
    return sketches.join(reps, "sketch").select(key, "rep")


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal texts of two or more: representative, size, extra copies; larger groups first."""
    g = df.groupBy(F.md5(F.col(text)).alias("digest")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))
    return g.where("n >= 2").select("rep", "digest", "n", (F.col("n") - 1).alias("extra"))


def _votes(batches, pattern: str):
    import hashlib
    import re

    words = re.compile(pattern)
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            counts: dict[str, int] = {}
            for w in words.findall(text or ""):
                counts[w] = counts.get(w, 0) + 1
            if not counts:
                out.append(None)
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in counts), np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
            n = np.fromiter(counts.values(), np.int64)
            out.append("".join("1" if v > 0 else "0" for v in ((2 * bits - 1) * n[:, None]).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[batch.schema.names[0], "simhash"])


def simhash_votes(df: DataFrame, key: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """Key, simhash (64 binary digits): a bit is 1 when the votes of a text's features for it outweigh those against; null without a feature.  Voted where the text is."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("t")).mapInArrow(functools.partial(_votes, pattern=pattern), f"`{key}` {kind}, simhash string")


def band_of(similarity: Column) -> Column:
    """What a similarity means."""
    return F.when(similarity > 0.95, "Refactor").when(similarity > 0.85, "Zombie").otherwise("NewCode")


def sign_bits(vector: Column) -> Column:
    """A 64-component vector's signs as one long."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none))
    return F.aggregate(bits, none, lambda a, x: a.bitwiseOR(x))


def hamming_links(df: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Pairs of distinct bit strings within `most` bits; equal strings are one representative.

    Pigeonhole over pieces, two of which must agree: with most + 2 pieces at least two
    are untouched, so a key is a pair of pieces and its values are many.
    """
    n = most + 2
    edges = [64 * k // n for k in range(n + 1)]
    reps = df.groupBy(bits).agg(F.min(key).alias("rep"))
    piece = lambda k: F.shiftrightunsigned(F.shiftleft(F.col(bits), 64 - edges[k + 1]), 64 - (edges[k + 1] - edges[k]))
    keys = F.array(*[F.struct(F.lit(i * n + j).alias("which"), piece(i).alias("u"), piece(j).alias("v")) for i in range(n) for j in range(i + 1, n)])
    p = settle(reps.select("rep", bits, F.explode(keys).alias("x")).select("rep", bits, "x.which", "x.u", "x.v"))
    j = p.alias("x").join(p.alias("y"), ["which", "u", "v"]).where("x.rep < y.rep")
    distance = F.bit_count(F.col(f"x.{bits}").bitwiseXOR(F.col(f"y.{bits}")))
    return j.where(distance <= most).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), distance.cast("int").alias("distance")).distinct()


def enough(text: Column) -> Column:
    """whether a text has the 3-byte grams that a sketch needs: five at least."""
    return F.octet_length(text) - 2 >= 5


def collisions(current: DataFrame, history: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Changes of the same repository that resemble a current one: (repo_slug, pr_number, other, similarity); both: repo_slug, pr_number, sketch.  A change never meets itself, and numbers of 0 take no part."""
    each = lambda df, n: df.where("pr_number != 0").select("repo_slug", F.col("pr_number").alias(n), F.col("sketch").alias(f"s_{n}"), F.explode(_slots("sketch")).alias("slot"))
    met = each(current, "pr_number").join(each(history, "other"), ["repo_slug", "slot"]).where("pr_number != other").drop("slot").distinct()
    return met.select("repo_slug", "pr_number", "other", jaccard(F.col("s_pr_number"), F.col("s_other")).alias("similarity")).where(F.col("similarity") >= threshold)


def _slots(sketch: str) -> Column:
    rows = SEEDS // BANDS
    return F.array(*[F.struct(F.lit(b).alias("band"), F.slice(sketch, b * rows + 1, rows).alias("slot")) for b in range(BANDS)])


#: Rows and columns of the counting sketch.
DEPTH, COLUMNS = 4, 2048


def count_min(events: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """A Count-Min sketch as a table (row, cell, n): DEPTH times COLUMNS rows at most, whatever the events."""
    cells = F.array(*[F.struct(F.lit(k).alias("row"), F.pmod(F.xxhash64(F.lit(k), key), F.lit(COLUMNS)).alias("cell")) for k in range(DEPTH)])
    one = events.select((weight if weight is not None else F.lit(1).cast("long")).alias("w"), F.explode(cells).alias("c"))
    return one.groupBy("c.row", "c.cell").agg(F.sum("w").alias("n"))


def estimates(keys: DataFrame, key: str, sketch_: DataFrame) -> DataFrame:
    """What the sketch says of each key: its count or more."""
    cells = F.array(*[F.struct(F.lit(k).alias("row"), F.pmod(F.xxhash64(F.lit(k), key), F.lit(COLUMNS)).alias("cell")) for k in range(DEPTH)])
    one = keys.select(key).distinct().select(key, F.explode(cells).alias("c")).select(key, "c.row", "c.cell")
    return one.join(F.broadcast(sketch_), ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def fp_probability(pardoned: Column, confirmed: Column) -> Column:
    """Laplace estimate that a finding is false."""
    return (pardoned + 1) / (pardoned + confirmed + 2)
