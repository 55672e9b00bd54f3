"""Edited copies: documents whose sets of five-word shingles resemble each other by 0.8 or more.

A 64-bit SimHash within two bits finds next to no edited copies (half a dozen
changed words move 3 to 8 bits), so `simhash.keep_one` adds these links to its own.

Sketch.  The 256 minima of a text's 32-bit shingle hashes under 256 multiplications,
16 bits of each kept; equal sketches are one class, and the share of equal minima
estimates the Jaccard similarity of two shingle sets (standard error 0.025 at 0.8).
The estimate only drops pairs that are more than `SLACK` (four standard errors)
below; what stays is decided on the sets of shingles themselves.

Search.  The first 48 minima make 12 keys of 4.  Two texts of similarity s share a
key with probability 1 - (1 - s**4)**12: 0.998 at 0.8, 0.01 at 0.17.  First every
text meets the first members of `FIRST` of its keys, which joins groups of copies by
a few rows a text.  After that only pairs of texts that are not connected yet are
looked at: all pairs of a key with up to `PAIRS_UP_TO` sketches, and those of larger
keys with `HUBS` members a key (the first in as many hashed orders).  What is left in
larger keys goes through an exact prefix filter: in one order of all shingles, seldom
ones first, two sets of similarity s have their first common shingle among the first
(1 - s) of each, and it leaves room for the overlap they need; for whole components
the same bounds hold with their smallest and largest sets.  So a group that shares a
template costs little unless its members do resemble each other.

Defined results: null and empty texts, and texts without a word, have no sketch and
no link; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import functools
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import written

SHINGLE = 5
MINIMA = 256
SLACK = 0.1
BANDS, ROWS = 12, 4
PAIRS_UP_TO = 24
FIRST = 3
HUBS = 4
_SEED = 7
_CHUNK = 512
_BLOCK = 1 << 20
#: Shingles are counted by this many upper bits of their hashes; any count gives a right order.
_BITS = 20
_TEXTS = 256

_rng = np.random.default_rng(20)
_MULTIPLIERS = _rng.integers(1 << 30, 1 << 31, (MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FACTORS = _rng.integers(1 << 62, 1 << 63, 2 * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Sketcher:
    """Minima of a text that comes in parts of whole words."""

    def __init__(self) -> None:
        self.least = np.full(MINIMA, ~np.uint32(0))
        self.tail = np.zeros(0, np.uint64)
        self.any = False

    def add(self, words: list[bytes]) -> None:
        import xxhash

        fresh = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(_SEED)), np.uint64, len(words))
        codes = np.concatenate((self.tail, fresh))
        m = len(codes) - SHINGLE + 1
        if m > 0:
            self._take(sum(codes[k : k + m] * _PLACES[k] for k in range(SHINGLE)))
            codes = codes[m:]
        self.tail = codes

    def _take(self, h: np.ndarray) -> None:
        self.any = True
        codes = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(codes), _CHUNK):
            np.minimum(self.least, (codes[None, at : at + _CHUNK] * _MULTIPLIERS).min(axis=1), out=self.least)

    def result(self) -> tuple[bytes, list[int]] | None:
        """The sketch and its band keys."""
        if not self.any:
            if not len(self.tail):
                return None
            self._take((self.tail * _PLACES[: len(self.tail)]).sum(keepdims=True) + np.uint64(len(self.tail)))
        mix = self.least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS) * _FACTORS[:ROWS]
        mix ^= mix >> np.uint64(29)
        keys = (mix * _FACTORS[ROWS:]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)
        # Minima have small upper bits; the lower ones are evenly spread.
        return (self.least & np.uint32(0xFFFF)).astype("<u2").tobytes(), keys.view(np.int64).tolist()


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of a text's shingle hashes, of the words that the sketch takes."""
    import xxhash

    parts, codes, at = [], np.zeros(0, np.uint64), 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = text[at:end].lower().split()
        at = end
        codes = np.concatenate((codes, np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(_SEED)), np.uint64, len(words))))
        m = len(codes) - SHINGLE + 1
        if m > 0:
            parts.append(np.unique(sum(codes[k : k + m] * _PLACES[k] for k in range(SHINGLE))))
            codes = codes[m:]
    if not parts and len(codes):
        parts.append((codes * _PLACES[: len(codes)]).sum(keepdims=True) + np.uint64(len(codes)))
    return np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def _sets(batches):
    """Rows (rep, s): the shingle set of each text."""
    for batch in K.each(batches, _TEXTS):
        column = batch.column("text").cast(pa.large_binary())
        sets = [shingles(v.as_buffer().to_pybytes()).tobytes() for v in column]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "s"])


def _hashes(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in column]


def _bins(batches):
    """How many shingles of the task's sets fall into each bin."""
    total = np.zeros(1 << _BITS, np.int64)
    for batch in K.each(batches, _TEXTS):
        for h in _hashes(batch.column("s")):
            total += np.bincount((h >> np.uint64(64 - _BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])


def _prefixes(batches, counts: np.ndarray, similarity: float):
    """Rows (key, pos, n, rep, comp): the first shingles of each set of n, among which a set that resembles it has one too."""
    for batch in K.each(batches, _TEXTS):
        keys, places, sizes, rows = ([np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int64))
        for row, h in enumerate(_hashes(batch.column("s"))):
            n = len(h)
            m = n - int(np.ceil(similarity * n - 1e-9)) + 1
            order = np.lexsort((h, counts[(h >> np.uint64(64 - _BITS)).astype(np.int64)]))[:m]
            keys.append(h[order])
            places.append(np.arange(m))
            sizes.append(np.full(m, n))
            rows.append(np.full(m, row))
        at = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes)), batch.column("rep").take(at), batch.column("comp").take(at)],
            names=["key", "pos", "n", "rep", "comp"],
        )


def _equal(batches, least: float):
    """Rows whose two sets resemble each other."""
    for batch in K.each(batches, _TEXTS):
        keep = []
        for x, y in zip(_hashes(batch.column("sa")), _hashes(batch.column("sb")), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both + 1e-9 >= least * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _alike(batches, least: float):
    """Rows whose two sketches agree in enough minima."""
    for batch in K.each(batches):
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, MINIMA) for c in ("sa", "sb"))
        keep = (a == b).mean(axis=1) >= least
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _counted(members: DataFrame) -> DataFrame:
    """Members (key, rep) of keys that have others too, with n."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(sizes, "key")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each member with the first member of its key, for the FIRST most common of those."""
    meets = members.join(members.groupBy("key").agg(F.min("rep").alias("h")), "key").where("h != rep").groupBy("rep", "h").agg(F.count("*").alias("n"))
    best = meets.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "h"))), 1, FIRST).alias("hs"))  # BANDS entries at most
    return best.select(F.explode("hs.h").alias("a"), F.col("rep").alias("b"))


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs of small keys whose members are not connected."""
    small = members.where(F.col("n") <= PAIRS_UP_TO).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "comp"))).alias("m"))  # PAIRS_UP_TO entries at most
    each = F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> y.comp != x.comp), y -> struct(x.rep AS a, y.rep AS b))))")
    return small.select(F.explode(each).alias("p")).select("p.a", "p.b")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """The members of large keys with the hubs of their key that they are not connected to."""
    large = members.where(F.col("n") > PAIRS_UP_TO).select("key", "rep", "comp")
    firsts = [F.min_by(F.struct(F.col("rep").alias("h"), F.col("comp").alias("hc")), F.xxhash64("rep", F.lit(k))).alias(f"h{k}") for k in range(HUBS)]
    hubs = large.groupBy("key").agg(*firsts).select("key", F.explode(F.array_distinct(F.array(*(f"h{k}" for k in range(HUBS))))).alias("h")).select("key", "h.h", "h.hc")
    return large.join(hubs, "key").where("hc != comp").select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of keys that more than one component has."""
    keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return members.join(keys, "key")


def _both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Pairs with the value of each end, as sa and sb."""
    a, b = (values.select(F.col("rep").alias(k), F.col(name).alias(f"s{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")


def _prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Every pair of different components that can resemble each other; sets: rep, s, comp."""
    counts = np.zeros(1 << _BITS, np.int64)
    got = sets.select("s").mapInArrow(_bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts[np.asarray(got["bin"])] = np.asarray(got["n"])
    make = functools.partial(_prefixes, counts=counts.astype(np.uint32), similarity=similarity)
    rows = sets.select("rep", "s", "comp").mapInArrow(make, "key long, pos long, n long, rep long, comp long")
    rows = written(rows, "prefixes")
    rows = written(_mixed(rows), "mixed")
    # An overlap of o is needed: o >= share * (n of both).  The smaller set's first common shingle leaves room for twice its own share.
    share = similarity / (1 + similarity)
    short = rows.where(f"n - pos >= {2 * share} * n - 1e-6")

    def ranges(of: DataFrame, end: str) -> DataFrame:
        most = [F.min("n").alias(f"lo{end}"), F.max("n").alias(f"hi{end}"), F.max(F.col("n") - F.col("pos")).alias(f"room{end}")]
        return of.groupBy("key", F.col("comp").alias(f"comp{end}")).agg(*most)

    least = f"{share} * (lox + loy) - 1e-6"
    met = ranges(short, "x").join(ranges(rows, "y"), "key").where(f"compx != compy AND lox <= hiy AND hix >= {similarity} * loy - 1e-6 AND roomx >= {least} AND roomy >= {least}")
    x = short.select("key", F.col("comp").alias("compx"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    x = met.join(x, ["key", "compx"]).where(f"nx <= hiy AND nx >= {similarity} * loy - 1e-6 AND nx - px >= {share} * (nx + loy) - 1e-6")
    y = rows.select("key", F.col("comp").alias("compy"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    room = f"nx <= ny AND nx >= {similarity} * ny - 1e-6 AND least(nx - px, ny - py) >= {share} * (nx + ny) - 1e-6"
    return x.select("key", "compy", "x", "nx", "px").join(y, ["key", "compy"]).where(room).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _named(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with the component that links found so far give them."""
    from .simhash import components

    return members.join(components(found).withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def links(distinct: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Pairs (a, b) of representatives that connect those that resemble each other; distinct: rep, sketch, keys, each sketch once; texts: rep, text."""
    alike = functools.partial(_alike, least=similarity - SLACK)
    equal = functools.partial(_equal, least=similarity)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches may belong to sets that resemble each other."""
        return written(_both(written(pairs, "pairs"), distinct, "sketch").mapInArrow(alike, "a long, b long"), "near")

    def sets_of(reps: DataFrame) -> DataFrame:
        return written(texts.where("text IS NOT NULL").join(reps, "rep", "left_semi").select("rep", "text").mapInArrow(_sets, "rep long, s binary"), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()

    members = written(_counted(distinct.select("rep", F.explode("keys").alias("key")).select("key", "rep")), "bands")
    first = near(_first_pairs(members))
    sets = sets_of(written(ends(first), "ends"))
    found = written(_both(first, sets, "s").mapInArrow(equal, "a long, b long"), "found")
    members = written(_mixed(_named(members, found)), "members")
    second = near(_all_pairs(members).unionAll(_hub_pairs(members)).distinct())
    large = written(members.where(F.col("n") > PAIRS_UP_TO).select("rep").distinct(), "large")
    needed = written(ends(second).union(large).distinct().join(sets.select("rep"), "rep", "left_anti"), "needed")
    sets = sets.unionAll(sets_of(needed))
    found = written(found.unionAll(_both(second, sets, "s").mapInArrow(equal, "a long, b long")).distinct(), "found")
    if large.isEmpty():
        return found
    left = written(_mixed(_named(members.drop("comp").where(F.col("n") > PAIRS_UP_TO), found)).select("rep", "comp").distinct(), "left")
    third = near(_prefix_pairs(sets.join(left, "rep"), similarity))
    return found.unionAll(_both(third, sets, "s").mapInArrow(equal, "a long, b long")).distinct()
