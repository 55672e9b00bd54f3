"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are taken from word shingles; two link when at most
``bits`` (up to 2) of their bits differ, and a class is what links reach.

Search.  The 64 bits are three segments of 22, 21 and 21 bits.  Of two errors at
least one segment has none (pigeonhole), and whichever other segment is looked at
has two at most.  A segment padded to 23 bits is decoded with the perfect binary
Golay code: the code words that lie nearest to the segment and to each of its 23
neighbours are its keys, one if it lies within 2 bits of a code word and six if
at 3.  Two segments that differ in up to 2 bits have a neighbour in common and so
share a key.  A fingerprint's keys are, for each segment, its exact value with
each Golay key of the next segment; an equi-join on them finds every pair, and
the distance is verified.

Buckets.  Only distinct fingerprints are joined.  Within a key of few
fingerprints all pairs are verified.  Fingerprints of a larger key are linked
without pairs: each is dealt to itself and its 64 one-bit neighbours, two that
differ in up to 2 bits meet at one of these, all that meet do link, and at most
65 distinct fingerprints can meet.  That is exact, and linear in the group.

Edited copies move more bits than two; `near_classes` and `keep_one` add the links
of `resemblance`.

Defined results: null and empty texts, and texts without a word, have
fingerprint zero and link to each other (and to any other fingerprint within
reach); a text of fewer words than a shingle is one shingle; classes are named by
their smallest doc_id; rows with a null doc_id keep their fingerprint and have no
class of their own (they name no class, but carry that of their fingerprint,
null if no other row has it).
"""

from __future__ import annotations

import functools
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from . import textkit as K
from .shared import written

SEED = 42
#: Keys with more fingerprints than this are linked through one-bit neighbours.
PAIRS_UP_TO = 24
_BLOCK = 1 << 20

# --- fingerprints ---------------------------------------------------------------


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int, sketcher: resemblance.Sketcher | None = None) -> int:
    """SimHash of a text's shingles of lower-cased words, repeats included; a bit is 1 if it is in over half of them.  A sketcher is given the words too."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        fresh = text[at:end].lower().split()
        if sketcher:
            sketcher.add(fresh)
        words += fresh
        at = end
        m = len(words) - shingle + 1
        if m > 0:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            hashes = np.fromiter(map(digest, grams, repeat(SEED)), np.uint64, m)
            counts += _bit_counts(hashes)
            n += m
            words = words[m:]
    if not n:
        if not words:
            return 0
        counts, n = _bit_counts(np.array([digest(b" ".join(words), SEED)], np.uint64)), 1
    return int(np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(batches, text: str, shingle: int, sketch: bool = False):
    for batch in K.each(batches, K.SLICE):
        column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        sketchers = [resemblance.Sketcher() if sketch else None for _ in column]
        out = np.fromiter((fingerprint(v.as_buffer().to_pybytes(), shingle, s) for v, s in zip(column, sketchers, strict=True)), np.uint64, len(column))
        kept = {c: batch.column(c) for c in batch.schema.names if c not in (text, "fp")} | {"fp": pa.array(out.view(np.int64))}
        if sketch:
            found = [s.result() or (None, None) for s in sketchers]
            kept |= {"sketch": pa.array([f[0] for f in found], pa.binary()), "keys": pa.array([f[1] for f in found], pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, sketch: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a long; with sketch, also the text's sketch and its band keys."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    schema = "doc_id long, fp long" + ", sketch binary, keys array<long>" * sketch
    return narrow.mapInArrow(functools.partial(_fingerprints, text="__text", shingle=shingle, sketch=sketch), schema)


# --- the Golay code -------------------------------------------------------------

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def _remainder(values: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials divided by the generator."""
    out = values.copy()
    for k in range(22, 10, -1):
        out ^= np.where((out >> k) & 1, _GENERATOR << (k - 11), 0)
    return out


@functools.cache
def _correction() -> np.ndarray:
    """Error pattern of each remainder: the code is perfect, so each of the 2048 belongs to one pattern of up to 3 bits."""
    out = np.zeros(1 << 11, np.int64)
    ones = [1 << k for k in range(23)]
    patterns = [a ^ b ^ c for i, a in enumerate(ones) for j, b in enumerate(ones[: i + 1]) for c in ones[: j + 1]]  # a ^ a ^ b is b: one and three bits
    patterns += [a ^ b for i, a in enumerate(ones) for b in ones[:i]] + [0]
    p = np.array(patterns, np.int64)
    out[_remainder(p)] = p
    return out


def golay_index(values: np.ndarray) -> np.ndarray:
    """The 12 message bits of the code word nearest to each 23-bit value."""
    return (values ^ _correction()[_remainder(values)]) >> 11


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of the code words nearest to each value and its neighbours: (row, index) pairs."""
    near = np.stack([golay_index(values), *(golay_index(values ^ (1 << k)) for k in range(23))], axis=1)
    near.sort(axis=1)
    fresh = np.concatenate((np.ones((len(values), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
    row, col = np.nonzero(fresh)
    return row, near[row, col]


SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _keys(batches):
    """Rows (key, fp, rep) for every key of every fingerprint."""
    for batch in K.each(batches):
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        rep = np.asarray(batch.column("rep"))
        parts = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        rows, keys = [], []
        for s in range(3):
            row, index = golay_keys(parts[(s + 1) % 3])
            rows.append(row)
            keys.append((np.int64(s) << 40) | (parts[s][row] << 12) | index)
        row = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp.view(np.int64)[row]), pa.array(rep[row])], names=["key", "fp", "rep"])


# --- links ----------------------------------------------------------------------


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of representatives that connect exactly the fingerprints within `bits` (0 to 2) of each other; distinct: fp and rep, each once."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    if bits == 0:
        return distinct.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    keys = distinct.select("fp", "rep").mapInArrow(_keys, "key long, fp long, rep long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").select("key", "n")
    members = written(keys.join(shared, "key"), "keys")
    small = members.where(F.col("n") <= PAIRS_UP_TO).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "fp"))).alias("m"))  # PAIRS_UP_TO entries at most
    pairs = small.select(
        F.explode(
            F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> bit_count(x.fp ^ y.fp) <= {bits}), y -> struct(x.rep AS a, y.rep AS b))))")
        ).alias("p")
    ).select("p.a", "p.b")
    large = members.where(F.col("n") > PAIRS_UP_TO).select("fp", "rep").distinct()
    return pairs.unionAll(_by_neighbours(large, bits)).distinct()


def _by_neighbours(large: DataFrame, bits: int) -> DataFrame:
    """Links of many fingerprints without pairs: all that meet at one value within a bit of each."""
    near = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    met = large.select("rep", "fp", F.explode(near).alias("at")).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("rep", "fp"))).alias("m")).where(F.size("m") > 1)  # 65 entries at most
    if bits == 2:
        edges = F.expr("transform(slice(m, 2, size(m)), y -> struct(m[0].rep AS a, y.rep AS b))")
    else:  # they meet at one of the two themselves
        edges = F.expr("transform(filter(m, y -> y.fp != at AND exists(m, z -> z.fp = at)), y -> struct(filter(m, z -> z.fp = at)[0].rep AS a, y.rep AS b))")
    return met.select(F.explode(edges).alias("p")).select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of the edges, by alternating large and small stars."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour points to the node's smallest.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself point to the smallest.
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = written(star, "edges")
        # Done when every node points to one node, which points nowhere: the sums no longer change.
        if _state(after) == _state(now):
            break
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    prints = written(fingerprints(docs, text, key, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.where("rep IS NOT NULL").select("fp", "rep"), bits))
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    named = written(named, "named")
    # Fingerprints of a thousandth of all rows or more (that of empty texts may be one) are a thousand at most: they are
    # broadcast, so their rows stay where they are; the rows of others are joined by fingerprint.
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    often = named.where(F.col("n") >= max(2, -(-rows // 1000))).drop("n").hint("broadcast")
    seldom = prints.join(often.select("fp"), "fp", "left_anti").join(named.drop("n"), "fp")
    return prints.join(often, "fp").unionByName(seldom).select("doc_id", "fp", "component_id")


def hex16(fp):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 2, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id for every row with an id: classes by the links of fingerprints and those of five-word sketches together."""
    prints = fingerprints(docs, text, key, shingle, sketch=True).where("doc_id IS NOT NULL").withColumn("sid", F.xxhash64("sketch"))
    prints = written(prints, "prints")
    # A node is one fingerprint with one sketch, named by its smallest doc_id; the sketches of copies are equal.
    nodes = written(prints.groupBy("fp", "sid").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "nodes")
    by_print = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "distinct")
    by_sketch = nodes.where("sketch IS NOT NULL").groupBy("sid").agg(F.min("node").alias("rep"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    by_sketch = written(by_sketch, "sketches")
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    same_print = nodes.join(by_print, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    same_sketch = nodes.join(by_sketch.select("sid", "rep"), "sid").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    found = components(links(by_print, bits).unionAll(resemblance.links(by_sketch, texts, similarity)).unionAll(same_print).unionAll(same_sketch))
    named = nodes.join(found, "node", "left").select("fp", "sid", F.coalesce("component", "node").alias("component_id"))
    return prints.select("doc_id", "fp", "sid").join(named, ["fp", "sid"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 2, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id.  Rows that repeat its doc_id stay as they are the same document; rows without one stay."""
    found = near_classes(docs, text, key, shingle, bits, similarity).where("doc_id != component_id").select("doc_id").distinct()
    gone = written(found, "gone")  # its size is known now: the texts are shuffled only if the ids are too many to broadcast
    return docs.join(gone, docs[key] == gone["doc_id"], "left_anti")
