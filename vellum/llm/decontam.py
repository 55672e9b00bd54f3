"""Benchmark decontamination: n-gram seeds, an exact bound, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits.  A first pass counts, over all
documents, in how many each word of a test item occurs.  Every three-word gram of
an item is a seed, however many documents hold it, so a passage that a third of
the corpus has copied is found by whatever an edited copy keeps.  A second pass
joins documents to items on the seeds.  No alignment scores more than the weight
of the item's words that the text holds at all; pairs, and then places in the
text, that this bound keeps under the threshold are left out, which loses
nothing.  The words around the other seeds are aligned: Smith-Waterman with
matches weighted by the rarity of the word, so that edited, reordered in part or
paraphrased copies still score high and passages that merely share common words do
not.  The score is the alignment's weight as a share of the item's own.

Test items are a stated query set: they go to the executors in blocks of at most
``BLOCK_WORDS`` words (a checked size), each block against all documents; the
documents themselves are never shuffled.

Defined results: null, empty and wordless texts or items match nothing; items of
fewer than ``SEED`` words are matched by their first word; a repeated item id or
document id gives a row for each of its rows, a null item id none, a null document
id rows with a null doc_id; a text that holds an item more than once gives one row,
of the best alignment (the first of equal ones); pairs tie freely, since every one
at or above the threshold is returned.  Words longer than a window of a megabyte
count as several.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

SEED = 3
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
#: Seed hits that are spread over their items at a time.
_HITS = 1 << 20

_TABLE = K.letter_table(digits=True)
_MIX = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all parts, and for each word its part."""
    buf, at = K.joined(parts, _TABLE, b" ")
    starts, ends = K.words(buf)
    return K.run_hashes(buf, starts, ends), np.searchsorted(at, starts, side="right") - 1


def _grams(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The gram hash at each word; 0 where the gram would leave its text."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    m = n - SEED + 1
    if m > 0:
        with np.errstate(over="ignore"):
            h = np.zeros(m, np.uint64)
            for k in range(SEED):
                h = (h ^ (words[k : k + m] * _MIX[k])) * _MIX[(k + 1) % SEED]
                h ^= h >> np.uint64(31)
        out[:m] = np.where(owner[:m] == owner[SEED - 1 :], h, 0)
    return out


@dataclass
class Block:
    """Test items with their word and gram hashes; items are rows, so equal ids stay apart."""

    ids: np.ndarray
    words: list[np.ndarray]
    grams: list[np.ndarray]

    @classmethod
    def of(cls, ids, texts) -> Block:
        low = K.lowered(pa.array(texts, pa.string()))
        words, grams = [], []
        for t in low.to_pylist():
            w, _ = _hashes([t.encode()])
            words.append(w)
            g = _grams(w, np.zeros(len(w), np.int64))
            if 0 < len(w) < SEED:
                g = np.zeros(len(w), np.uint64)
            grams.append(g)
        return cls(np.asarray(ids), words, grams)


class _Lookup:
    """Which of a sorted set of hashes each value is, or -1: a bitmap first, then a binary search."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(known >> np.uint64(44)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in values that are known, and which."""
        at = np.flatnonzero(self.bits[(values >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)
        ok = self.known[which] == values[at]
        return at[ok], which[ok]


def _count(batches, known: np.ndarray):
    """In how many of the task's documents each known hash occurs, and how many documents there are."""
    lookup, total, docs = _Lookup(known), np.zeros(len(known), np.int64), 0
    for batch in K.each(batches, K.SLICE):
        low = K.lowered(batch.column(0))
        docs += len(low)
        for rows, parts in K.windows(low):
            words, owner = _hashes(parts)
            rows = np.asarray(rows)
            at, which = lookup.find(words)
            pairs = rows[owner[at]] * np.int64(len(known)) + which
            total += np.bincount(np.unique(pairs) % len(known), minlength=len(known))
    nz = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((known[nz].view(np.int64), [0]))), pa.array(np.concatenate((total[nz], [0]))), pa.array(np.concatenate((np.zeros(len(nz), np.int64), [docs])))], names=["h", "n", "docs"])


def smith_waterman(a: np.ndarray, b: np.ndarray, weight: np.ndarray, gap: float) -> tuple[float, int, int]:
    """Best local alignment of item words a (with weights) to document words b: score, start and end in b."""
    n = len(b)
    prev, prev_from = np.zeros(n + 1), np.arange(n + 1)
    place = np.arange(n + 1) * gap
    best = (0.0, 0, 0)
    for i, x in enumerate(a):
        hit = np.where(b == x, weight[i], -gap)
        diag = prev[:-1] + hit
        up = prev[1:] - gap
        base = np.zeros(n + 1)
        origin = np.arange(n + 1)
        base[1:] = np.maximum(diag, up)
        origin[1:] = np.where(diag >= up, prev_from[:-1], prev_from[1:])
        fresh = base <= 0
        base[fresh] = 0
        origin[fresh] = np.arange(n + 1)[fresh]
        lifted = base + place
        run = np.maximum.accumulate(lifted)  # gaps along the document
        source = np.maximum.accumulate(np.where(lifted >= run, np.arange(n + 1), 0))
        prev = run - place
        prev_from = origin[source]
        at = int(prev.argmax())
        if prev[at] > best[0]:
            best = (float(prev[at]), int(prev_from[at]), at)
    return best


@dataclass
class Index:
    block: Block
    seeds: np.ndarray  # sorted hashes
    first: np.ndarray  # of each seed in item/pos, and one past the last
    item: np.ndarray
    pos: np.ndarray
    weights: list[np.ndarray]
    known: np.ndarray  # sorted hashes of the items' words
    places: list[np.ndarray]  # of each item's words in known


def index(block: Block, counts: dict[int, int], docs: int) -> Index:
    """Seeds and word weights of a block, from the corpus counts."""
    known = np.unique(np.concatenate([*block.words, np.empty(0, np.uint64)]))
    rows = []
    weights = []
    for i, (words, grams) in enumerate(zip(block.words, block.grams, strict=True)):
        weights.append(np.array([np.log((docs + 1) / (counts.get(int(w), 0) + 1)) + 0.1 for w in words]))
        rows += [(int(g), i, p) for p, g in enumerate(grams) if g]
        if 0 < len(words) < SEED:
            rows.append((int(words[0]), i, 0))
    rows.sort()
    h = np.array([r[0] for r in rows], np.uint64)
    seeds, first = np.unique(h, return_index=True)
    return Index(block, seeds, np.append(first, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), weights, known, [np.searchsorted(known, w) for w in block.words])


def _spread(which: np.ndarray, ix: Index):
    """For seeds found, in runs of about _HITS: places in which, and in the seed's items."""
    reps = ix.first[which + 1] - ix.first[which]
    ends = np.cumsum(reps)
    lo = 0
    while lo < len(which):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - reps[lo] + _HITS, "right")))
        r = reps[lo:hi]
        flat = np.repeat(ix.first[which[lo:hi]] - (np.cumsum(r) - r), r) + np.arange(r.sum())
        yield np.repeat(np.arange(lo, hi), r), flat
        lo = hi


def _possible(part: np.ndarray, which: np.ndarray, words: np.ndarray, bounds: np.ndarray, ix: Index, vocabulary: _Lookup, threshold: float) -> np.ndarray:
    """Sorted codes part * items + item of those that share a seed and whose shared words weigh enough."""
    if not len(which):
        return np.empty(0, np.int64)
    items = np.int64(len(ix.weights))
    seeds = np.unique(part * np.int64(len(ix.seeds)) + which)
    part, which = np.divmod(seeds, len(ix.seeds))
    met = [np.unique(part[k] * items + ix.item[flat]) for k, flat in _spread(which, ix)]
    met = np.unique(np.concatenate(met))
    keep = np.zeros(len(met), bool)
    there = np.zeros(len(ix.known), bool)
    owner, begin = np.unique(met // items, return_index=True)
    for p, lo, hi in zip(owner.tolist(), begin.tolist(), [*begin[1:].tolist(), len(met)], strict=True):
        present = vocabulary.find(words[bounds[p] : bounds[p + 1]])[1]
        there[present] = True
        for k in range(lo, hi):
            it = met[k] % items
            w = ix.weights[it]
            keep[k] = w @ there[ix.places[it]] >= threshold * w.sum() * (1 - 1e-9)
        there[present] = False
    return met[keep]


def _align(words: np.ndarray, hits: np.ndarray, ix: Index, item: int, threshold: float):
    """Best alignment of an item to the words around its seeds; hits: (place in document, place in item), sorted."""
    a, weight = ix.block.words[item], ix.weights[item]
    total = weight.sum()
    # What is not matched costs half a typical word of this item.
    gap = 0.5 * total / len(a)
    reach = len(a)
    best = (0.0, 0, 0)
    begin = np.maximum(0, hits[:, 0] - hits[:, 1] - reach // 2)
    end = np.minimum(len(words), hits[:, 0] - hits[:, 1] + reach + reach // 2 + 1)
    k = 0
    while k < len(begin):
        lo, hi = begin[k], end[k]
        while k + 1 < len(begin) and begin[k + 1] <= begin[k] + reach and end[k + 1] - lo <= 4 * reach + 8:
            k += 1
            hi = max(hi, end[k])
        k += 1
        if weight[np.isin(a, words[lo:hi])].sum() < max(threshold, best[0]) * total * (1 - 1e-9):
            continue  # no alignment here can reach the threshold, or beat the best
        score, s, e = smith_waterman(a, words[lo:hi], weight, gap)
        if score / total > best[0]:
            best = (score / total, int(lo) + s, int(lo) + e)
    return best if best[0] >= threshold else None


def _match(batches, ix: Index, threshold: float):
    lookup, vocabulary = _Lookup(ix.seeds), _Lookup(ix.known)
    items = np.int64(len(ix.weights))
    # A window of a long text begins with so many words of the one before: no stretch that `_align` looks at is cut.
    span = 4 * max(map(len, ix.weights), default=0) + 8
    for batch in K.each(batches, K.SLICE):
        low = K.lowered(batch.column(1))
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        last, tail, place_of_tail = -1, np.empty(0, np.uint64), 0
        for rows, parts in K.windows(low):
            words, owner = _hashes(parts)
            # Parts of one text in a window are one; so is what is left of the window before.
            fresh = np.concatenate(([True], np.diff(rows) != 0))
            owner, rows = (np.cumsum(fresh) - 1)[owner], np.asarray(rows)[fresh].tolist()
            shift = [0] * len(rows)
            if rows[0] == last:
                words, owner = np.concatenate((tail, words)), np.concatenate((np.zeros(len(tail), np.int64), owner))
                shift[0] = place_of_tail
            bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
            keep = max(int(bounds[-2]), len(words) - span)
            last, tail, place_of_tail = rows[-1], words[keep:], shift[-1] + keep - int(bounds[-2])
            grams = _grams(words, owner)
            at, which = lookup.find(grams)
            at_w, which_w = lookup.find(words)
            at, which = np.concatenate((at, at_w)), np.concatenate((which, which_w))
            pairs = _possible(owner[at], which, words, bounds, ix, vocabulary, threshold)
            if len(pairs):
                kept = []
                for k, flat in _spread(which, ix):
                    code = owner[at[k]] * items + ix.item[flat]
                    ok = pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code
                    kept.append((at[k[ok]], flat[ok]))
                place, flat = (np.concatenate(x) for x in zip(*kept, strict=True))
                item, pos, part = ix.item[flat], ix.pos[flat], owner[place]
                order = np.lexsort((pos, place, item, part))
                place, item, pos, part = place[order], item[order], pos[order], part[order]
                cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(item) != 0)) + 1
                for group in np.split(np.arange(len(place)), cut):
                    p, it = int(part[group[0]]), int(item[group[0]])
                    lo = bounds[p]
                    hits = np.stack((place[group] - lo, pos[group]), axis=1)
                    hits = hits[np.lexsort((hits[:, 0], hits[:, 0] - hits[:, 1]))]
                    got = _align(words[lo : bounds[p + 1]], hits, ix, it, threshold)
                    if got and got[0] > found.get((rows[p], it), (0.0,))[0]:
                        found[rows[p], it] = (got[0], len(group), got[1] + shift[p], got[2] + shift[p])
        keys = sorted(found)
        ids = batch.column(0)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array([k[0] for k in keys], pa.int64())), pa.array([int(ix.block.ids[k[1]]) for k in keys], pa.int64())]
            + [pa.array([found[k][j] for k in keys], t) for j, t in ((0, pa.float64()), (1, pa.int64()), (2, pa.int64()), (3, pa.int64()))],
            names=["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"],
        )


def _blocks(benchmark: DataFrame, text: str, key: str):
    ids, texts, size = [], [], 0
    for r in benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text)).orderBy(F.col(key), F.col(text)).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1]) // 2 + 1
        if size >= BLOCK_WORDS:
            yield Block.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block.of(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item that it holds a copy of: doc_id, item_id, score, n_seeds, start_word, end_word (word places in the document, end exclusive)."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long"
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    out = None
    for block in _blocks(benchmark, item_text, item_key):
        known = np.unique(np.concatenate([*block.words, np.empty(0, np.uint64)]))
        known = known[known != 0]
        if not len(known):
            continue
        counted = whole.select("t").mapInArrow(functools.partial(_count, known=known), "h long, n long, docs long").groupBy("h").agg(F.sum("n"), F.sum("docs")).collect()
        counts = {r[0] & 0xFFFFFFFFFFFFFFFF: r[1] for r in counted}
        ix = index(block, counts, max((r[2] for r in counted), default=0))
        one = whole.mapInArrow(functools.partial(_match, ix=ix, threshold=threshold), schema)
        out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], schema)
