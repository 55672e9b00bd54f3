"""Token counts and ids through distinct pre-tokens.

A byte-level BPE cuts a text into pre-tokens first and merges within each alone,
so a pre-token's pieces never depend on its neighbours.  Texts are cut vectorised
over code points; distinct pre-tokens are found by hash with every occurrence
compared to the first.

Counts.  A first pass counts pre-tokens over all texts.  The most frequent (``FREQUENT``
at most, of up to ``LONGEST`` characters: a bounded table) are encoded once and sent
to every task.  A second pass joins them to the documents' pre-token frequencies where
the texts are, and keeps what is left of each document's frequencies; these rows go
to the task of their pre-token, which encodes each distinct one once, and the sums go
back by row.  So every distinct pre-token is encoded once, a frequent one is never
sent, and no ids are made.

Ids, where they are wanted (`Encoder`), are gathered from the ids of distinct
pre-tokens, which each task encodes once while its cache lasts.

The cut is that of the byte-level pre-tokenizer with its own pattern (and no
prefix space); ``supports`` says whether a tokenizer is of that kind, and others
(sentencepiece models among them) are counted by their library text by text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a special
string inside a text is one token, as by the library's default; equal rows give
equal rows, whatever their ids; other columns pass through.  The cache of distinct
pre-tokens is bounded by ``CACHE`` entries a task, and a text longer than a window is
cut where a word begins.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .shared import prefix, written

#: Distinct pre-tokens that a task keeps; beyond, it starts anew.
CACHE = 1 << 17
WINDOW = 1 << 17
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pre-tokens that are sent to every task, and their length in characters.
FREQUENT, LONGEST = 200_000, 64
#: Occurrences in a task from which on a pre-token can be frequent.
LEAST = 4


def classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point, as the library's pre-tokenizer sees them."""
    if "table" not in _classes:
        _classes["table"] = _classified()
    return _classes["table"]


_classes: dict[str, np.ndarray] = {}


def packed_classes() -> bytes:
    """The classes as a few kilobytes, for tasks to `take`, so that no worker asks the library about every code point."""
    return zlib.compress(classes().tobytes())


def take(packed: bytes) -> None:
    if "table" not in _classes:
        _classes["table"] = np.frombuffer(zlib.decompress(packed), np.uint8)


def _classified() -> np.ndarray:
    import regex
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    patterns = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"))]
    out = np.full(0x110000, OTHER, np.uint8)
    for start in range(0, 0x110000, _CODES):  # a little at a time: the library's answer is large
        codes = np.arange(start, start + _CODES, dtype=np.uint32)
        codes = codes[(codes < 0xD800) | (codes >= 0xE000)]
        every = codes.tobytes().decode("utf-32-le")
        guess = np.full(len(codes), OTHER, np.uint8)
        for kind, pattern in patterns:
            for m in pattern.finditer(every):
                guess[m.start() : m.end()] = kind
        for kind in (LETTER, NUMBER, SPACE, OTHER):
            # Characters of one class make one pre-token; the library (of another Unicode version) is asked about each run that it makes.
            own = codes[guess == kind]
            runs = library(own.tobytes().decode("utf-32-le")) if len(own) else []
            for _, (a, b) in runs:
                out[own[a:b]] = _class_of(chr(own[a]), library)
    return out


#: Code points that are classified at a time.
_CODES = 0x1000


def _class_of(c: str, library) -> int:
    for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        if len(library(before + c)) == 1:
            return kind
    return SPACE


def cut(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; codes: code points of texts one after another, begins: where each (non-empty) text starts."""
    n = len(codes)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]  # runs of a class within a text
    space = kind == SPACE
    ends = np.append(new[1:], True)  # last of its run
    follows = ends & ~first[1:]  # another run of the same text follows
    start = new.copy()
    # White space before something else: its last character stands alone or, if a plain space, leads the next run.
    last = space & follows
    start |= last
    led = np.zeros(n, bool)
    led[1:] = (last & (codes == 32))[:-1]
    start &= ~led
    # Contractions: an apostrophe that is a pre-token's first character, then certain letters.
    apostrophes = np.flatnonzero((codes == 39) & start & ends & ~space)
    apostrophes = apostrophes[(apostrophes + 1 < n)]
    apostrophes = apostrophes[~first[apostrophes + 1]]
    if len(apostrophes):
        one = codes[apostrophes + 1]
        two = np.where(apostrophes + 2 < n, codes[np.minimum(apostrophes + 2, n - 1)], 0)
        two = np.where(first[np.minimum(apostrophes + 2, n)], 0, two)
        size = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        size = np.where(pair, 3, size)
        for at, k in zip(apostrophes[size > 0], size[size > 0], strict=True):
            start[at + 1 : at + k] = False
            if at + k < n and (kind[at + k] == LETTER):
                start[at + k] = True
    return np.flatnonzero(start)


class _Store:
    """An array that grows."""

    def __init__(self, dtype):
        self.a, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.a):
            self.a = np.concatenate((self.a, np.zeros_like(self.a)))
        self.a[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, index):
        return self.a[index]


@functools.cache
def _alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Ids of whole texts, each distinct pre-token encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._clear()

    def _clear(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes of known pre-tokens, sorted
        self.entry = np.empty(0, np.int64)  # the entry of each
        self.n = 0
        # By entry: code points and ids of the pre-token, as places and sizes in two stores.
        self.code_at, self.code_n, self.id_at, self.id_n = (_Store(np.int64) for _ in range(4))
        self.codes, self.ids = _Store(np.uint32), _Store(np.uint32)

    def _learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries for the pre-tokens codes[start:start + size]."""
        picked = codes[np.arange(sizes.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)]
        text = picked.tobytes().decode("utf-32-le").encode().decode("latin-1").translate(_alphabet())
        n_bytes = np.cumsum(1 + (picked >= 0x80) + (picked >= 0x800) + (picked >= 0x10000).astype(np.int64))
        ends = n_bytes[np.cumsum(sizes) - 1].tolist() if len(sizes) else []
        tokenize = self.tokenizer.model.tokenize
        found = [[piece.id for piece in tokenize(text[a:b])] for a, b in zip([0, *ends], ends, strict=False)]
        n_ids = np.fromiter(map(len, found), np.int64, len(found))
        entries = np.arange(self.n, self.n + len(found))
        self.code_at.add(self.codes.n + np.cumsum(sizes) - sizes)
        self.code_n.add(sizes)
        self.codes.add(picked)
        self.id_at.add(self.ids.n + np.cumsum(n_ids) - n_ids)
        self.id_n.add(n_ids)
        self.ids.add(np.fromiter((i for x in found for i in x), np.uint32, int(n_ids.sum())))
        self.n += len(found)
        return entries

    def pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For every pre-token of the (non-empty) texts: its entry in the cache; and where each text's pre-tokens start."""
        if self.n > CACHE:
            self._clear()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
        starts = cut(codes, begins)
        size = np.diff(starts, append=len(codes))
        hashes = K.run_hashes(codes, starts, starts + size)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.known, distinct)
        old = where < len(self.known)
        old[old] = self.known[where[old]] == distinct[old]
        entries = np.empty(len(distinct), np.int64)
        entries[old] = self.entry[where[old]]
        entries[~old] = self._learn(codes, starts[at[~old]], size[at[~old]])
        # Equal hashes must mean equal pre-tokens: every occurrence is compared with the one that was encoded.
        mine = entries[which]
        same = self.code_n[mine] == size
        if same.all():
            same = np.array([(self.codes[np.arange(len(codes)) + np.repeat(self.code_at[mine] - starts, size)] == codes).all()])
        if not same.all():
            self._clear()
            texts_of = {}
            which = np.array([texts_of.setdefault(codes[a : a + n].tobytes(), len(texts_of)) for a, n in zip(starts, size, strict=True)])
            first = np.unique(which, return_index=True)[1]
            return self._learn(codes, starts[first], size[first])[which], np.searchsorted(starts, begins)
        order = np.argsort(np.concatenate((self.known, distinct[~old])), kind="stable")
        self.known, self.entry = np.concatenate((self.known, distinct[~old]))[order], np.concatenate((self.entry, entries[~old]))[order]
        return mine, np.searchsorted(starts, begins)

    def _segments(self, texts: list[str]):
        """Yield windows of (row, text without special strings, or None and the special's id)."""
        window, size = [], 0
        for row, text in enumerate(texts):
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            for part in parts:
                if part in self.special:
                    window.append((row, None, self.special[part]))
                    continue
                while part:
                    end = len(part)
                    if end > WINDOW:
                        m = _SAFE.search(part, WINDOW)
                        end = m.start() if m else end
                    window.append((row, part[:end], 0))
                    size += end
                    part = part[end:]
                    if size >= WINDOW:
                        yield window
                        window, size = [], 0
        if window:
            yield window

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has; no ids are made."""
        total = np.zeros(len(texts), np.int64)
        for window in self._segments(texts):
            plain = [(r, t) for r, t, _ in window if t is not None]
            if plain:
                entries, at = self.pretokens([t for _, t in plain])
                np.add.at(total, [r for r, _ in plain], np.add.reduceat(self.id_n[entries], at))
            np.add.at(total, [r for r, t, _ in window if t is None], 1)
        return total

    def encode(self, texts: list[str]):
        """Yield (row, ids) for parts of texts, in order."""
        for window in self._segments(texts):
            plain = [t for _, t, _ in window if t is not None]
            if plain:
                entries, at = self.pretokens(plain)
                sizes = self.id_n[entries]
                where = np.concatenate(([0], np.cumsum(sizes)))
                flat = self.ids[np.arange(where[-1]) + np.repeat(self.id_at[entries] - where[:-1], sizes)]
                bounds = where[np.append(at, len(entries))]
            k = 0
            for row, text, special in window:
                if text is None:
                    yield row, np.array([special], np.uint32)
                else:
                    yield row, flat[bounds[k] : bounds[k + 1]]
                    k += 1


#: Between a letter or digit and a space with a letter after it every text may be cut: a pre-token begins there.
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")


def supports(path: str) -> bool:
    """Whether a file is a byte-level BPE tokenizer with the library's own pattern and nothing around it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    p = t.get("pre_tokenizer") or {}
    plain = all(not a["single_word"] and not a["lstrip"] and not a["rstrip"] and not a["normalized"] for a in t["added_tokens"])
    return plain and t["model"]["type"] == "BPE" and not t.get("normalizer") and p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and p.get("use_regex", True) and not t["model"].get("ignore_merges") and not t["model"].get("dropout")


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


@functools.cache
def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


# --- counts -----------------------------------------------------------------------

_ADDED = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}


def distinct(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pre-tokens of (non-empty) texts; for every pre-token, which of them it is and whose."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    starts = cut(codes, begins)
    size = np.diff(starts, append=len(codes))
    _, first, which = np.unique(K.run_hashes(codes, starts, starts + size), return_index=True, return_inverse=True)
    # Equal hashes must mean equal pre-tokens: every occurrence is compared with the first.
    mine = first[which]
    if not ((size[mine] == size).all() and (codes[np.arange(len(codes)) + np.repeat(starts[mine] - starts, size)] == codes).all()):
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(codes[a : a + n].tobytes(), len(seen)) for a, n in zip(starts, size, strict=True)])
        first = np.unique(which, return_index=True)[1]
    at, n = starts[first], size[first]
    picked = codes[np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)]
    n_bytes = np.concatenate(([0], np.cumsum(1 + (picked >= 0x80) + (picked >= 0x800) + (picked >= 0x10000).astype(np.int64))))
    offsets = n_bytes[np.concatenate(([0], np.cumsum(n)))].astype(np.int32)
    utf8 = picked.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(utf8)), which, np.searchsorted(begins, starts, side="right") - 1


def _plain(path: str, texts: list[str]):
    """Windows of (rows, texts without special strings), and a last (rows, None) of the special strings."""
    e, specials = encoder(path), []
    for window in e._segments(texts):
        specials += [r for r, t, _ in window if t is None]
        plain = [(r, t) for r, t, _ in window if t is not None]
        if plain:
            yield np.array([r for r, _ in plain]), [t for _, t in plain]
    yield np.array(specials, np.int64), None


def _texts(batches, text: str):
    for batch in K.each(batches, 1024):
        yield batch, pc.fill_null(batch.column(text).cast(pa.large_string()), "")


def _tally(batches, path: str, text: str, packed: bytes):
    """How often the task's texts have each pre-token, for those that they have LEAST times and more."""
    take(packed)
    found: dict[str, int] = {}

    def out():
        often = [(w, n) for w, n in found.items() if n >= LEAST and len(w) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["w", "n"])

    for _, column in _texts(batches, text):
        for _, plain in _plain(path, column.to_pylist()):
            if plain is not None:
                words, which, _ = distinct(plain)
                for w, n in zip(words.to_pylist(), np.bincount(which, minlength=len(words)).tolist(), strict=True):
                    found[w] = found.get(w, 0) + n
                if len(found) > CACHE:
                    yield out()
                    found.clear()
    yield out()


def _n_pieces(path: str, words: list[str]) -> list[int]:
    tokenize, alphabet = encoder(path).tokenizer.model.tokenize, _alphabet()
    return [len(tokenize(w.encode().decode("latin-1").translate(alphabet))) for w in words]


def _encode(batches, path: str):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(_n_pieces(path, batch.column("w").to_pylist()), pa.int32())], names=["w", "pieces"])


def frequent(docs: DataFrame, path: str, text: str = "text") -> tuple[pa.Array, np.ndarray]:
    """The corpus's most frequent pre-tokens, FREQUENT at most, each encoded once: words, numbers of pieces."""
    tally = docs.select(F.col(text).alias("t")).mapInArrow(functools.partial(_tally, path=path, text="t", packed=packed_classes()), "w string, n long")
    tally = written(tally.groupBy("w").agg(F.sum("n").alias("n")), "tally")
    steps = {r["step"]: r["n"] for r in tally.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count("*").alias("n")).collect()}  # 8 for each doubling
    least, room = max(steps, default=0) + 1, FREQUENT
    for step in sorted(steps, reverse=True):
        room -= steps[step]
        if room < 0:
            break
        least = step
    known = tally.where(F.floor(8 * F.log2("n")) >= least).select("w").mapInArrow(functools.partial(_encode, path=path), "w string, pieces int").toArrow()
    return known["w"].combine_chunks(), np.asarray(known["pieces"], np.int64)


def _sums(batches, path: str, text: str, names: list[str], between: list[str], words: pa.Array, pieces: np.ndarray, packed: bytes):
    """Rows with a number of their own: bytes, tokens of frequent pre-tokens, and the others with their frequencies."""
    take(packed)
    row = TaskContext.get().partitionId() << 40
    for batch, column in _texts(batches, text):
        known, rest = np.zeros(len(column), np.int64), []
        for rows, plain in _plain(path, column.to_pylist()):
            if plain is None:
                np.add.at(known, rows, 1)
                continue
            own, which, whose = distinct(plain)
            at = np.asarray(pc.fill_null(pc.index_in(own, value_set=words), -1))
            told = at[which] >= 0
            np.add.at(known, rows[whose[told]], pieces[at[which[told]]])
            pairs, n = np.unique(rows[whose[~told]] * np.int64(len(own)) + which[~told], return_counts=True)
            rest.append((pairs // len(own), own.take(pa.array(pairs % len(own))), n))
        whose = np.concatenate([np.empty(0, np.int64), *(r[0] for r in rest)])
        entries = pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], pa.string()), *(r[1] for r in rest)]), pa.array(np.concatenate([np.empty(0, np.int64), *(r[2] for r in rest)]))], names=["w", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(column) + 1)).astype(np.int32)), entries)
        added = [pa.array(np.arange(row, row + len(column))), pc.binary_length(column).cast(pa.int64()), pa.array(known), lists]
        row += len(column)
        kept = [batch.column(c) for c in batch.schema.names if c in names]
        yield pa.RecordBatch.from_arrays([*kept, *added], names=[*(c for c in batch.schema.names if c in names), *between])


def _pieces_of_others(batches, path: str):
    """Rows sorted by pre-token: each distinct one is encoded once."""
    last, pieces = None, 0
    for batch in batches:
        runs = batch.column("w").dictionary_encode()
        words, at = runs.dictionary.to_pylist(), np.asarray(runs.indices)
        n = np.array([pieces, *_n_pieces(path, words[1:])] if words and words[0] == last else _n_pieces(path, words), np.int64)
        if words:
            last, pieces = words[at[-1]], int(n[at[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n[at] * np.asarray(batch.column("n")))], names=["row", "tokens"])


def _by_library(batches, path: str, text: str, names: list[str]):
    for batch, column in _texts(batches, text):
        n = np.concatenate([np.empty(0, np.int64), *(_library(path)(column[a : a + 256].to_pylist()) for a in range(0, len(column), 256))]).astype(np.int64)
        kept = [batch.column(c) for c in batch.schema.names if c in names]
        yield pa.RecordBatch.from_arrays([*kept, pc.binary_length(column).cast(pa.int64()), pa.array(n)], names=[*(c for c in batch.schema.names if c in names), "n_bytes", "n_tokens"])


def count(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, drop_text: bool = False) -> DataFrame:
    """The input's columns with n_bytes, n_tokens and over_limit; no ids are made.  The kept columns are written once, so drop the text where it is not wanted."""
    kept = [f for f in docs.schema if f.name not in _ADDED and not (drop_text and f.name == text)]
    names = [f.name for f in kept]
    long = lambda n: T.StructField(n, T.LongType())
    if not supports(path):
        counted = docs.mapInArrow(functools.partial(_by_library, path=path, text=text, names=names), T.StructType([*kept, long("n_bytes"), long("n_tokens")]))
        return counted.withColumn("over_limit", F.col("n_tokens") > limit)
    words, pieces = frequent(docs, path, text)
    row, size, known, others = between = [prefix(docs) + c for c in ("row", "bytes", "known", "others")]
    rest = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), long("n")]))
    make = functools.partial(_sums, path=path, text=text, names=names, between=between, words=words, pieces=pieces, packed=packed_classes())
    table = written(docs.mapInArrow(make, T.StructType([*kept, long(row), long(size), long(known), T.StructField(others, rest)])), "frequencies")
    sent = table.select(F.col(row).alias("row"), F.explode(others).alias("e")).select("row", "e.w", "e.n").repartition("w").sortWithinPartitions("w")
    tokens = sent.mapInArrow(functools.partial(_pieces_of_others, path=path), "row long, tokens long").groupBy(F.col("row").alias(row)).agg(F.sum("tokens").alias(others))
    whole = table.drop(others).join(tokens, row, "left")
    n = F.col(known) + F.coalesce(others, F.lit(0))
    return whole.select(*(F.col(f"`{c}`") for c in names), F.col(size).alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))


def total(counted: DataFrame):
    """Corpus totals of a counted table."""
    return counted.agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
