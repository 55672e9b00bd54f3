"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's feature is the mean of the embeddings of its hashed byte n-grams (2 to
4 bytes of a lower-cased word with one boundary mark on either side).  A linear
softmax over that mean gives the language.  Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled
rows; a part of the sample that training does not see calibrates a temperature
and the score under which a prediction is rejected.

Since softmax input is linear in the embeddings, a trained model is folded into
one table of (bucket, language) logits, and a text is scored by one gather and
one segmented sum over its bytes.

Defined results: a null text or one with no letters is ``und`` with score 0 and
rejected; ties between languages go to the first in alphabetical order; without
any labelled row every text is ``und``; rows with a null key are not sampled, and
their ``held_out`` is null.  Other columns pass through untouched, under any name;
the columns that ``predict`` adds replace input columns of the same name, and
``known`` keeps the input's rows and columns as they are.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIM = 16
#: Rows of each language that are sampled for training and calibration, about.
ROWS_PER_LANGUAGE = 1000
#: Rows of a slice while sampling.
_SAMPLED = 256

_TABLE = K.letter_table()
_MUL = np.uint32(0x01000193)
_FIN = np.uint32(0x9E3779B1)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS + 1, languages); the last row, all zero, is for what is no n-gram
    bias: np.ndarray
    temperature: float
    reject_below: float


def gram_buckets(buf: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size, the bucket of the n-gram that starts at each byte, or BUCKETS."""
    x = buf.astype(np.uint32)
    letter = buf > 32
    out = []
    h = x.copy()
    inner = np.ones(len(buf), bool)  # bytes between the first and the last are letters
    for n in range(2, max(SIZES) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            out.append(np.empty(0, np.int64))
            continue
        if n > 2:
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        with np.errstate(over="ignore"):
            h = h[:m] * _MUL + x[n - 1 : n - 1 + m]
            if n in SIZES:
                bucket = ((h * _FIN) >> np.uint32(16)).astype(np.int32)
        if n in SIZES:
            valid = inner[:m] & (letter[:m] | letter[n - 1 : n - 1 + m])
            bucket[~valid] = BUCKETS
            out.append(bucket)
    return out


def _segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]]; starts may lie beyond the end."""
    out = np.zeros((len(starts), *values.shape[1:]), np.float64)
    ok = starts < len(values)
    if ok.any():
        out[ok] = np.add.reduceat(values, starts[ok], axis=0)
    return out


def _logit_sums(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((len(texts), len(model.languages)))
    counts = np.zeros(len(texts))
    for rows, parts in K.windows(texts, max(1 << 16, (1 << 21) // max(1, len(model.languages)))):
        buf, starts = K.joined(parts, _TABLE, b" ")
        part_sums = np.zeros((len(rows), len(model.languages)))
        part_counts = np.zeros(len(rows))
        for bucket in gram_buckets(buf):
            if len(bucket):
                part_sums += _segment_sums(model.logits.take(bucket, axis=0), starts)
                part_counts += _segment_sums((bucket != BUCKETS).astype(np.float32), starts)
        np.add.at(sums, rows, part_sums)
        np.add.at(counts, rows, part_counts)
    return sums, counts


def _probabilities(sums: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    z = (sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def score_batch(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index (-1: und), score, rejected."""
    low = K.lowered(texts)
    if not model.languages:
        return np.full(len(low), -1), np.zeros(len(low)), np.ones(len(low), bool)
    sums, counts = _logit_sums(low, model)
    p = _probabilities(sums, counts, model)
    best = p.argmax(axis=1)
    score = p[np.arange(len(p)), best]
    none = counts == 0
    # Bytes of longer characters count as letters above; of texts without a-z, those of nothing but signs have none.
    plain = np.asarray(pc.match_substring_regex(low, "[a-z]"))
    for i in np.flatnonzero(~none & ~plain):
        none[i] = not any(map(str.isalpha, texts[int(i)].as_py() or ""))
    best = np.where(none, -1, best)
    score = np.where(none, 0.0, score)
    return best, score, none | (score < model.reject_below)


# --- training -----------------------------------------------------------------


def _added(found: tuple[np.ndarray, np.ndarray] | None, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets with counts, of what was found and of a further part."""
    fresh, n = np.unique(buckets[buckets != BUCKETS], return_counts=True)
    if found is None:
        return fresh, n
    both, at = np.unique(np.concatenate((found[0], fresh)), return_inverse=True)
    return both, np.bincount(at, np.concatenate((found[1], n)), len(both))


def _counts_of(batches, text: str, lang: str):
    """One row per text: language, distinct buckets and their shares of the text's n-grams; only distinct buckets are held, never a dense row."""
    for batch in K.each(batches, _SAMPLED):
        low = K.lowered(batch.column(text))
        out_b, out_w = [b""] * len(low), [b""] * len(low)
        at, found = 0, None

        def end(row: int, found) -> None:
            if found is not None:
                out_b[row] = found[0].astype("<u4").tobytes()  # noqa: B023
                out_w[row] = (found[1] / max(found[1].sum(), 1)).astype("<f4").tobytes()  # noqa: B023

        for rows, parts in K.windows(low):  # the parts of a text follow one another
            for row, part in zip(rows, parts, strict=True):
                if row != at:
                    end(at, found)
                    at, found = row, None
                buf, _ = K.joined([part], _TABLE, b" ")
                found = _added(found, np.concatenate([b for b in gram_buckets(buf) if len(b)] or [np.empty(0, np.int32)]))
        end(at, found)
        yield pa.RecordBatch.from_arrays([batch.column(lang).cast(pa.string()), pa.array(out_b, pa.binary()), pa.array(out_w, pa.binary())], names=["lang", "buckets", "weights"])


def _sample(docs: DataFrame, text: str, lang: str, key: str, rows: int) -> list:
    """About `rows` labelled rows of each language, chosen by a hash of the key; a single scan of two narrow columns sets the shares."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).cast("string")).count().collect()}
    if not sizes:
        return []
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col(lang) == name, F.lit(min(1.0, rows / n))).otherwise(share)
    picked = labelled.where(F.pmod(F.xxhash64(F.lit("language sample"), F.col(key)), F.lit(1_000_003)) < share * 1_000_003)
    schema = "lang string, buckets binary, weights binary"
    return picked.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(functools.partial(_counts_of, text="t", lang="l"), schema).collect()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = 4, seed: int = 7) -> Model:
    """Fit on about rows_per_language rows of each language (the documented bound of the sample)."""
    rows = [r for r in _sample(docs, text, lang, key, rows_per_language) if r["buckets"]]
    rows.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["weights"])))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    x = [(np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["weights"], "<f4")) for r in rows]
    y = np.array([languages.index(r["lang"]) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: len(x) // 5]
    fit = order[len(x) // 5 :] if len(x) >= 10 else order
    n = len(languages)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w = rng.uniform(-0.5, 0.5, (DIM, n)).astype(np.float32)
    bias = np.zeros(n, np.float32)

    def means(ids):
        idx = np.concatenate([x[i][0] for i in ids])
        wt = np.concatenate([x[i][1] for i in ids])
        lens = np.array([len(x[i][0]) for i in ids])
        at = np.concatenate(([0], np.cumsum(lens)))[:-1]
        return idx, wt, lens, np.add.reduceat(emb[idx] * wt[:, None], at, axis=0)

    for epoch in range(epochs):
        fit = rng.permutation(fit)
        rate = 8.0 * (1 - epoch / epochs)
        for a in range(0, len(fit), 16):
            ids = fit[a : a + 16]
            idx, wt, lens, h = means(ids)
            z = h @ w + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            back = p @ w.T
            w -= 0.05 * rate * (h.T @ p) / len(ids)
            bias -= 0.01 * rate * p.mean(axis=0)
            grad = np.repeat(back, lens, axis=0) * wt[:, None]
            np.subtract.at(emb, idx, rate * grad)
    model = Model(languages, np.vstack([emb @ w, np.zeros((1, n), np.float32)]).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        z = np.concatenate([means(held[a : a + 64])[3] for a in range(0, len(held), 64)]) @ w + bias
        _calibrate(model, z, y[held])
    return model


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """Temperature by held-out likelihood; rejection under half the score of the least sure right prediction but a thousandth."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 10, 60):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        loss = -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean()
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    if len(right):
        model.reject_below = min(0.5, 0.5 * float(right[len(right) // 1000]))


# --- prediction ---------------------------------------------------------------


def _predict(batches, model: Model, text: str):
    names = np.array([*model.languages, "und"], object)
    for batch in K.each(batches, K.SLICE):
        best, score, rejected = score_batch(batch.column(text), model)
        added = [("lang_pred", pa.array(names[best], pa.string())), ("score", pa.array(score)), ("rejected", pa.array(rejected))]
        kept = [(c, batch.column(c)) for c in batch.schema.names if c not in ("lang_pred", "score", "rejected")]
        yield pa.RecordBatch.from_arrays([v for _, v in kept + added], names=[c for c, _ in kept + added])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input's columns with lang_pred, score and rejected; whole texts, no shuffle."""
    added = ("lang_pred", "score", "rejected")
    schema = T.StructType([*(f for f in docs.schema if f.name not in added), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(functools.partial(_predict, model=model, text=text), schema)


def _known(batches, model: Model, text: str):
    for batch in K.each(batches, K.SLICE):
        yield batch.filter(pa.array(~score_batch(batch.column(text), model)[2]))


def known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with the input's columns only."""
    return docs.mapInArrow(functools.partial(_known, model=model, text=text), docs.schema)


def held_out(key: str = "doc_id"):
    """The rows that training never sees: crc32 of the key as text divides by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
