"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
hashed word features (the word and its first four and five bytes, so inflected
forms share evidence); a document's score is the noisy-or of its sentences,
1 - prod(1 - p).  Weights are trained from document labels alone, by AdaGrad on
the likelihood of the noisy-or; the same sentence scores then say which
sentences offend.

Defined results: a null, empty or wordless text scores 0; sentences end at
``.``, ``!``, ``?`` or a line feed; sentences longer than a window of a
megabyte are scored in parts.  The sample of labelled rows is bounded by
``ROWS``; scoring covers every whole text.  A document labelled twice counts
twice; labels other than 0 and 1, and null labels, are left out.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

BUCKETS = 1 << 18
#: Labelled rows that are sampled for training, about.
ROWS = 16_000
#: Features of fewer sampled documents keep weight 0.
LEAST_DOCUMENTS = 20
RATE, DECAY, POSITIVE = 0.4, 6e-3, 2.0

_TABLE = K.letter_table(sentence_ends=True)
_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass
class Model:
    weights: np.ndarray  # float32, BUCKETS
    bias: float


def features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts; buckets (3, words) of word, 4-byte and 5-byte prefix; which of them hold (prefixes only of longer words)."""
    starts, ends = K.words(buf)
    size = ends - starts
    hashes = [K.run_hashes(buf, starts, ends)]
    holds = [np.ones(len(starts), bool)]
    for n in (4, 5):
        long = size > n
        hashes.append(K.run_hashes(buf, starts, np.where(long, starts + n, starts)) + np.uint64(n))
        holds.append(long)
    buckets = np.stack([(h >> np.uint64(46)).astype(np.int32) for h in hashes])
    return starts, buckets, np.stack(holds)


def _sentence_logs(buf: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence that has a weighted feature: its place (of its first word), and log(1 - p)."""
    starts, buckets, holds = features(buf)
    if not len(starts):
        return starts, np.empty(0)
    sentence = np.cumsum(buf == 10)[starts]
    new = np.concatenate(([True], sentence[1:] != sentence[:-1]))
    nth = np.cumsum(new) - 1
    # A feature counts once in a sentence, as in training; most have weight 0 and are left out first.
    holds &= model.weights[buckets] != 0
    once = np.unique((np.broadcast_to(nth, buckets.shape)[holds].astype(np.int64) << 32) | buckets[holds])
    told, at = np.unique(once >> 32, return_inverse=True)  # a sentence with no evidence for or against is left out
    z = np.bincount(at, model.weights[once & 0xFFFFFFFF], minlength=len(told)) + model.bias
    return starts[new][told], -np.logaddexp(0, z)


def score_batch(texts: pa.Array, model: Model) -> np.ndarray:
    low = K.lowered(texts)
    logs = np.zeros(len(low))
    for rows, parts in K.windows(low):
        buf, at = K.joined(parts, _TABLE, b"\n")
        places, log = _sentence_logs(buf, model)
        np.add.at(logs, np.asarray(rows)[np.searchsorted(at, places, side="right") - 1], log)
    return -np.expm1(logs)


def sentences_of(text: str, model: Model, least: float = 0.5) -> list[dict]:
    """Start, end (code points, end exclusive) and score of a text's sentences that score least or more."""
    spans = [m.span() for m in _SENTENCE.finditer(text)]
    if not spans:
        return []
    scores = score_batch(pa.array([text[a:b] for a, b in spans]), model)
    return [{"start": a, "end": b, "score": float(s)} for (a, b), s in zip(spans, scores, strict=True) if s >= least]


# --- training -----------------------------------------------------------------


def _bags(batches):
    """Per text: label, distinct buckets per sentence, and how many each sentence has."""
    for batch in K.each(batches):
        low = K.lowered(batch.column("t"))
        bags: list[list[np.ndarray]] = [[] for _ in range(len(low))]
        for rows, parts in K.windows(low):
            for row, part in zip(rows, parts, strict=True):
                buf, _ = K.joined([part], _TABLE, b"\n")
                starts, buckets, holds = features(buf)
                if len(starts):
                    sentence = np.cumsum(buf == 10)[starts]
                    both = np.unique((np.broadcast_to(sentence, buckets.shape)[holds].astype(np.int64) << 32) | buckets[holds])
                    cut = np.flatnonzero(np.diff(both >> 32)) + 1
                    bags[row] += np.split((both & 0xFFFFFFFF).astype("<u4"), cut)
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([b"".join(s.tobytes() for s in bag) for bag in bags], pa.binary()), pa.array([np.array([len(s) for s in bag], "<u4").tobytes() for bag in bags], pa.binary())],
            names=["label", "buckets", "sizes"],
        )


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = ROWS, epochs: int = 8, seed: int = 11) -> Model:
    """Fit on about `rows` labelled documents (the documented bound), all of them when there are fewer."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    n = marked.count()
    if not n:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    share = min(1.0, rows / n)
    marked = marked.where(F.pmod(F.xxhash64(F.lit("toxicity sample"), "k"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    bags = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(marked, "k").select("t", "label")
    got = bags.mapInArrow(_bags, "label int, buckets binary, sizes binary").collect()
    got = sorted(((r["label"], bytes(r["buckets"]), bytes(r["sizes"])) for r in got if r["sizes"]))
    model = Model(np.zeros(BUCKETS, np.float32), -5.0)
    if not got:
        return model
    x = [(np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(s, "<u4").astype(np.int64)) for _, b, s in got]
    y = np.array([g[0] for g in got], np.float64)
    seen = np.bincount(np.concatenate([np.unique(b) for b, _ in x]), minlength=BUCKETS)
    common = seen >= LEAST_DOCUMENTS  # a bucket of fewer documents would only be learned by heart
    rng = np.random.default_rng(seed)
    w, squares, bias, bias_squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), -5.0, 1.0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 32):
            ids = order[a : a + 32]
            idx = np.concatenate([x[i][0] for i in ids])
            sizes = np.concatenate([x[i][1] for i in ids])
            bag = np.repeat(np.arange(len(ids)), [len(x[i][1]) for i in ids])
            at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            z = np.add.reduceat(w[idx], at) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            none = np.exp(np.bincount(bag, -np.logaddexp(0, z), len(ids)))  # no sentence offends
            some = np.maximum(1 - none, 1e-6)
            grad = np.where(y[ids][bag] == 1, -POSITIVE * (none / some)[bag], 1.0) * p
            g = np.repeat(grad, sizes)
            buckets, inv = np.unique(idx, return_inverse=True)
            total = np.bincount(inv, g, len(buckets)) + DECAY * w[buckets]
            squares[buckets] += total * total
            w[buckets] -= np.where(common[buckets], RATE * total / np.sqrt(squares[buckets]), 0)
            bias_squares += grad.sum() ** 2
            bias -= 0.05 * grad.sum() / np.sqrt(bias_squares)
    w[np.abs(w) < 0.05] = 0
    return Model(w.astype(np.float32), float(bias))


# --- scoring ------------------------------------------------------------------

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ADDED = {"score": T.DoubleType(), "predicted": T.IntegerType(), "offending": _SPANS}
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(batches, model: Model, text: str, drop_text: bool):
    for batch in K.each(batches):
        score = np.clip(score_batch(batch.column(text), model), 0.0, 1.0)
        toxic = score >= 0.5
        spans = [sentences_of(batch.column(text)[i].as_py(), model) if toxic[i] else [] for i in range(len(score))]
        kept = [(c, batch.column(c)) for c in batch.schema.names if c not in _ADDED and not (drop_text and c == text)]
        kept += [("score", pa.array(score)), ("predicted", pa.array(toxic.astype(np.int32))), ("offending", pa.array(spans, _ARROW_SPANS))]
        yield pa.RecordBatch.from_arrays([v for _, v in kept], names=[c for c, _ in kept])


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """The input's columns with score, predicted and the offending sentences of documents predicted toxic."""
    kept = [f for f in docs.schema if f.name not in _ADDED and not (drop_text and f.name == text)]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in _ADDED.items())])
    return docs.mapInArrow(functools.partial(_score, model=model, text=text, drop_text=drop_text), schema)
