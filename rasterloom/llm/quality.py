"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words.  Each passage is encoded (shares of character classes, word
statistics, repetition, hashed words; a learned tanh layer on top), gated attention weighs the passages,
and the weighted representation is scored by a logistic layer.  All weights are learned
together from document labels alone.

The fit uses a bounded sample of labelled documents, the `SAMPLE` with the smallest hash of
doc_id; scoring is a pass over the texts without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_BLANK, U64, Words, mix, pieces

#: Words of a passage.
PASSAGE = 100
#: Labelled documents that the model is fitted on at most.
SAMPLE = 6000
#: Passages of a document that the fit takes at most, evenly spread; scores take all.
PASSAGES = 40
#: Buckets that words are hashed into.
BUCKETS = 64
HIDDEN, GATE = 24, 12
ROUNDS, RATE, DECAY = 250, 0.02, 1e-4
THRESHOLD = 0.3

_CLASSES = 16
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 15 if _b >= 0x80 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == " " else 5 if _c == "\n" else 6 if _c in ".,;:" else 7 if _c in "!?" else 8 if _c in "'\"-()" else 9 if _c in "|" else 10 if _c in "*#" else 11 if _c in "$%&" else 12 if _c in "<>{}[]=_~^`\\" else 13 if _c in "@/+" else 14
WIDTH = _CLASSES + 8 + BUCKETS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each passage, first passage of each document and the end); a document without words has one empty passage."""
    w = Words(data, offsets, NOT_BLANK, LOWER)
    docs = len(offsets) - 1
    n = np.diff(w.first)
    each = np.maximum(1, -(-n // PASSAGE))
    first = np.append(0, np.cumsum(each))
    total = int(first[-1])
    x = np.zeros((total, WIDTH), np.float32)
    if not len(w.hash):
        return x, first
    doc = np.repeat(np.arange(docs), n)
    place = np.arange(len(doc)) - w.first[doc]
    of = first[doc] + place // PASSAGE
    size = np.bincount(of, minlength=total).astype(np.float32)
    some = np.maximum(size, 1)
    # bytes belong to the passage of the last word that has begun, blanks before the first word to that
    owner = np.repeat(of, np.diff(w.start, append=len(data)))
    lead = int(w.start[0])
    count = np.bincount(owner * _CLASSES + _CLASS[data[lead:]], minlength=total * _CLASSES).reshape(total, _CLASSES)
    x[:, :_CLASSES] = count / np.maximum(count.sum(1, keepdims=True), 1)
    at = _CLASSES
    length = (w.end - w.start).astype(np.float32)
    mean = np.bincount(of, length, total) / some
    x[:, at] = mean
    x[:, at + 1] = np.sqrt(np.maximum(np.bincount(of, length**2, total) / some - mean**2, 0))
    x[:, at + 2] = np.log1p(size)
    x[:, at + 3] = np.log1p(n)[np.repeat(np.arange(docs), each)]
    lone = np.unique(mix(w.hash + of.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    x[:, at + 4] = 1 - np.bincount(of[lone], minlength=total) / some
    again = np.zeros(len(doc), np.float32)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    x[:, at + 5] = np.bincount(of, again, total) / some
    g = w.grams(3)
    if len(g):
        lone = np.unique(mix(g + doc[: len(g)].astype(U64) * U64(0xD6E8FEB86659FD93)), return_index=True)[1]
        x[:, at + 6] = np.bincount(of[: len(g)], minlength=total) / some - np.bincount(of[lone], minlength=total) / some
    last = LOWER[data[w.end - 1]]
    x[:, at + 7] = np.bincount(of, ~((last >= 0x61) & (last <= 0x7A) | (last >= 0x80)), total) / some
    at += 8
    x[:, at:] = np.bincount(of * BUCKETS + (w.hash >> U64(40)).astype(np.int64) % BUCKETS, minlength=total * BUCKETS).reshape(total, BUCKETS) / some[:, None]
    return x, first


class Model:
    """Weights and the scale of the features."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        scaled = lambda a, b: (r.normal(size=(a, b)) / np.sqrt(a)).astype(np.float64)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"W": scaled(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": scaled(HIDDEN, GATE), "U": scaled(HIDDEN, GATE), "w": scaled(GATE, 1)[:, 0], "c": scaled(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, at = self.p, first[:-1]
        doc = np.repeat(np.arange(len(at)), np.diff(first))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, at)[doc])
        a = e / np.add.reduceat(e, at)[doc]
        z = np.add.reduceat(a[:, None] * h, at)
        return {"doc": doc, "h": h, "v": v, "u": u, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(np.clip((x - self.mean) / self.scale, -8, 8), first)["score"]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> "Model":
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x, p, at = np.clip((x - self.mean) / self.scale, -8, 8), self.p, first[:-1]
        m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, ROUNDS + 1):
            f = self.forward(x, first)
            doc, h, v, u, a = (f[k] for k in ("doc", "h", "v", "u", "a"))
            d = (f["score"] - y) / len(y)
            dz = d[:, None] * p["c"]
            da = (h * dz[doc]).sum(1)
            de = a * (da - np.add.reduceat(a * da, at)[doc])
            dv, du = de[:, None] * p["w"] * u * (1 - v * v), de[:, None] * p["w"] * v * u * (1 - u)
            dh = (a[:, None] * dz[doc] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": f["z"].T @ d, "d": np.array([d.sum()])}
            for k, g in grad.items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows that no model is fitted on."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """A model from labels (doc_id, quality) of documents that are not held out; None without labelled documents.

    Null labels and rows without doc_id are left out; of a doc_id with several labels the largest counts, and of one with
    several texts the smallest, so that the driver receives `sample` documents of PASSAGES passages at most.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            for row, to, data, offsets in pieces(batch, "text"):
                x, first = features(data, offsets)
                part = batch.slice(row, to - row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([x[a + np.arange(min(b - a, PASSAGES)) * (b - a) // min(b - a, PASSAGES)].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "quality", "x"])

    kind = {**dict(docs.dtypes), **dict(known.dtypes)}
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.mapInArrow(run, f"doc_id {kind['doc_id']}, quality {kind['quality']}, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.x))
    each = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    return Model().fit(np.concatenate(each).astype(np.float64), np.append(0, np.cumsum([len(e) for e in each])), np.array([float(r.quality > 0) for r in rows]))


def _scores(model: Model | None, batch: pa.RecordBatch) -> np.ndarray:
    if model is None:
        return np.ones(batch.num_rows)
    return np.concatenate([np.zeros(0), *(model.scores(*features(d, o)) for _, _, d, o in pieces(batch, "text"))])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null text is empty.  Without a model every score is 1.

    held_out of a row without doc_id is null.  Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            s = _scores(model, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that the model accepts, with all their columns, whatever the names.

    Null text is empty and is scored like it, rows of the same text stay or go together, all passages of a long
    text count, without a model all rows stay, and an empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
