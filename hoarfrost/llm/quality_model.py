"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is
encoded as features; a gated attention net weighs them
(softmax of w . (tanh(V h) * sigmoid(U h))), and a logistic layer scores the
weighted sum of the encodings. Weights, gates and scorer are learnt together
from the documents' labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import learnable, mapped, named, others, schema_of, slices, taken, utf8, written

#: Words of a passage; buckets of hashed character pairs; size of encodings and of attention.
PASSAGE_WORDS, BUCKETS, ENCODING, ATTENTION = 64, 64, 24, 12
#: Labelled rows that are learnt from at most, and the passages that these rows have in all at most. A row comes with all its passages or not at all.
SAMPLE_ROWS, SAMPLE_PASSAGES = 4000, 96_000

_KINDS = np.full(256, 7, np.int64)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-", b"!?", None]):
    if _chars:
        _KINDS[np.frombuffer(_chars, np.uint8)] = _k
_KINDS[128:] = 8
_KINDS[0xC3] = 8
_KIND_COUNT, _SHAPE = 9, 6
FEATURES = _KIND_COUNT + _SHAPE + BUCKETS + 1
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of passages whose features are worked out together.
FEATURE_BYTES = 1 << 20


def passages(text: bytes) -> list[bytes]:
    """Runs of PASSAGE_WORDS words; the last may be shorter; a text without words is one empty passage."""
    word = np.append(_IN_WORD[np.frombuffer(text, np.uint8)], False)
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    if not len(ends):
        return [b""]
    cuts = [0, *ends[PASSAGE_WORDS - 1 :: PASSAGE_WORDS].tolist()]
    if cuts[-1] != ends[-1]:
        cuts.append(int(ends[-1]))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def features(parts: list[bytes]) -> np.ndarray:
    """(passage, FEATURES): shares of kinds of characters, shape of the words, shares of hashed pairs. Passages are taken some at a time, so that arrays of eight bytes a byte stay small."""
    sizes = np.array([len(p) for p in parts])
    group = np.cumsum(sizes) // FEATURE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(parts)]
    return np.concatenate([_features(parts[a:b], sizes[a:b]) for a, b in zip(cuts, cuts[1:])])


def _features(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    n = len(parts)
    data = np.frombuffer(b"".join(parts), np.uint8)
    own = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(own * _KIND_COUNT + _KINDS[data], minlength=n * _KIND_COUNT).reshape(n, -1)
    pair = (data[:-1].astype(np.int64) * 131 + data[1:]) * 2654435761 >> 12 & (BUCKETS - 1)
    inside = own[:-1] == own[1:] if len(data) else np.zeros(0, bool)
    pairs = np.bincount(own[:-1][inside] * BUCKETS + pair[inside], minlength=n * BUCKETS).reshape(n, -1)
    shape = np.zeros((n, _SHAPE))
    for i, p in enumerate(parts):
        words = p.split()
        if words:
            different = len(set(words))
            shape[i] = [different / len(words), len(set(w.lower() for w in words)) / len(words), len(words) / PASSAGE_WORDS, sum(map(len, words)) / len(words) / 10, max(map(len, words)) / 40, sum(len(w) == 1 for w in words) / len(words)]
    whole = np.maximum(sizes, 1)[:, None]
    return np.concatenate([np.sqrt(kinds / whole), shape, np.sqrt(pairs / whole), np.ones((n, 1))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """mean, scale: of the features. E: encoder. V, U, w: gated attention. c, b: scorer."""

    mean: np.ndarray
    scale: np.ndarray
    E: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int):
        """Everything between features (rows sorted by bag) and the bags' scores."""
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ self.E)
        t, s = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        a = (t * s) @ self.w
        first = np.searchsorted(bag, np.arange(bags))
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return x, h, t, s, a, z, _sigmoid(z @ self.c + self.b)

    def gradients(self, x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags' labels (0/1), for every weight."""
        bags = len(labels)
        x, h, t, s, a, z, p = self.forward(x, bag, bags)
        error = (p - labels) / bags
        dz = error[:, None] * self.c
        # The attention's gradient: through the softmax of each bag.
        reach = (dz[bag] * h).sum(1)
        first = np.searchsorted(bag, np.arange(bags))
        da = a * (reach - np.add.reduceat(a * reach, first)[bag])
        dt = da[:, None] * self.w * s * (1 - t * t)
        ds = da[:, None] * self.w * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ self.V.T + ds @ self.U.T
        return {"c": z.T @ error, "b": error.sum(), "w": (t * s).T @ da, "V": h.T @ dt, "U": h.T @ ds, "E": x.T @ (dh * (1 - h * h))}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        out = []
        group: list[list[bytes]] = []
        size = 0
        for t in texts:
            group.append(passages(t))
            size += len(group[-1])
            if size > 4096:
                out.append(self._scores(group))
                group, size = [], 0
        if group:
            out.append(self._scores(group))
        return np.concatenate(out)

    def _scores(self, groups: list[list[bytes]]) -> np.ndarray:
        bag = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        return self.forward(features([p for g in groups for p in g]), bag, len(groups))[-1]

    @staticmethod
    def constant(share: float) -> Model:
        """A model that gives every text the same score: for no labels or labels of one kind."""
        share = min(max(share, 1e-3), 1 - 1e-3)
        z = np.zeros
        return Model(z(FEATURES), np.ones(FEATURES), z((FEATURES, ENCODING)), z((ENCODING, ATTENTION)), z((ENCODING, ATTENTION)), z(ATTENTION), z(ENCODING), np.array(np.log(share / (1 - share))))


def fit(bags: list[np.ndarray], labels: np.ndarray, rounds: int = 12, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the mean cross-entropy of the bags' labels (0/1); the same input gives the same model."""
    if not len(labels) or labels.min() == labels.max():
        return Model.constant(float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    mean = sum(b.sum(0, dtype=float) for b in bags) / sum(map(len, bags))
    spread = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / sum(map(len, bags)))
    model = Model(mean, spread + 1e-3, *(rng.normal(0, 1 / np.sqrt(m), (m, n)) for m, n in ((FEATURES, ENCODING), (ENCODING, ATTENTION), (ENCODING, ATTENTION))), rng.normal(0, 0.3, ATTENTION), rng.normal(0, 0.1, ENCODING), np.array(0.0))
    model.mean[-1] = 0
    model.scale[-1] = 1
    names = ["E", "V", "U", "w", "c", "b"]
    m = {k: np.zeros_like(getattr(model, k)) for k in names}
    v = {k: np.zeros_like(getattr(model, k)) for k in names}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            bag = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            grads = model.gradients(np.concatenate([bags[i] for i in part]), bag, labels[part])
            step += 1
            for k in names:
                g = grads[k] + decay * getattr(model, k)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(model, k, getattr(model, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    return model


def sampled(labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id") -> DataFrame:
    """rows learnable labels at most: those with the smallest hashes of their ids, which is a sample that doesn't depend on the data's order."""
    known = labels.select(named(doc_id).alias(doc_id), named(target).alias(target)).where(learnable(named(doc_id)) & named(target).isNotNull() & named(doc_id).isNotNull())
    return known.groupBy(named(doc_id).alias(doc_id)).agg(F.max(named(target)).alias(target)).orderBy(F.xxhash64(named(doc_id), F.lit(17)), named(doc_id)).limit(rows)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_PASSAGES) -> Model:
    """Learn from the texts of at most rows labelled documents, never from ids that learnable() holds out.

    Every passage of a learnt row is encoded as features by Spark. Rows are
    taken in the order of their hashed ids while their passages are limit or
    fewer in all (the first one always), so limit * FEATURES numbers bound
    what reaches the driver by fewer rows, never by parts of texts. Of several
    rows of one id the label is the largest. No labels, or labels of one kind
    only, give a constant model.
    """
    chosen = sampled(labels, target, rows, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 128):
            out = [features(passages(t)).astype("<f4").tobytes() for t in utf8(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // (4 * FEATURES) for x in out], pa.int64()), pa.array(out, pa.binary())], names=["id", "y", "n", "x"])

    picked = docs.select(named(doc_id).alias("id"), named(text).alias("text")).join(F.broadcast(chosen.select(named(doc_id).alias("id"), named(target).cast("int").alias("y"))), "id")  # at most rows
    ids = docs.schema[doc_id].dataType.simpleString()
    encoded = written(picked.select("id", "y", "text").mapInArrow(run, schema_of(picked, ["id", "y"], "n long, x binary")), "encoded")
    rank = F.xxhash64("id", F.lit(17))
    sizes = encoded.groupBy("id").agg(F.sum("n").alias("n")).orderBy(rank, "id").limit(rows).collect()
    whole = np.cumsum([r.n for r in sizes])
    last = sizes[max(1, int(np.searchsorted(whole, limit, "right"))) - 1 :][:1]  # the last id that fits
    fits = F.struct(rank, "id") <= F.struct(F.xxhash64(F.lit(last[0].id).cast(ids), F.lit(17)), F.lit(last[0].id).cast(ids)) if last else F.lit(False)
    found = encoded.where(fits).select("id", "y", "x").orderBy("id", "x").limit(rows).collect()
    return fit([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in found], np.array([float(r.y > 0) for r in found]))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) added; null and empty texts are one empty passage and are scored too.

    Scores are rounded to six places, so that they don't depend on which texts
    are scored together. Repeated rows have one score, and an empty table gives
    an empty result. A column of that name is replaced. No shuffle.
    """
    rest = others(docs, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(np.round(model.score(utf8(b, text)), 6), pa.float64())], names=[*rest, column])

    return mapped(docs, rest, run, StructType([*schema_of(docs, rest).fields, StructField(column, DoubleType())]))
