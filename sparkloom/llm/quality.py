"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import OWN, bounded_batches

BITS = 18
#: Labelled rows that the model is fitted on at most: those of least hash of their id.
MAX_TRAIN = 4000
EPOCHS = 4
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Values of a text's vector sum to this.
NORM = 16.0

_KIND = np.full(256, 2, np.uint8)  # 0: space, 1: part of a word, 2: punctuation
_KIND[K.SPACE] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER, _DIGIT = K.bytes_table((65, 90)), K.bytes_table((48, 57))
_REPEAT, _SHAPE = np.uint64(0x51ED270B9F3A2C77), np.uint64(0x2545F4914F6CDD1D)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts and the text of each: words and runs of punctuation, alone (case
    folded, with their shape), in pairs, and pairs of shapes. Two equal neighbours are one feature."""
    kind = _KIND[data]
    n = len(data)
    if not n or not kind.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = np.append(True, kind[1:] != kind[:-1]) | edge[:n]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    tokens = kind[begin] != 0
    begin, end = begin[tokens], end[tokens]
    text = np.searchsorted(offsets, begin, "right") - 1
    word = K.hash_ranges(K.LOWER[data], begin, end, K.MULTS[0], K.BYTE_VALUES)
    first, second = data[begin], data[np.minimum(begin + 1, n - 1)]
    more = end - begin > 1
    upper = _UPPER[first]
    shape = np.where(kind[begin] == 2, 4 + more, upper.astype(np.uint8) + (upper & _UPPER[second] & more)).astype(np.uint64)
    shape[_DIGIT[first]] = 3
    same = text[1:] == text[:-1]
    pair = np.where(word[1:] == word[:-1], _REPEAT, word[:-1] * np.uint64(K.MULTS[2]) + word[1:])[same]
    shapes = ((shape[:-1] * np.uint64(8) + shape[1:] + np.uint64(1)) * _SHAPE)[same]
    hashed = K.mix(np.concatenate([word + shape * _SHAPE, pair, shapes]))
    return (hashed >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([text, text[1:][same], text[1:][same]])


def vectors(column: pa.Array, bits: int = BITS):
    """Feature indexes and values (n-gram counts scaled to sum NORM), and n + 1 offsets by text."""
    data, offsets = K.utf8(column)
    index, text = features(data, offsets, bits)
    keys, counts = np.unique((text << bits) | index, return_counts=True)
    text, index = keys >> bits, keys & ((1 << bits) - 1)
    total = np.bincount(text, counts, minlength=len(column))
    return index, counts * NORM / np.maximum(total, 1)[text], np.searchsorted(text, np.arange(len(column) + 1))


def fit_ftrl(rows, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from a list of (indexes, values, label) rows, in their order. No rows: all zero.

    Beside the rows only one of them is held, widened to 64 bits."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, v, y in rows:
            i, v = np.append(i.astype(np.int64), bias), np.append(v.astype(float), 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (p - y) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    return w[:bias], float(w[bias])


def score_batch(column: pa.Array, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 for each text; an empty or null text gets that of the bias."""
    data, offsets = K.utf8(column)
    sums, counts = np.zeros(len(column)), np.zeros(len(column))
    i = 0
    while i < len(column):  # pieces of whole texts
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + K.PIECE, "right")) - 1)
        index, text = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
        sums[i:j] = np.bincount(text, weights[index], minlength=j - i)
        counts[i:j] = np.bincount(text, minlength=j - i)
        i = j
    return 1 / (1 + np.exp(-np.clip(bias + NORM * sums / np.maximum(counts, 1), -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: CRC-32 of the id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def _rows(sample: pa.Table) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(indexes, values, label) of each row of (doc, y, i, v): views, so that the sample is held once."""
    out = []
    for batch in sample.to_batches():
        at = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)).tolist()
        i, v = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
        out += [(i[a:b], v[a:b], y) for a, b, y in zip(at[:-1], at[1:], batch.column(1).to_pylist(), strict=True)]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_train`` labelled rows that aren't held out: those of least hashed id.

    Rows without label or id are ignored. Of several rows with one id, the least label and the least
    text count. The sample is bounded by its parameter, so it may be broadcast; each text's vector is
    bounded by the hash space, so the driver holds a bounded sample of vectors and no text.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc")).agg((F.min(label_col) > 0).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc"), "doc").limit(max_train)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc").groupBy("doc", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            index, values, at = vectors(b.column(2))
            kind = pa.list_(pa.int32()), pa.list_(pa.float32())
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(t))) for x, t in ((index, np.int32), (values, np.float32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(x.cast(t) for x, t in zip(lists, kind, strict=True))], ["doc", "y", "i", "v"])

    got = sample.mapInArrow(run, "doc long, y double, i array<int>, v array<float>").orderBy(F.xxhash64("doc"), "doc").toArrow()
    model = fit_ftrl(_rows(got))
    del got
    pa.default_memory_pool().release_unused()
    return model


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row, without a shuffle.

    The score depends on the whole text alone. Null and empty texts get the bias's score; a null id is
    held out and stays null; repeated rows are scored each; extra columns are ignored; an empty table
    gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    weights, bias = model

    def run(batches):
        for b in batches:
            p = score_batch(b.column(2), weights, bias)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns, without a shuffle.

    Null and empty texts stay or go with the bias's score; repeated rows are judged each; an empty table
    gives an empty result."""
    bounded_batches(docs.sparkSession)
    weights, bias = model
    name = OWN + "scored"

    def run(batches):
        for b in batches:
            keep = score_batch(b.column(b.num_columns - 1), weights, bias) >= threshold
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(keep))

    return docs.withColumn(name, F.col(text_col)).mapInArrow(run, docs.schema)
