"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, pairs of neighbours, pairs with one word
between, and the first bytes of longer words (inflected words share them). Each coordinate has its
own learning rate, and the L1 term keeps all weights but the useful ones at zero, so that the model
is a short list, sent to every task. It is fitted in one task on a bounded sample, in the order of a
hash; scoring covers every row and text whole.

Rows: null and empty texts have no feature; their score is the one of the bias alone. Without
labelled rows every score is 0. Repeated rows score alike. Other columns travel in a struct,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.scratch import others

BITS = 20
STEMS = (4, 6, 8)


class Rates(NamedTuple):
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 4
    least_rows: int = 3


class Model(NamedTuple):
    """Sorted feature numbers with non-zero weights; the bias; ``fitted`` is False without labels."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int
    fitted: bool


def grams(piece: words.Piece, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays: feature numbers and the texts they stand in, with repetitions."""
    data = words.LOWER[piece.data]
    spots = words.split(data, piece.bounds, words.ALPHANUMERIC)
    hashes = words.word_hashes(data, spots.starts, spots.ends)
    own, shift = words.owners(spots.first), np.uint64(64 - bits)
    out = []

    def add(values, of, kind):
        out.append(((words.mix(values + np.uint64(kind)) >> shift).astype(np.int64), of))

    add(hashes, own, 1)
    for gap in (1, 2):
        same = np.flatnonzero(own[:-gap] == own[gap:])
        add(hashes[same] * np.uint64(words.BASE) + hashes[same + gap], own[same], 1 + gap)
    for stem in STEMS:
        long = np.flatnonzero(spots.ends - spots.starts > stem)
        starts = spots.starts[long]
        add(words.word_hashes(data, starts, starts + stem), own[long], 4 + stem)
    return out


def _features(batches, bits):
    """The distinct features of each row, with the rows' labels and keys."""
    for batch in batches:
        for piece in words.pieces(batch):
            numbers, of = (np.concatenate(x) for x in zip(*grams(piece, bits)))
            both = np.unique(of * (1 << bits) + numbers)
            ends = np.searchsorted(both, np.arange(len(piece.bounds)) << bits)
            numbers = (both & ((1 << bits) - 1)).astype(np.int32)
            labels = piece.rows.column("label").to_numpy(zero_copy_only=False)
            keys = piece.rows.column("key").to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                yield int(keys[i]), float(labels[i]), numbers[a:b].copy()


def ftrl(rows: list[tuple[float, np.ndarray]], bits: int, rates: Rates):
    """Follow the regularised leader: the features with weights, and these; the last possible one is
    the bias. Features of fewer than ``least_rows`` rows are left out."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at):
        own = z[at]
        shrunk = np.sign(own) * np.maximum(np.abs(own) - rates.l1, 0)
        return -shrunk / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2)

    seen = np.zeros(size, np.int32)
    for _, numbers in rows:
        seen[numbers] += 1
    rows = [(label, numbers[seen[numbers] >= rates.least_rows]) for label, numbers in rows]
    for _ in range(rates.epochs):
        for label, numbers in rows:
            at = np.append(numbers, size - 1)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rates.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    used = np.flatnonzero(weight(np.arange(size)))
    return used, weight(used)


def fit(rows: DataFrame, bits: int = BITS, rates: Rates = Rates()) -> Model:
    """From a bounded sample (key, text, label 0 or 1): the model."""

    def run(batches):
        found = list(_features(batches, bits))
        found.sort(key=lambda r: words.mix(np.array([r[0]], np.int64).view(np.uint64))[0])
        if not found:
            return
        used, weights = ftrl([(label, numbers) for _, label, numbers in found], bits, rates)
        yield pa.RecordBatch.from_arrays(
            [pa.array([used.tolist()]), pa.array([weights.tolist()])], names=["features", "weights"])

    result = rows.select("key", "text", "label").repartition(1).mapInArrow(
        run, "features array<long>, weights array<double>").collect()
    if not result:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0, bits, False)
    used, weights = np.array(result[0][0], np.int64), np.array(result[0][1], float)
    bias = weights[used == 1 << bits].sum()
    return Model(used[used < 1 << bits], weights[used < 1 << bits], float(bias), bits, True)


def _score(shared):
    def run(batches):
        model: Model = shared.value
        weights = np.zeros(1 << model.bits, np.float32)
        weights[model.features] = model.weights
        for batch in batches:
            for piece in words.pieces(batch):
                total = np.full(len(piece.bounds) - 1, model.bias)
                hit = [(numbers[k], of[k]) for numbers, of in grams(piece, model.bits)
                       for k in [np.flatnonzero(weights[numbers])]]
                numbers, of = (np.concatenate(x) for x in zip(*hit))
                both = np.unique(of * (1 << model.bits) + numbers)
                np.add.at(total, both >> model.bits, weights[both & ((1 << model.bits) - 1)])
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if model.fitted else total * 0
                yield pa.RecordBatch.from_arrays(
                    [*piece.rows.columns, pa.array(score)],
                    names=[*piece.rows.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Per row: ``row`` (struct of all columns but the text), ``text``, ``score`` from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.struct(*others(docs, text_column)).alias("row"),
        F.col(text_column).cast("string").alias("text"),
    )
    out = T.StructType([*rows.schema, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(shared), out)
