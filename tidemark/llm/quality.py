"""Quality by Bradley-Terry ranking: a document beats another with the probability
``sigmoid(s1 - s2)``, where the score ``s`` is linear in measures of the text.

The measures are shares of kinds of bytes and words (``measures``), standardised. Preference pairs
are a better and a worse labelled row; the loss is logistic on the differences of their measures and
is minimised by Newton steps with a ridge. Scores are then cut at the quantile that leaves as large a
share above as there are good rows, and mapped to 0..1 so that this cut lies at ``threshold``.

All labelled rows are learnt from. They are dealt by a hash of the key to buckets of about ``BUCKET``
rows, and within a bucket every row is paired with several of the other kind, with all if there are few.
Where one kind is rare its rows are dealt to several buckets, so that none lacks it. A Newton step is
one pass over the buckets, from which the driver gets sums of a few hundred numbers; means, deviations
and the cut, an exact quantile, are of all rows too. Hashes decide the pairs, not partitions.

Rows: null and empty texts have all measures zero and score like any other. Without labelled rows of
both kinds every score is the share of good rows (0 if there are none). Repeated rows score alike.
Other columns travel in a struct, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.scratch import others, stored
from tidemark.operators.quantiles import exact_quantiles

PAIRS, LEAST_PAIRS = 200_000, 8
BUCKET, LEAST_OF_KIND = 4096, 64
THRESHOLD = 0.3
RIDGE = 1e-3


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float
    share: float


def _kinds() -> np.ndarray:
    """A kind for each byte: 0 others, then capitals, small letters, digits, white space, sentence
    signs, bars, exclamation marks, and other signs."""
    kinds = np.zeros(256, np.uint8)
    for number, group in enumerate(
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
         b" \t\n\r\v\f", b".,;:?'\"-", b"|", b"!", b"#$%&*+/<=>@[\\]^_`{}~()"), 1):
        kinds[list(group)] = number
    return kinds


KINDS = _kinds()
NAMES = (
    "capitals", "small", "digits", "space", "sentence_signs", "bars", "exclamations", "signs",
    "lines", "same_as_last", "same_as_earlier", "word_length", "log_words", "stops",
    "some_capitals", "some_bars", "some_exclamations", "some_signs", "some_same",
)


def measures(piece: words.Piece) -> np.ndarray:
    """A row of numbers for each text."""
    n_texts = len(piece.bounds) - 1
    size = np.maximum(np.diff(piece.bounds), 1)
    kinds = KINDS[piece.data]

    def share(which):
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(which, out=total[1:])
        return (total[piece.bounds[1:]] - total[piece.bounds[:-1]]) / size

    by_kind = [share(kinds == k) for k in range(1, 9)]
    spots = words.split(piece.data, piece.bounds, words.NOT_SPACE)
    hashes = words.word_hashes(piece.data, spots.starts, spots.ends)
    count = np.diff(spots.first)
    least = np.maximum(count, 1)
    own = words.owners(spots.first)

    def word_share(which):
        return words.sums_by_text(which.astype(np.int64), spots.first) / least

    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    # runs of three words that the text has had before
    runs = words.rolled(hashes, 3) if len(hashes) else hashes
    order = np.lexsort((runs, own))
    earlier = np.zeros(len(hashes), bool)
    earlier[order[1:]] = (runs[order[1:]] == runs[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    # the last two words of a text begin no run of their own text's words
    earlier &= words.fits(spots.first, 3)
    stop = np.zeros(len(hashes), bool)
    if len(hashes):
        stop = np.isin(piece.data[spots.ends - 1], list(b".?"))
    same = word_share(again)
    columns = [
        *by_kind, share(piece.data == 10), same, word_share(earlier),
        words.sums_by_text(spots.ends - spots.starts, spots.first) / least / 10,
        np.log1p(count) / 10, word_share(stop),
        *(np.minimum(10 * x, 1) for x in (by_kind[0], by_kind[5], by_kind[6], by_kind[7], same)),
    ]
    return np.stack(columns, 1).reshape(n_texts, len(NAMES))


def measured(rows: DataFrame) -> DataFrame:
    """The rows with ``x``, the measures, in place of ``text``."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch):
                found = measures(piece)
                x = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(found) + 1) * len(NAMES), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.rows.column(c) for c in names), x], names=[*names, "x"])

    kept = rows.select(*names)
    out = T.StructType([*kept.schema, T.StructField("x", T.ArrayType(T.DoubleType()))])
    return rows.select(*names, "text").mapInArrow(run, out)


def _bucket(group: pa.Table) -> pa.Table:
    """A bucket's measures, the better rows first, each kind in the order of its keys' hashes."""
    order = np.lexsort((group["key"].to_numpy(), group["place"].to_numpy()))
    good = group["good"].to_numpy()[order]
    x = group["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))[order]
    return pa.table({
        "bucket": group["bucket"][:1], "n_good": pa.array([int(good.sum())], pa.int64()),
        "x": pa.array([np.concatenate([x[good], x[~good]]).tobytes()], pa.binary()),
    })


def _buckets(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """Rows (key, good, x), dealt to buckets: one row for each."""
    n = -(-(n_good + n_bad) // BUCKET)
    copies = {kind: min(n, -(-LEAST_OF_KIND * n // size)) for kind, size in ((True, n_good), (False, n_bad))}
    dealt = rows.withColumn("place", F.xxhash64("key")).withColumn("bucket", F.explode(F.expr(
        f"transform(sequence(0, if(good, {copies[True]}, {copies[False]}) - 1), "
        f"i -> pmod(pmod(place, {n}) + i, {n}))")))
    return dealt.groupBy("bucket").applyInArrow(_bucket, "bucket long, n_good long, x binary")


def _newton(w: np.ndarray, mean: np.ndarray, scale: np.ndarray, turns: int):
    """Per task: the sums of weights, slope and curvature over its buckets' pairs. The pairs of a bucket
    weigh as much as it has rows of the more frequent kind."""
    width = len(w)

    def run(rows):
        out = np.zeros((width + 1, width + 1))
        for row in rows:
            x = (np.frombuffer(bytes(row["x"])).reshape(-1, width) - mean) / scale
            good, bad = x[: row["n_good"]], x[row["n_good"] :]
            if not len(good) or not len(bad):
                continue
            more, fewer, sign = (good, bad, 1.0) if len(good) >= len(bad) else (bad, good, -1.0)
            times = min(turns, len(fewer))
            for turn in range(times):
                d = sign * (more - fewer[(np.arange(len(more)) + turn) % len(fewer)])
                p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
                out[:width, :width] += (d * (p * (1 - p))[:, None]).T @ d / times
                out[width, :width] -= d.T @ p / times
            out[width, width] += len(more)
        yield out

    return run


def fit(
    rows: DataFrame, threshold: float = THRESHOLD, pairs: int = PAIRS, steps: int = 25
) -> Model:
    """From rows (key, text, label 0 or 1), or (key, x, label) with measures: the model. Few rows are
    paired more often, to make about so many pairs."""
    rows = rows if "x" in rows.columns else measured(rows.select("key", "label", "text"))
    rows = stored(rows.select("key", (F.col("label") > 0.5).alias("good"), "x"), "measures")
    width = len(NAMES)
    each = [F.col("x")[i] for i in range(width)]
    first = rows.agg(
        F.count(F.lit(1)), F.count_if("good"), F.array(*map(F.avg, each)),
        F.array(*map(F.stddev_pop, each))).first()
    n, n_good = first[0], first[1]
    share = n_good / n if n else 0.0
    if n_good in (0, n):
        none = np.zeros(width)
        return Model(none, none + 1, none, 0.0, threshold, share)
    mean, scale = np.array(first[2]), np.maximum(np.array(first[3]), 1e-6)
    held = _buckets(rows, n_good, n - n_good).rdd.persist(StorageLevel.MEMORY_AND_DISK)
    turns = max(LEAST_PAIRS, -(-pairs // max(n_good, n - n_good)))
    w = np.zeros(width)
    for _ in range(steps):
        sums = sum(held.mapPartitions(_newton(w, mean, scale, turns)).collect())
        total = sums[width, width]
        gradient = RIDGE * w + sums[width, :width] / total
        curve = sums[:width, :width] / total + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    held.unpersist()
    terms = [(x - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(v))
             for x, m, s, v in zip(each, mean, scale, w)]
    raw = rows.select(sum(terms[1:], terms[0]).alias("raw"))
    [cut] = exact_quantiles(raw, ["raw"], [1 - share])[("raw",)]
    return Model(mean, scale, w, cut, threshold, share)


def _score(shared):
    def run(batches):
        model: Model = shared.value
        base = np.log(model.threshold / (1 - model.threshold))
        for batch in batches:
            for piece in words.pieces(batch):
                if model.weights.any():
                    raw = (measures(piece) - model.mean) / model.scale @ model.weights
                    score = 1 / (1 + np.exp(-np.clip(raw - model.cut + base, -35, 35)))
                else:
                    score = np.full(len(piece.bounds) - 1, model.share)
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
