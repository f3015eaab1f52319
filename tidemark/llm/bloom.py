"""Exact membership from a cascade of Bloom filters over a complete universe of keys.

The first filter holds the listed keys. Keys of the universe that it lets through by mistake go into
the second, listed keys that this one lets through go into the third, and so on until none is left.
A key is then listed if the first level that refuses it is an even one, or if none refuses it and
their number is odd. That is exact for all keys of the universe, without a join, and only for them:
for others it errs as a Bloom filter does.

The first level's error rate is the share of listed keys in the universe, so that its mistakes are
about as many as the listed keys; the others err in half the cases. The filters grow with the listed
keys times the logarithm of the universe, are checked against ``MOST_BITS`` and broadcast. Their bits
are set in tasks and combined by an aggregate; keys never reach the driver.

Null keys are in no list. Repeated keys count once. An empty list gives a cascade that lists nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.scratch import stored
from tidemark.llm.words import mix

MOST_BITS = 1 << 30
MOST_LEVELS = 64


class Level(NamedTuple):
    bits: np.ndarray
    n_bits: int
    n_hashes: int


class Cascade(NamedTuple):
    levels: list[Level]


def key_hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a text key."""
    return F.xxhash64(key), F.xxhash64(F.lit("cascade"), key)


def positions(a: np.ndarray, b: np.ndarray, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    """The bits of each key on a level, a column for each hash."""
    seed = np.uint64(level + 1)
    a, b = mix(a.view(np.uint64) + seed), mix(b.view(np.uint64) ^ seed) | np.uint64(1)
    steps = np.arange(n_hashes, dtype=np.uint64)
    return ((a[:, None] + b[:, None] * steps[None, :]) % np.uint64(n_bits)).astype(np.int64)


def _in_level(level: Level, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = positions(a, b, number, level.n_bits, level.n_hashes)
    return (level.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(1)


def listed(cascade: Cascade, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys, given by their two hashes, are listed."""
    out = np.full(len(a), len(cascade.levels) % 2 == 1)
    left = np.arange(len(a))
    for number, level in enumerate(cascade.levels):
        passed = _in_level(level, number, a[left], b[left])
        out[left[~passed]] = number % 2 == 1
        left = left[passed]
    return out


def _passing(shared, number: int) -> Callable:
    def run(batches):
        level = shared.value
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            yield batch.filter(pa.array(_in_level(level, number, a.to_numpy(), b.to_numpy())))

    return run


def _bits(n_keys: int, error: float) -> int:
    return max(64, int(np.ceil(-n_keys * np.log(error) / np.log(2) ** 2)))


def _filter(keys: DataFrame, number: int, n_keys: int, error: float) -> Level:
    n_bits = _bits(n_keys, error)
    n_hashes = max(1, round(-np.log2(error)))

    def set_bits(batches):
        bits = np.zeros(-(-n_bits // 64), np.uint64)
        for batch in batches:
            at = positions(batch.column("a").to_numpy(), batch.column("b").to_numpy(),
                           number, n_bits, n_hashes).ravel()
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

    found = keys.select("a", "b").mapInArrow(set_bits, "word long, bits long")
    found = found.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(-(-n_bits // 64), np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Level(bits, n_bits, n_hashes)


def shard_of(a: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(a.view(np.uint64)) % np.uint64(n_shards)).astype(np.int64)


def _hashed(keys: DataFrame) -> DataFrame:
    a, b = key_hashes(F.col("key"))
    return keys.where("key IS NOT NULL").select(a.alias("a"), b.alias("b"))


def _in_shard(n_shards: int, shard: int) -> Callable:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shard_of(batch.column("a").to_numpy(), n_shards) == shard))

    return run


class Plan(NamedTuple):
    """The hashes of a list and its universe, and into how many shards its filters are cut."""

    inside: DataFrame
    outside: DataFrame
    n_inside: int
    error: float
    n_shards: int


def plan(listed_keys: DataFrame, universe: DataFrame) -> Plan:
    """From two tables with a text column ``key``; listed keys belong to the universe anyway."""
    inside = stored(_hashed(listed_keys).distinct(), "listed")
    n_inside, outside = inside.count(), _hashed(universe)
    # repeated keys make the estimate too large, which only makes the first level stricter
    error = min(0.5, n_inside / max(outside.count(), 1)) if n_inside else 0.5
    n_shards = -(-_bits(n_inside, error) // MOST_BITS)
    if n_shards > 1:  # every shard reads it
        outside = stored(outside, "universe")
    return Plan(inside, outside, n_inside, error, n_shards)


def build(spark: SparkSession, plan: Plan, shard: int = 0) -> Cascade:
    """The cascade of one shard."""
    inside, n_inside, outside = plan.inside, plan.n_inside, plan.outside
    if plan.n_shards > 1:
        own = _in_shard(plan.n_shards, shard)
        inside, outside = (k.mapInArrow(own, "a long, b long") for k in (inside, outside))
        n_inside = inside.count()
    levels: list[Level] = []
    encoded, n_encoded, other = inside, n_inside, outside
    while n_encoded:
        number = len(levels)
        if number == MOST_LEVELS:
            raise RuntimeError("keys with equal hashes are listed and not listed")
        levels.append(_filter(encoded, number, n_encoded, plan.error if number == 0 else 0.5))
        shared = spark.sparkContext.broadcast(levels[-1])
        mistaken = other.mapInArrow(_passing(shared, number), "a long, b long")
        if number == 0:
            mistaken = mistaken.distinct().join(inside, ["a", "b"], "left_anti")
        mistaken = stored(mistaken, "mistaken")
        encoded, n_encoded, other = mistaken, mistaken.count(), encoded
    return Cascade(levels)
