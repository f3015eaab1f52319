"""Rules for hosts and paths of urls, looked up in Bloom filter cascades.

A rule is a host, which stands for its subdomains too, followed by the beginning of a path. Each url
has a few candidate keys: every suffix of its host at a dot, with the beginnings of its path that are
as long as a rule's. One cascade, built over the candidate keys of all the urls, knows which keys are
rules; a second one, over the rules, knows which of them block. So urls need no join with the rules,
and the answers are exact for the urls the cascade was built from. Of several rules the longest wins,
of equally long ones the one that sorts first; urls without a rule are allowed, as they are in no
list.

A null url, or one without ``://``, has an empty host and path. Repeated urls are judged alike. Other
columns travel in a struct, whatever their names. Without rules everything is allowed. Rules whose
filters would be larger than may be broadcast are dealt to shards: the urls pass the shards' cascades
in turn, and each answers for its own keys. Only the distinct lengths of the rules' paths go to the
driver; ``k`` lengths take at least ``k * k / 2`` characters of rules, so a gigabyte of them has at
most 45,000.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import bloom
from tidemark.llm.scratch import others, stored

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), CAPITALS, SMALL)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: str, path: str, lengths: list[int]) -> Column:
    """Keys that a rule for the url could have, longest first."""
    fitting = F.filter(F.lit(np.array(lengths, np.int32)), lambda n: n <= F.char_length(path))
    beginnings = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(beginnings, lambda b: F.concat(s, b))))
    return F.array_sort(
        F.array_distinct(keys),
        lambda x, y: F.when(F.char_length(x) != F.char_length(y), F.char_length(y) - F.char_length(x))
        .when(x < y, -1).when(x > y, 1).otherwise(0),
    )


def _ask(shared, number: int, n_shards: int):
    """Adds what one shard of the rules knows of its keys: 0 nothing, 1 a rule, 2 a rule that blocks."""

    def run(batches):
        rules, blocked = shared.value
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy() for c in ("a", "b"))
            known = batch.column("known")
            marks = known.flatten().to_numpy().copy()
            own = np.flatnonzero(bloom.shard_of(a, n_shards) == number)
            own = own[bloom.listed(rules, a[own], b[own])]
            marks[own] = 1 + bloom.listed(blocked, a[own], b[own])
            ends = np.concatenate([[0], np.cumsum(known.value_lengths().to_numpy())])
            marked = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(marks, pa.int8()))
            at = batch.schema.get_field_index("known")
            yield batch.set_column(at, "known", marked)

    return run


def judge(urls: DataFrame, rules: DataFrame, url_column: str = "url") -> DataFrame:
    """Per row: ``row`` (struct of all columns), ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` (text) and ``action`` (allow or block); of one rule with both
    actions block counts.
    """
    spark = urls.sparkSession
    rules = rules.select(
        F.concat("host", "path").alias("key"), F.char_length("path").alias("length"), "action"
    ).dropna()
    lengths = sorted(r[0] for r in rules.select("length").distinct().collect())
    host, path = host_and_path(F.col(url_column).cast("string"))
    rows = urls.select(F.struct(*others(urls)).alias("row"), host.alias("host"), path.alias("path"))
    keys = candidate_keys("host", "path", lengths) if lengths else F.expr("CAST(array() AS array<string>)")
    rows = rows.withColumn("keys", keys)
    universe = rows.select(F.explode("keys").alias("key"))
    listed = bloom.plan(rules.select("key"), universe)
    # the blocked ones are as many at most, in a smaller universe: they fit the same shards
    blocked = bloom.plan(rules.where("action = 'block'").select("key"), rules.select("key"))
    blocked = blocked._replace(n_shards=listed.n_shards)
    rows = rows.withColumns({
        "a": F.transform("keys", lambda k: bloom.key_hashes(k)[0]),
        "b": F.transform("keys", lambda k: bloom.key_hashes(k)[1]),
        "known": F.transform("keys", lambda k: F.lit(0).cast("byte")),
    })
    for number in range(listed.n_shards):
        shared = spark.sparkContext.broadcast(
            (bloom.build(spark, listed, number), bloom.build(spark, blocked, number)))
        rows = rows.mapInArrow(_ask(shared, number, listed.n_shards), rows.schema)
        if number < listed.n_shards - 1:  # the next cascade is built and sent when this one is done
            rows = stored(rows, "asked")
            shared.unpersist()
    place = F.array_position(F.transform("known", lambda k: k > 0), True).cast("int")
    found = F.when(place > 0, place)
    return rows.select(
        "row", "host", "path", F.get("keys", found - 1).alias("rule"),
        F.when(F.get("known", found - 1) == 2, "block").otherwise("allow").alias("verdict"),
    )
