"""Merkle manifest of a table: a digest for each row, a root for each group of rows and for all, and
each row's proof.

Rows are leaves. Those of a group stand in the order of their ids; every eight neighbours become the
digest of their digests, level by level, until one is left: the group's subroot. The subroots, in the
order of their groups, become the root in the same way.

Ranks come from one range sort. The octal digits of a rank then are grouping columns, taken away one
after the other within blocks of 512 ranks: each step nests the nodes of a run into the struct of
their parent. A block is one row of bounded size, and blocks are the leaves of the next tier. On the
way down the digests beside each node come out of the nested structs by ``transform`` and ``explode``;
what stands above a block is grouped with it by the block's number. No row meets its proof by a join.

Rows: groups and ids may be null and come first; rows of one id stand in the order of their leaves,
equal rows each have a place of their own. Null columns count as ``-``. An empty table has no proofs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.scratch import stored

WIDE, DIGITS = 8, 3
BITS = WIDE.bit_length() - 1
BLOCK = WIDE**DIGITS


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*columns: Column) -> Column:
    """A row's digest: each value with its length in bytes before it, or ``-`` for null."""
    texts = [column.cast("string") for column in columns]
    return digest(F.concat(*(
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    )))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node["digest"]), "")


def _level_sizes() -> list[Column]:
    """How many nodes the group has on each level of a block, from its number of leaves ``n``."""
    return [F.ceil(F.col("n") / F.lit(WIDE**level)) for level in range(DIGITS)]


def ranked(leaves: DataFrame) -> DataFrame:
    """Leaves (``grp``, ``id``, ``digest``, ``item``) with ``rank`` in their group and its size ``n``.

    One range sort, written with places that rise within each part; then a row for each part of a
    group says how many leaves come before. A group of any size spreads over many parts.
    """
    order = ("grp", "id", "digest")
    placed = stored(
        leaves.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33)),
        "manifest-places",
    )
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("grp", "part").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")
    ).select(
        F.col("grp").alias("of"), F.col("part").alias("of_part"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("grp")).alias("n"),
    )
    same = F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    return placed.join(parts, same).select(
        "grp", (F.col("place") + F.col("shift")).alias("rank"), "n", "digest", "item"
    )


def _rolled(nodes: DataFrame) -> DataFrame:
    """One row per block of nodes: its ``digest`` and its nodes, nested by the digits of their ranks."""
    digits = [f"d{level}" for level in range(DIGITS)]
    rows = nodes.select(
        "grp", "n", F.shiftright("rank", BITS * DIGITS).alias("block"), "digest", "item",
        *(F.shiftright("rank", BITS * level).bitwiseAND(WIDE - 1).cast("int").alias(name)
          for level, name in enumerate(digits)),
    ).repartition("grp", "block")
    inside = ["digest", "item"]
    for level, size in enumerate(_level_sizes()):
        rows = rows.groupBy("grp", "n", "block", *digits[level + 1 :]).agg(
            F.array_sort(F.collect_list(F.struct(F.col(digits[level]).alias("digit"), *inside)))
            .alias("nodes")
        )
        # a level of one node is the end: it goes up as it is
        rows = rows.withColumn(
            "digest", F.when(size > 1, digest(_joined(F.col("nodes"))))
            .otherwise(F.col("nodes")[0]["digest"]))
        inside = ["digest", "nodes"]
    return rows


def _beside(nodes: Column, at: Column) -> Column:
    """The digests of a run before and behind one of its nodes."""
    return F.struct(
        _joined(F.slice(nodes, F.lit(1), at)).alias("left"),
        _joined(F.slice(nodes, at + 2, F.lit(WIDE))).alias("right"),
    )


def _unrolled(blocks: DataFrame) -> DataFrame:
    """The nodes of blocks whose ``above`` (steps from block to root, subroot, root) is known: their
    ``rank``, ``item``, ``digest`` and own ``above``."""
    sizes = _level_sizes()

    def proofs(nodes: Column, level: int, rank: Column, steps: list[Column]) -> Column:
        def visit(node, at):
            own = [F.when(sizes[level] > 1, _beside(nodes, at)), *steps]
            place = rank * WIDE + node["digit"]
            if level:
                return proofs(node["nodes"], level - 1, place, own)
            known = F.array_compact(F.array(*own))
            return F.array(F.struct(
                place.alias("rank"), node["digest"].alias("digest"), node["item"].alias("item"),
                known.alias("steps")))

        return F.flatten(F.transform(nodes, visit))

    every = proofs(F.col("nodes"), DIGITS - 1, F.col("block"), [])
    return blocks.select("grp", "above", F.explode(every).alias("node")).select(
        "grp", F.col("node.rank").alias("rank"), F.col("node.digest").alias("digest"),
        F.col("node.item").alias("item"),
        F.struct(
            F.concat("node.steps", "above.steps").alias("steps"),
            F.col("above.subroot").alias("subroot"), F.col("above.root").alias("root"),
        ).alias("above"),
    )


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of blocks over ranked nodes, up to one block for each group."""
    tiers, most = [], nodes.agg(F.max("n")).first()[0] or 1
    while True:
        tiers.append(stored(_rolled(nodes), "manifest-blocks"))
        most = -(-most // BLOCK)
        if most == 1:
            return tiers
        nodes = tiers[-1].select(
            "grp", F.col("block").alias("rank"),
            F.ceil(F.col("n") / F.lit(BLOCK)).alias("n"), "digest", F.lit(None).cast("int").alias("item"),
        )


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's nodes, with all that stands above them. ``above``: a row for each group."""
    found = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        both = blocks.select("grp", "block", "n", "nodes").unionByName(
            found.select("grp", "block", "above"), allowMissingColumns=True)
        # one row of either kind for each block
        found = _unrolled(both.groupBy("grp", "block").agg(
            *(F.first(c, ignorenulls=True).alias(c) for c in ("n", "nodes", "above"))))
        rows = found
        found = found.select("grp", F.col("rank").alias("block"), "above")
    return rows


def build(leaves: DataFrame) -> DataFrame:
    """Per leaf of ``grp``, ``id``, ``leaf`` and any other columns: those columns, ``rank`` in its
    group, ``steps`` (per level the joined digests to the left and right of it), ``subroot``, ``root``.
    Group, id and other columns need types that can be ordered."""
    more = [c for c in leaves.columns if c not in ("grp", "id", "leaf")]
    quoted = ["`" + c.replace("`", "``") + "`" for c in more]
    # digests are made once, not again by the sort's sample
    narrow = stored(leaves.select(
        "grp", "id", F.col("leaf").alias("digest"), F.struct("id", *quoted).alias("item")
    ), "manifest-leaves")
    tiers = _climb(ranked(narrow))
    tops = tiers[-1].select(F.col("grp").alias("id"), "digest")
    # the subroots are the leaves of a second tree with one group
    upper = _climb(ranked(tops.select(
        F.lit(0).alias("grp"), "id", "digest", F.struct("id", "digest").alias("item"))))
    end = upper[-1].select(
        "grp", F.struct(
            F.array().cast("array<struct<left:string,right:string>>").alias("steps"),
            F.lit("").alias("subroot"), F.col("digest").alias("root"),
        ).alias("above"))
    above = _descend(upper, end).select(
        F.col("item.id").alias("grp"),
        F.struct("above.steps", F.col("item.digest").alias("subroot"), "above.root").alias("above"))
    return _descend(tiers, above).select(
        "grp", "item.id", F.col("digest").alias("leaf"),
        *(F.col("item").getField(c).alias(c) for c in more),
        "rank", "above.steps", "above.subroot", "above.root",
    )


def proof(steps: str = "steps") -> Column:
    """The digest of all digests beside a leaf, upwards, each level from left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf_digest: Column, steps: str = "steps") -> Column:
    """The root that a leaf has with the digests beside it."""
    return F.aggregate(
        steps, leaf_digest, lambda own, s: digest(F.concat(s["left"], own, s["right"])))
