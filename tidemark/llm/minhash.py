"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

Two permutations make the whole signature: the first sends a shingle into a circle of 2^32 places,
the second ranks the places; coordinate k is the least rank after a shift by k. Both are bijections
of 32 bits (the first after hashing the shingle). 24 bands of 3 coordinates miss a pair of
similarity 0.75 with probability 2e-6.

Documents with equal shingle sets are one node from the start, so exact copies are never compared.
Buckets are not expanded into pairs. Every member is compared with two centres, the smallest document
and the one with the smallest hash; verified links make components. Only where a bucket still holds
several components, the documents outside its largest one are compared with all others of the bucket,
in blocks of bounded size: a task takes one block of such documents and one of members, and gives back
the links alone. So thousands of near copies take two comparisons each, and no comparison that could
join two components is left out.

Rows: null or empty texts, and texts without words, have no shingles and no links. Fewer words than
a shingle's are one shingle. Rows without id are left out of groups and kept. Rows that share an id
count as one document with the text of one of them: one with words if there is any, of these the one
with the largest hash, so partitioning plays no part. Columns besides id and text do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.components import components
from tidemark.llm.scratch import stored

SHINGLE = 5
BANDS, ROWS = 24, 3
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20


def shingle_sets(piece: words.Piece, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    data = words.LOWER[piece.data]
    spots = words.split(data, piece.bounds, words.NOT_SPACE)
    hashes = words.word_hashes(data, spots.starts, spots.ends)
    if not len(hashes):
        return [hashes] * (len(piece.bounds) - 1)
    runs = {n: words.rolled(hashes, n) for n in range(1, k + 1)}
    out = []
    for start, end in zip(spots.first[:-1].tolist(), spots.first[1:].tolist()):
        n = end - start
        out.append(np.unique(runs[k][start : end - k + 1]) if n >= k
                   else runs[n][start : start + 1] if n else hashes[:0])
    return out


def _rank(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32 bits."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: a row of ``size`` coordinates for each of the sets, none of them empty."""
    first = np.cumsum([0] + [len(s) for s in sets])
    places = (words.mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_rank(places + np.uint32(k)), first[:-1])
    return out


def _profiles(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch):
                sets = shingle_sets(piece, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), bands), np.uint64)
                prints = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    some = [sets[i] for i in full]
                    coordinates = signatures(some, bands * rows).astype(np.uint64)
                    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :]
                    for j in range(rows):
                        key = words.mix(key * np.uint64(words.BASE) + coordinates[:, j::rows])
                    keys[full] = key
                    every, first = np.concatenate(some), np.cumsum([0] + [len(s) for s in some])
                    for j in range(2):
                        every = words.mix(every + np.uint64(j + 1))
                        prints[full, j] = np.add.reduceat(every, first[:-1])
                yield pa.RecordBatch.from_arrays([
                    piece.rows.column("doc"),
                    piece.rows.column("mark"),
                    pa.array(sizes),
                    *(pa.array(np.ascontiguousarray(prints[:, j]).view(np.int64)) for j in (0, 1)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(sets) + 1) * bands, pa.int32()),
                        pa.array(keys.ravel().view(np.int64))),
                ], names=["doc", "mark", "n_shingles", "print_a", "print_b", "bands"])

    return run


def _verify(k: int, percent: int):
    """Rows (a, text_a, b, text_b) in runs of equal a: the pairs that are similar enough."""

    def sets_of(column):
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        return (s for piece in words.pieces(batch) for s in shingle_sets(piece, k))

    def run(batches):
        last, left = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i, right in enumerate(sets_of(batch.column("text_b"))):
                if a[i] != last:
                    last = a[i]
                    left = next(sets_of(batch.column("text_a").slice(i, 1)))
                if not 100 * min(len(left), len(right)) >= percent * max(len(left), len(right), 1):
                    continue
                both = np.searchsorted(left, right)
                both[both == len(left)] = 0
                shared = int((left[both] == right).sum())
                if shared and 100 * shared >= percent * (len(left) + len(right) - shared):
                    good.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in good], pa.int64()), pa.array([x[1] for x in good], pa.int64())],
                names=["a", "b"],
            )

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The verified ones of the pairs (a, b). A centre's pairs are dealt out evenly."""
    with_b = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(
        _verify(k, percent), "a long, b long"
    )


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, doc, component, main) of the buckets that hold several components; ``main`` is
    the bucket's largest one."""
    found = components(links)
    labelled = stored(
        members.join(found.withColumnRenamed("node", "doc"), "doc", "left").select(
            "key", "doc", F.coalesce("component", "doc").alias("component")), "labelled")
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("main")
    ).where("kinds > 1").drop("kinds")
    return labelled.join(mixed, "key")


def _compare_blocks(k: int, percent: int):
    """Of one block of outsiders and one of members: the links between components."""

    def run(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()[0]
        docs, of = batch.column("doc").to_numpy(), batch.column("component").to_numpy()
        outside = batch.column("outside").to_numpy(zero_copy_only=False)
        sets = [s for piece in words.pieces(batch) for s in shingle_sets(piece, k)]
        sizes = np.array([len(s) for s in sets])
        known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes)])
        member = np.flatnonzero(~outside)
        flat = np.concatenate([numbers[first[m] : first[m + 1]] for m in member] or [numbers[:0]])
        starts = np.concatenate([[0], np.cumsum(sizes[member])])[:-1].astype(np.int64)
        a, b, mark = [], [], np.zeros(len(known), bool)
        for u in np.flatnonzero(outside) if len(member) else ():
            mark[numbers[first[u] : first[u + 1]]] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[numbers[first[u] : first[u + 1]]] = False
            close = 100 * shared >= percent * (sizes[u] + sizes[member] - shared)
            for v in member[close & (of[member] != of[u])]:
                a.append(min(docs[u], docs[v]))
                b.append(max(docs[u], docs[v]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links_apart(apart: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between documents of a bucket that are still in different components."""
    rows = stored(apart.join(texts, "doc").withColumn("outsider", F.expr("component != main")), "apart")
    size = F.octet_length("text")

    def blocks(which):
        n, total = F.count(F.when(which, 1)), F.coalesce(F.sum(F.when(which, size)), F.lit(0))
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(total / BLOCK_BYTES), F.lit(1))

    counts = rows.groupBy("key").agg(
        blocks(F.col("outsider")).cast("int").alias("n_out"), blocks(F.lit(True)).cast("int").alias("n_all"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(counts, "key").repartition(parts, "key", "doc").withColumn(
        "place", F.explode(F.expr("""concat(
            transform(sequence(0, n_out - 1),
                      i -> struct(i AS i, pmod(hash(doc), n_all) AS j, false AS outside)),
            if(outsider, transform(sequence(0, n_all - 1),
                      j -> struct(pmod(hash(doc), n_out) AS i, j AS j, true AS outside)), array()))""")))
    return dealt.select("key", "place.*", "doc", "component", "text").groupBy("key", "i", "j").applyInArrow(
        _compare_blocks(k, percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = SHINGLE, percent: int = 75,
) -> DataFrame:
    """Per distinct id: ``doc``, ``n_shingles``, ``component`` (its smallest id), ``kept``.

    Documents are linked if ``100 * common >= percent * all`` of their distinct shingles.
    """
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    profiles = texts.mapInArrow(
        _profiles(shingle, BANDS, ROWS),
        "doc long, mark long, n_shingles long, print_a long, print_b long, bands array<long>",
    )
    same = ["n_shingles", "print_a", "print_b"]
    # one text per id, the same for bands and comparisons
    first = F.when(F.col("doc").isNull(), F.col("n_shingles")).otherwise((F.col("n_shingles") > 0).cast("long"))
    profiles = stored(
        profiles.groupBy("doc").agg(
            F.max_by(F.struct("mark", *same, "bands"), F.struct(first, F.col("mark"))).alias("one"))
        .select("doc", "one.*"),
        "profiles",
    )
    groups = stored(
        profiles.where("n_shingles > 0 AND doc IS NOT NULL")
        .groupBy(*same).agg(F.min("doc").alias("node"), F.min_by("mark", "doc").alias("mark"),
                            F.any_value("bands").alias("bands")),
        "groups",
    )
    keyed = groups.select(F.col("node").alias("doc"), F.explode("bands").alias("key"))
    centres = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"),
        F.min_by("doc", F.xxhash64("doc")).alias("other"),
    ).where("n > 1")
    members = stored(keyed.join(centres, "key").drop("n"), "members")
    wanted = groups.selectExpr("node AS doc", "mark").join(members.select("doc"), "doc", "left_semi")
    once = texts.where("doc IS NOT NULL").join(wanted, ["doc", "mark"]).drop("mark")
    once = stored(once.dropDuplicates(["doc"]), "candidates")

    pairs = members.select("doc", F.explode(F.array("least", "other")).alias("centre"))
    pairs = pairs.where("doc != centre").selectExpr("least(doc, centre) AS a", "greatest(doc, centre) AS b")
    links = stored(_links(pairs.distinct(), once, shingle, percent), "verified")
    apart = _apart(members.select("key", "doc"), links)
    links = links.union(stored(_links_apart(apart, once, shingle, percent), "verified"))

    found = components(links).selectExpr("node", "component")
    nodes = groups.join(found, "node", "left").select(
        *same, F.coalesce("component", "node").alias("component"))
    return (
        profiles.select("doc", *same).join(nodes, same, "left")
        .select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))
        .withColumn("kept", F.coalesce(F.col("component") == F.col("doc"), F.lit(True)))
    )
