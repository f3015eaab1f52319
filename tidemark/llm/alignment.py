"""Alignment of two tokenizers over a corpus, with the number of documents behind each pair of ids.

Each text is encoded by a byte-level BPE (A, of a space and the text) and a sentence-piece model (B,
which adds the space itself). Byte offsets at which tokens of both end cut a text into groups; an id
of A is linked with an id of B wherever they meet in a group.

An array gives for each id of A the id of B with the same bytes. Such pairs, nearly all groups of one
token each, are counted in vectors as long as A's vocabulary. Only the other pairs are shuffled, once
for each block of documents (about ``most`` bytes of text): first to be counted, then to carry the
counts back to their block. So a pair that every document holds is a row for each block, not for each
document, and a block's answers are no more than its own pairs.

Rows: null and empty texts have no tokens; nor have texts whose tokens, joined, are not the space and
the text. Every row counts as a document of its own, also when rows are repeated; null ids do not
matter. Other columns travel in a struct, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.bpe import MOST_BYTES, byte_letters
from tidemark.llm.scratch import others, stored

# Fixed: the pattern that byte-level vocabularies of this kind cut texts by, for the encoder of A.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST = 1 << 20


def _content(spark: SparkSession, path: str) -> bytes:
    if "://" in path:
        body = spark.read.format("binaryFile").load(path).select("content").first()[0]
    else:
        with open(path, "rb") as file:
            body = file.read(MOST_BYTES + 1)
    if len(body) > MOST_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return bytes(body)


def load(spark: SparkSession, path_a: str, path_b: str) -> tuple[bytes, bytes]:
    """The files of both tokenizers (A: JSON, B: a sentence-piece model), small enough to broadcast."""
    return _content(spark, path_a), _content(spark, path_b)


class Pair:
    """Both encoders, the bytes of their ids, and the ids of B that have the bytes of an id of A."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        vocab = json.loads(file_a)["model"]["vocab"]
        added = {x["content"] for x in json.loads(file_a).get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): number
                 for token, number in vocab.items() if token not in added}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        self.bytes_a = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, number in ranks.items():
            self.bytes_a[number] = token
        self.bytes_b, first = [], {}
        for number in range(self.b.get_piece_size()):
            piece, one = self.b.id_to_piece(number), self.b.is_byte(number)
            token = bytes([int(piece[3:5], 16)]) if one else piece.replace("▁", " ").encode()
            self.bytes_b.append(token)
            # a piece of one byte may stand beside the same byte as fallback: the piece goes first
            if not self.b.is_control(number) and not self.b.is_unknown(number):
                first[token] = first.get(token, number) if one else number
        self.wide_a, self.wide_b = len(self.bytes_a), len(self.bytes_b)
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.same = np.array([first.get(t, -1) for t in self.bytes_a], np.int64)
        ends = (",", "|", ",", ";")
        wide = (self.wide_a, self.wide_a, self.wide_b, self.wide_b)
        self.shown = [f"{i}{end}" for end, n in zip(ends, wide) for i in range(n)]

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none where the joined bytes are not a space and the text."""
        given = [text for text in texts if text]
        found_a = iter(self.a.encode_ordinary_batch([" " + t for t in given], num_threads=1))
        found_b = iter(self.b.encode(given, num_threads=1) if given else [])
        ids_a, ids_b = [], []
        for text in texts:
            a, b = (next(found_a), next(found_b)) if text else ([], [])
            whole = b" " + text.encode() if text else b""
            good = (b"".join(map(self.bytes_a.__getitem__, a)) == whole
                    and b"".join(map(self.bytes_b.__getitem__, b)) == whole)
            ids_a.append(a if good else [])
            ids_b.append(b if good else [])
        return ids_a, ids_b


_LAST: list = []


def _pair(shared) -> Pair:
    """One for each worker process."""
    if not _LAST or _LAST[0] is not shared.value:
        _LAST[:] = [shared.value, Pair(*shared.value)]
    return _LAST[1]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the number of the text of each."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(ids)), sizes)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Values ascending by owner, as one list for each of n owners."""
    bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def align_texts(pair: Pair, texts: list[str | None]) -> dict[str, np.ndarray | pa.Array | list]:
    """Groups and links of some texts; links as distinct pairs of ids with how often each occurs."""
    n = len(texts)
    lists_a, lists_b = pair.encode(texts)
    (ids_a, doc_a), (ids_b, doc_b) = _flat(lists_a), _flat(lists_b)
    ends_a, ends_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    both = np.zeros(int(ends_a[-1]) + 1 if n and len(ends_a) else 1, np.int8)
    both[ends_a] += 1
    both[ends_b] += 1
    cut = np.cumsum(both == 2)
    group_a, group_b = cut[ends_a - 1], cut[ends_b - 1]
    groups = int(cut[-1])
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    doc = doc_a[before_a] if groups else np.empty(0, np.int64)

    # the written form: tokens of A, then of B, for each group
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + (before_a + in_a)[group_b]
    last_a = np.zeros(len(ids_a), np.int64)
    last_b = np.zeros(len(ids_b), np.int64)
    last_a[before_a + in_a - 1], last_b[before_b + in_b - 1] = 1, 1
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[place_a] = ids_a + last_a * pair.wide_a
    codes[place_b] = ids_b + 2 * pair.wide_a + last_b * pair.wide_b
    sizes = np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n)
    ends = np.cumsum(sizes).tolist()
    shown = pair.shown.__getitem__
    written = ["".join(map(shown, codes[end - size : end].tolist()))[:-1]
               for end, size in zip(ends, sizes.tolist())]

    # groups of one token each with the same bytes, and all others
    first_a = ids_a[before_a] if groups else doc
    first_b = ids_b[before_b] if groups else doc
    fast = (in_a == 1) & (in_b == 1) & (pair.same[first_a] == first_b)
    slow_a, slow_b = ~fast[group_a], ~fast[group_b]
    key_a, times_a = _sums(group_a[slow_a] * pair.wide_a + ids_a[slow_a], np.ones(int(slow_a.sum()), np.int64))
    key_b, times_b = _sums(group_b[slow_b] * pair.wide_b + ids_b[slow_b], np.ones(int(slow_b.sum()), np.int64))
    at_a, at_b = key_a // pair.wide_a, key_b // pair.wide_b
    kinds_b = np.bincount(at_b, minlength=groups)
    start_b = np.cumsum(kinds_b) - kinds_b
    repeat = kinds_b[at_a]
    left = np.repeat(np.arange(len(key_a)), repeat)
    right = np.arange(len(left)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + start_b[at_a][left]
    a, b = key_a[left] % pair.wide_a, key_b[right] % pair.wide_b
    times, owner = times_a[left] * times_b[right], doc[at_a[left]] if groups else left
    alike = pair.same[a] == b
    same, same_times = _sums(
        np.concatenate([doc[fast] * pair.wide_a + first_a[fast], (owner * pair.wide_a + a)[alike]]),
        np.concatenate([np.ones(int(fast.sum()), np.int64), times[alike]]))
    other, other_times = _sums(
        ((owner * pair.wide_a + a) * pair.wide_b + b)[~alike], times[~alike])
    links = np.zeros(n, np.int64)
    np.add.at(links, doc, in_a * in_b)
    return {
        "n_a": np.bincount(doc_a, minlength=n), "n_b": np.bincount(doc_b, minlength=n),
        "n_groups": np.bincount(doc, minlength=n), "n_links": links, "groups": written,
        "same_doc": same // pair.wide_a, "same": same % pair.wide_a, "same_times": same_times,
        "pair_doc": other // (pair.wide_a * pair.wide_b),
        "pair": other % (pair.wide_a * pair.wide_b), "pair_times": other_times,
    }


_ALIGNED = [
    ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()),
    ("groups", T.StringType()), ("block", T.LongType()),
    ("same", T.ArrayType(T.IntegerType())), ("same_times", T.ArrayType(T.LongType())),
    ("pairs", T.ArrayType(T.IntegerType())), ("pair_times", T.ArrayType(T.LongType())),
    ("block_pairs", T.ArrayType(T.LongType())), ("block_docs", T.ArrayType(T.LongType())),
]


def _align(shared, most: int):
    def run(batches):
        pair, block = _pair(shared), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in words.pieces(batch, most=most):
                rows = piece.rows
                n = rows.num_rows
                found = align_texts(pair, rows.column("text").to_pylist())
                known, at, docs = np.unique(found["pair"], return_inverse=True, return_counts=True)
                per_row = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                none = np.zeros(len(known), np.int64)  # the block's pairs stand in its first row
                columns = [
                    rows.column("row"), *per_row, pa.array(found["groups"], pa.string()),
                    pa.array(np.full(n, block)),
                    _lists(found["same"], found["same_doc"], n, pa.int32()),
                    _lists(found["same_times"], found["same_doc"], n, pa.int64()),
                    _lists(at, found["pair_doc"], n, pa.int32()),
                    _lists(found["pair_times"], found["pair_doc"], n, pa.int64()),
                    _lists(known, none, n, pa.int64()), _lists(docs, none, n, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *(c for c, _ in _ALIGNED)])
                block += 1

    return run


def align(
    docs: DataFrame, files: tuple[bytes, bytes], text_column: str = "text", most: int = MOST
) -> DataFrame:
    """Per row: ``row`` (struct of all columns but the text), ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``groups`` (ids of A and B in each group, ``a1,a2|b1;a3|b2,b3``), and links: ids of A
    linked with the id of the same bytes, and numbers of other pairs in their block's list."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(
        F.struct(*others(docs, text_column)).alias("row"),
        F.col(text_column).cast("string").alias("text"))
    out = T.StructType([rows.schema["row"], *(T.StructField(c, t) for c, t in _ALIGNED)])
    return rows.mapInArrow(_align(shared, most), out)


def _vectors(wide: int):
    """The number of documents for each id of a task's rows, in one vector."""
    def run(batches):
        total = np.zeros(wide, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("same").flatten().to_numpy(), minlength=wide)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["a", "n"])

    return run


def _lookup(shared):
    """Sums over the links of each of a block's documents, from the counts of the block's pairs."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        same_counts, best, wide_b = shared.value
        pairs = counts.column("pair").to_numpy()
        order = np.argsort(pairs)
        a, n = pairs[order] // wide_b, counts.column("n").to_numpy()[order]
        count_sum, n_best = (np.zeros(docs.num_rows, np.int64) for _ in range(2))
        for ids, times, values, is_best in (
            ("same", "same_times", same_counts, same_counts == best), ("pairs", "pair_times", n, n == best[a])):
            lists = docs.column(ids).combine_chunks()
            which = lists.flatten().to_numpy()
            often = docs.column(times).combine_chunks().flatten().to_numpy()
            owner = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy())
            np.add.at(count_sum, owner, often * values[which])
            np.add.at(n_best, owner, often * is_best[which])
        kept = [c for c in docs.column_names if c not in _INNER]
        return docs.select(kept).append_column("n_best", pa.array(n_best)) \
            .append_column("count_sum", pa.array(count_sum))

    return run


_INNER = ("block", "same", "same_times", "pairs", "pair_times")


def count_links(aligned: DataFrame, files: tuple[bytes, bytes]) -> tuple[DataFrame, DataFrame]:
    """Of aligned documents, with columns besides the links as the caller wants them: the documents
    with ``n_best`` and ``count_sum``, and all pairs (``a``, ``b``, ``n`` documents)."""
    spark = aligned.sparkSession
    pair = Pair(*files)
    wide_a, wide_b = pair.wide_a, pair.wide_b
    kept = stored(aligned, "aligned")
    # bounded by the vocabulary of A
    same_counts = np.zeros(wide_a, np.int64)
    vectors = kept.select("same").mapInArrow(_vectors(wide_a), "a long, n long")
    for a, n in vectors.groupBy("a").agg(F.sum("n").alias("n")).collect():
        same_counts[a] = n
    asked = kept.where(F.size("block_pairs") > 0).select(
        "block", F.inline(F.arrays_zip(F.col("block_pairs").alias("pair"), F.col("block_docs").alias("n"))))
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    best = same_counts.copy()
    for a, n in counts.groupBy(F.expr(f"pair div {wide_b}").alias("a")).agg(F.max("n").alias("n")).collect():
        best[a] = max(best[a], n)
    shared = spark.sparkContext.broadcast((same_counts, best, wide_b))
    answers = (asked.select(F.col("block").alias("of"), "pair").join(counts, "pair")
               .select("of", "pair", "n"))
    docs = kept.drop("block_pairs", "block_docs")
    out = T.StructType([f for f in docs.schema if f.name not in _INNER])
    out.add("n_best", T.LongType()).add("count_sum", T.LongType())
    found = docs.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_lookup(shared), out)
    exact = spark.createDataFrame(
        pa.table({"a": np.arange(wide_a), "b": pair.same, "n": same_counts})).where("n > 0 AND b >= 0")
    irregular = counts.select(
        F.expr(f"pair div {wide_b}").alias("a"), F.pmod("pair", F.lit(wide_b)).alias("b"), "n")
    return found, exact.unionByName(irregular)
