"""Byte pair encoding and decoding with a given vocabulary.

Texts are cut into pieces by the vocabulary's pattern, and each piece is merged on its own: a
segment tree over the ranks of adjacent pairs has the leftmost pair of lowest rank at its root; a
merge changes three leaves, so a piece of n bytes takes O(n log n) whatever its length. Pieces of
usual length are remembered, a bounded number of them.

The vocabulary is read by the driver and broadcast (its size is checked); executors need no file.

Rows: null and empty texts have no ids and decode to an empty text; ids that the vocabulary lacks,
and null ids, decode to nothing. Nothing is joined, so repeated rows and null document ids do not
matter. Other columns travel in a struct, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import json
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.scratch import others

# Fixed: the pattern that byte-level vocabularies of this kind cut texts by.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
MOST_BYTES = 64 << 20
REMEMBERED, USUAL = 1 << 17, 62
SIDE_BY_SIDE = 4096
PLACES = 64
NEVER = 1 << 60
LONG_CHUNK = 200
# white space but for the space and the line feed, and signs that some count as white space
RARE_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B)))


def lone_spaces(text: str) -> bool:
    """Whether no space stands beside other white space."""
    return not (
        "  " in text or "\n " in text or " \n" in text or any(c in text for c in RARE_SPACE)
    )


class Vocabulary(NamedTuple):
    """Ids of the 256 bytes; ranked merges (left id, right id, new id); bytes of every id; ids of
    texts that are taken out before cutting."""

    byte_ids: list[int]
    merges: np.ndarray
    tokens: list[bytes]
    special: dict[str, int]


def byte_letters() -> dict[str, int]:
    """The visible letter that stands for each byte in vocabulary files of this kind."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(hidden)}


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """A byte-level BPE file in JSON: ``model.vocab``, ``model.merges``, ``added_tokens``."""
    if "://" in path:
        row = spark.read.text(path, wholetext=True).first()
        body = row[0]
    else:
        with open(path, encoding="utf-8") as file:
            body = file.read(MOST_BYTES + 1)
    if len(body) > MOST_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    data = json.loads(body)
    letters = byte_letters()
    vocab = data["model"]["vocab"]
    special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, number in vocab.items():
        tokens[number] = bytes(letters[c] for c in token)
    for token, number in special.items():
        tokens[number] = token.encode()
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else x for x in data["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
    byte_ids = [0] * 256
    for letter, byte in letters.items():
        byte_ids[byte] = vocab[letter]
    return Vocabulary(byte_ids, merges.reshape(-1, 3), tokens, special)


class Encoder:
    """Ids of texts under one vocabulary. Pieces of usual length are merged many at a time, their
    trees side by side in one array; longer ones singly. Both keep the same tree."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_ids = vocabulary.byte_ids
        self.wide = len(vocabulary.tokens)
        keys = vocabulary.merges[:, 0] * self.wide + vocabulary.merges[:, 1]
        self.ranks = {key: rank for rank, key in enumerate(keys.tolist())}
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.new_ids = vocabulary.merges[:, 2]
        self.merged = self.new_ids.tolist()
        self.cut = regex.compile(PATTERN).findall
        self.special = vocabulary.special
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(names) + ")").split if names else None
        self.numbers = list(range(self.wide))
        self.remembered = REMEMBERED
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        every = np.repeat(np.array(self.byte_ids), 256), np.tile(np.array(self.byte_ids), 256)
        self.byte_pairs = self._ranked(*every, 0).reshape(256, 256)

    def _learn(self, chunks: set[str]) -> None:
        """Make sure that all the chunks are known, the rarer ones of earlier calls may go."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, {}
        for chunk in chunks:
            if chunk not in known:
                if (ids := older.get(chunk)) is not None:
                    known[chunk] = ids
                else:
                    new[chunk] = self.cut(chunk)
        # tuples of numbers: the garbage collector need not look at them again and again
        merged: dict[str, tuple[int, ...]] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in set(chain.from_iterable(new.values())):
            data = piece.encode("utf-8", "surrogatepass")
            if len(data) == 1:
                merged[piece] = (self.byte_ids[data[0]],)
            elif len(data) > USUAL:
                merged[piece] = tuple(self.merge(piece))
            else:
                by_size.setdefault(1 << len(data).bit_length(), []).append((piece, data))
        for size, group in by_size.items():
            for at in range(0, len(group), SIDE_BY_SIDE):
                part = group[at : at + SIDE_BY_SIDE]
                found = self._merge_all([data for _, data in part], size)
                merged.update(zip((p for p, _ in part), found))
        for chunk, pieces in new.items():
            known[chunk] = (merged[pieces[0]] if len(pieces) == 1
                            else tuple(chain.from_iterable(map(merged.__getitem__, pieces))))

    def _ranked(self, left: np.ndarray, right: np.ndarray, place) -> np.ndarray:
        """Leaves for pairs: rank and place in one number, so that the least is the leftmost."""
        if not len(self.keys):
            return np.full(len(left), NEVER)
        keys = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        good = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(good, self.order[at] * PLACES + place, NEVER)

    def _merge_all(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Merge pieces of fewer than ``size`` bytes. Symbols stand at 1 to n, with -1 around."""
        n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((n, size + 1), -1, np.int64)
        inside = np.arange(size + 1)[None, :]
        inside = (inside >= 1) & (inside <= lengths[:, None])
        data = np.zeros((n, size + 1), np.uint8)
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids[inside] = np.array(self.byte_ids)[data[inside]]
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), NEVER, np.int64)
        row, place = np.nonzero(inside[:, :-1] & inside[:, 1:])
        first = self.byte_pairs[data[row, place], data[row, place + 1]]
        tree[row, size + place] = np.where(first == NEVER, NEVER, first + place)
        node = size
        while node > 1:
            node //= 2
            tree[:, node : 2 * node] = np.minimum(
                tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
        row = np.arange(n)
        while True:
            best = tree[row, 1]
            row = row[best != NEVER]
            if not len(row):
                break
            rank, at = np.divmod(best[best != NEVER], PLACES)
            gone = after[row, at]
            end, start = after[row, gone], before[row, at]
            ids[row, at], ids[row, gone] = self.new_ids[rank], -1
            after[row, at], before[row, end] = end, at
            tree[row, size + gone] = NEVER
            tree[row, size + at] = self._ranked(ids[row, at], ids[row, end], at)
            tree[row, size + start] = self._ranked(ids[row, start], ids[row, at], start)
            for node in (gone, at, start):
                node = (node + size) // 2
                while node[0]:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node // 2
        left = ids >= 0
        ends = np.cumsum(left.sum(1)).tolist()
        flat = tuple(map(self.numbers.__getitem__, ids[left].tolist()))
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: merge at the tree's root until no pair is left."""
        ids = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n == 1:
            return ids
        rank, wide, merged = self.ranks.get, self.wide, self.merged
        size = 1 << (n - 2).bit_length()
        tree = [NEVER] * (2 * size)
        tree[size : size + n - 1] = [
            rank(a * wide + b, NEVER) for a, b in zip(ids, ids[1:])
        ]
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right

        def update(node, value):
            node += size
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left <= right else right
                if tree[node] == least:
                    break
                tree[node] = least

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != NEVER:
            node = 1
            while node < size:
                node *= 2
                if tree[node] != best:
                    node += 1
            at = node - size
            gone = after[at]
            ids[at], ids[gone] = merged[best], -1
            after[at] = end = after[gone]
            if gone < n - 1:
                update(gone, NEVER)
            if end < n:
                before[end] = at
                update(at, rank(ids[at] * wide + ids[end], NEVER))
            else:
                update(at, NEVER)
            start = before[at]
            if start >= 0:
                update(start, rank(ids[start] * wide + ids[at], NEVER))
        return [x for x in ids if x >= 0]

    def _chunks(self, text: str) -> list[str]:
        """Parts that can be cut on their own: a lone space always begins a piece."""
        parts = text.split(" ")
        if max(map(len, parts)) > LONG_CHUNK or not lone_spaces(text):
            return self.cut(text)
        first, *rest = parts
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def encode_all(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """The ids of all texts in a row, and where each text's ids end."""
        parts = []
        for text in texts:
            apart = self.apart(text) if self.apart and text else [text or ""]
            parts.append([
                part if n % 2 else self._chunks(part) if part else []
                for n, part in enumerate(apart)
            ])
        self._learn({chunk for found in parts for chunks in found[::2] for chunk in chunks})
        known, ids, ends = self.known.__getitem__, [], []
        for found in parts:
            for n, chunks in enumerate(found):
                if n % 2:
                    ids.append(self.special[chunks])
                else:
                    ids.extend(chain.from_iterable(map(known, chunks)))
            ends.append(len(ids))
        return ids, ends

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]


_LAST: list = []


def _encoder(shared, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker process, so that later tasks know the chunks of earlier ones."""
    if not _LAST or _LAST[0] is not shared.value:
        _LAST[:] = [shared.value, Encoder(shared.value)]
    _LAST[1].remembered = remembered
    return _LAST[1]


def _encode(shared, decoded: bool, remembered: int = REMEMBERED):
    def run(batches):
        encoder = _encoder(shared, remembered)
        for batch in batches:
            for piece in words.pieces(batch):
                ids, ends = encoder.encode_all(piece.rows.column("text").to_pylist())
                columns = [*piece.rows.columns, pa.ListArray.from_arrays(
                    pa.array([0, *ends], pa.int32()), pa.array(np.array(ids, np.int32)))]
                names = [*piece.rows.schema.names, "ids"]
                if decoded:
                    columns.append(pa.array(_texts(ids, [0, *ends], shared.value.tokens), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text_column: str = "text", decoded: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Per row: ``row`` (struct of all columns but the text), ``text``, ``ids`` (array of int), and if
    asked for ``decoded``, the text that the ids stand for. A worker remembers the ids of about twice
    ``remembered`` chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(
        F.struct(*others(docs, text_column)).alias("row"),
        F.col(text_column).cast("string").alias("text"),
    )
    out = T.StructType([*rows.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        out.add("decoded", T.StringType())
    return rows.mapInArrow(_encode(shared, decoded, remembered), out)


def _texts(ids: list[int], ends: list[int], tokens: list[bytes]) -> list[str]:
    parts = list(map(tokens.__getitem__, ids))
    return [b"".join(parts[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _decode(shared):
    def run(batches):
        tokens = [*shared.value.tokens, b""]
        most = len(tokens) - 1
        for batch in batches:
            ids = batch.column("ids")
            values = ids.flatten()
            known = values.fill_null(-1).to_numpy(zero_copy_only=False)
            good = (known >= 0) & (known < most)
            sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            # an id that the vocabulary lacks points behind it, at nothing
            known = np.where(good, known, most).tolist()
            texts = _texts(known, ends, tokens)
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(texts, pa.string())],
                names=[*names, "decoded"],
            )

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids") -> DataFrame:
    """Per row: ``row`` (struct of all columns but the ids) and ``decoded``; broken UTF-8 becomes
    the replacement sign."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rows = encoded.select(
        F.struct(*others(encoded, ids_column)).alias("row"), F.col(ids_column).alias("ids")
    )
    out = T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decode(shared), out)
