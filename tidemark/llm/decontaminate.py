"""Benchmark passages in documents, found by suffix automata of the benchmark's items.

The items' words (normalised) make generalised suffix automata of at most ``SHARD_WORDS`` words;
a larger benchmark makes several, and documents pass one after the other, so what is broadcast and
held by a task is bounded. A document's words are streamed: the automaton gives the longest run of
item words that ends at each word. Ten words or more end a window's occurrence, and the state knows
the items that hold it. Shorter items count where the whole of them ends. A word that no item has
resets the automaton, so only runs of known words are walked.

Rows: a null text has no words. An item without words has no window. Items without an id hit words,
but are not listed; an id that is given twice is one item. Repeated and null document ids do not
matter, nothing is joined. Other columns travel in a struct, whatever their names. An empty table
gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.scratch import others, stored

WINDOW = 10
SHARD_WORDS = 50_000


def _hashed(piece: words.Piece):
    data = words.LOWER[piece.data]
    spots = words.split(data, piece.bounds, words.ALPHANUMERIC)
    return spots, words.word_hashes(data, spots.starts, spots.ends)


class ItemIndex:
    """Automaton of items, each a list of words, with the items at the ends of windows."""

    def __init__(self, items: list[tuple[str | None, list]], window: int = WINDOW):
        self.window = window
        self.automaton = auto = SuffixAutomaton(row for _, row in items)
        self.least = min((min(len(row), window) for _, row in items if len(row)), default=0)
        order = sorted(range(1, len(auto.length)), key=auto.length.__getitem__)
        # the state that holds the last ``window`` words of any run of a state
        self.last_window = [0] * len(auto.length)
        for state in order:
            if auto.length[state] >= window:
                up = auto.link[state]
                self.last_window[state] = self.last_window[up] if auto.length[up] >= window else state
        self.items = defaultdict(set)
        self.whole = defaultdict(lambda: defaultdict(set))
        for name, row in items:
            state = 0
            for n, word in enumerate(row, 1):
                state = auto.steps[state][word]
                if n >= window:
                    self.items[self.last_window[state]].add(name)
            if 0 < len(row) < window:
                # the run may be a shorter one of its state
                self.whole[state][len(row)].add(name)
        # the nearest state, itself or a suffix, where a short item ends; names stay with that state
        self.nearest = [0] * len(auto.length)
        for state in order:
            self.nearest[state] = state if state in self.whole else self.nearest[auto.link[state]]

    def walk(self, run: list):
        """For a run of words: the windows (start, end) in it and the items they belong to."""
        steps, link, length = self.automaton.steps, self.automaton.link, self.automaton.length
        state = known = 0
        spans, names = [], set()
        for at, word in enumerate(run, 1):
            target = steps[state].get(word)
            while target is None and state:
                state = link[state]
                known = length[state]
                target = steps[state].get(word)
            if target is None:
                continue
            state, known = target, known + 1
            if known >= self.window:
                spans.append((at - self.window, at))
                names |= self.items[self.last_window[state]]
            short = self.nearest[state]
            while short:
                for n, own in self.whole[short].items():
                    if n <= known:
                        spans.append((at - n, at))
                        names |= own
                short = self.nearest[link[short]]
        return spans, names


def _item_words(texts: list[str | None]) -> list[list[int]]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = []
    for piece in words.pieces(batch):
        spots, hashes = _hashed(piece)
        out += [hashes[a:b].tolist() for a, b in zip(spots.first[:-1], spots.first[1:])]
    return out


@lru_cache(maxsize=1)
def _index(shard, window: int):
    """Index and vocabulary of a shard; a worker keeps them from task to task."""
    items = shard.items.value
    return ItemIndex(items, window), np.unique(np.array([x for _, row in items for x in row], np.uint64))


class _Shard:
    """A broadcast with a name. Equal names are equal shards, so that a worker knows them again."""

    def __init__(self, items):
        self.name, self.items = uuid.uuid4().hex, items

    def __hash__(self):
        return hash(self.name)

    def __eq__(self, other):
        return self.name == other.name


def _find(shared: _Shard, window: int):
    """Adds a shard's spans of hit words and items to those of the shards before."""
    schema = pa.schema([("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        ("items", pa.list_(pa.string()))])

    def run(batches):
        index, vocabulary = _index(shared, window)
        for batch in batches:
            for piece in words.pieces(batch):
                spots, hashes = _hashed(piece)
                n_texts = len(piece.bounds) - 1
                spans, names = [[] for _ in range(n_texts)], [set() for _ in range(n_texts)]
                if len(vocabulary) and len(hashes):
                    place = np.searchsorted(vocabulary, hashes)
                    place[place == len(vocabulary)] = 0
                    known = vocabulary[place] == hashes
                    starts = known.copy()
                    starts[1:] &= ~known[:-1]
                    text_starts = spots.first[:-1][spots.first[:-1] < len(known)]
                    starts[text_starts] = known[text_starts]
                    ends = known.copy()
                    ends[:-1] &= ~known[1:]
                    text_ends = spots.first[1:][spots.first[1:] > 0] - 1
                    ends[text_ends] = known[text_ends]
                    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
                    long = ends - starts >= index.least
                    starts, ends = starts[long], ends[long]
                    of = np.searchsorted(spots.first, starts, "right") - 1
                    for text, a, b in zip(of.tolist(), starts.tolist(), ends.tolist()):
                        found, own = index.walk(hashes[a:b].tolist())
                        shift = a - int(spots.first[text])
                        spans[text] += _joined(found, shift)
                        names[text] |= own
                before = zip(piece.rows.column("spans").to_pylist(),
                             piece.rows.column("items").to_pylist())
                both = [([(s["a"], s["b"]) for s in old] + new, set(known_items) | own - {None})
                        for (old, known_items), new, own in zip(before, spans, names)]
                yield pa.RecordBatch.from_arrays([
                    piece.rows.column("row"), piece.rows.column("text"),
                    pa.array([[{"a": a, "b": b} for a, b in x] for x, _ in both],
                             schema.field("spans").type),
                    pa.array([sorted(x) for _, x in both], schema.field("items").type),
                ], names=["row", "text", "spans", "items"])

    return run


def _joined(spans: list[tuple[int, int]], shift: int = 0) -> list[tuple[int, int]]:
    """Spans in order, with overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a + shift <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + shift))
        else:
            out.append((a + shift, b + shift))
    return out


def _cut(longest: int, coverage: float):
    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch):
                spots, _ = _hashed(piece)
                data = piece.data.tobytes()
                counts, hits, merged, clean, rejected = [], [], [], [], []
                rows = piece.rows.column("spans").to_pylist()
                text = piece.rows.column("text")
                for i, spans in enumerate(rows):
                    base, n = int(spots.first[i]), int(spots.first[i + 1] - spots.first[i])
                    spans = _joined([(s["a"], s["b"]) for s in spans])
                    hit = sum(b - a for a, b in spans)
                    counts.append(n)
                    hits.append(hit)
                    merged.append([{"start": a, "end": b} for a, b in spans])
                    rejected.append(bool(n) and hit > coverage * n)
                    at, parts = int(piece.bounds[i]), []
                    for a, b in spans:
                        if b - a > longest:
                            parts.append(data[at:int(spots.starts[base + a])])
                            at = int(spots.ends[base + b - 1])
                    if parts:
                        parts.append(data[at:int(piece.bounds[i + 1])])
                        clean.append(b"".join(parts))
                    else:
                        clean.append(None if not text[i].is_valid else
                                     data[int(piece.bounds[i]):int(piece.bounds[i + 1])])
                yield pa.RecordBatch.from_arrays([
                    piece.rows.column("row"), text,
                    pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                    pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    piece.rows.column("items"),
                    pa.array(clean, pa.binary()).cast(pa.string()),
                    pa.array(rejected, pa.bool_()),
                ], names=["row", "text", "n_words", "n_hit", "spans", "items", "clean", "rejected"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    longest: int = 0, coverage: float = 0.5,
) -> DataFrame:
    """Per row: ``row`` (struct of all columns but the text), ``text``, ``n_words``, ``n_hit`` (words
    in any occurrence of an item's window), ``spans`` of hit words, ``items`` (ids as text, sorted),
    ``clean`` (the text without hit spans of more than ``longest`` words) and ``rejected`` (more than
    ``coverage`` of the words are hit)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"),
                             F.col(item_text).cast("string").alias("body"))
    # every word but the last has at least two bytes with its gap
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-size // (2 * SHARD_WORDS)))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "body"), F.lit(shards)))
    rows = docs.select(
        F.struct(*others(docs, text_column)).alias("row"),
        F.col(text_column).cast("string").alias("text"),
        F.expr("CAST(array() AS array<struct<a:int,b:int>>)").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    for shard in range(shards):
        found = dealt.where(F.col("shard") == shard).select("item", "body").collect()
        listed = list(zip([r.item for r in found], _item_words([r.body for r in found])))
        shared = _Shard(spark.sparkContext.broadcast([x for x in listed if x[1]]))
        rows = rows.mapInArrow(_find(shared, window), rows.schema)
        if shard + 1 < shards:
            rows = stored(rows, "hits")
    span = T.StructType().add("start", "integer").add("end", "integer")
    out = T.StructType([rows.schema["row"], rows.schema["text"]])
    out.add("n_words", T.LongType()).add("n_hit", T.LongType()).add("spans", T.ArrayType(span))
    out.add("items", T.ArrayType(T.StringType())).add("clean", T.StringType())
    out.add("rejected", T.BooleanType())
    return rows.mapInArrow(_cut(longest, coverage), out)
