"""Removal of passages that occur earlier in the corpus.

Suffix automata of reference passages give, for each word of a streamed passage, the longest run
ending there that is known already; runs of the threshold's length are removed. Sending every
document past the automata of all shards would take work in the square of the corpus. So passages
are dealt to shards by an anchor that equal windows share, and only passages that differ from all
earlier ones around their anchor need an automaton:

1. Every window of ``length`` words has one anchor: the run of ``ANCHOR`` words in it with the
   smallest hash (the first of equal ones). Neighbouring windows with one anchor form a passage.
   Each anchor is a row with its own hash and that of the passage.
2. Anchors that occur once hold no repeated window. Of equal passages all but the first are
   repeated throughout. That is settled by counts, and copies are not compared with each other.
3. The first ones of different passages around the same anchor go to that anchor's shard in
   order. Each is streamed past the automaton of those before it, then added.
4. A shard of more than ``SHARD`` different passages (a common line in many contexts) would make one
   task large. It is dealt again by the next smallest runs of each window, which equal windows share
   too, as often as needed and twice as many each time: step 2 for the shorter passages, then step 3.
   When all runs of a window have been used, a shard holds windows of the same runs only.
5. Documents are joined with their marks and cut.

Rows: a null text has no words. A row without id is kept whole and is no earlier place of anything.
Rows that share an id and text get the same result, and are not earlier than each other; of rows that
share an id but not the text, the one with the smaller hash of its text is the earlier. Columns
besides id and text travel in a struct, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.scratch import others, stored

ANCHOR = 6
SHARD = 256
WHOLE = -1
PLACE = ("doc", "print", "m", "j")


def anchors(piece: words.Piece, length: int):
    """Words of a piece, and per anchor: its word, the first and last window, the anchor's hash.

    A window is known by its first word.
    """
    spots = words.split(piece.data, piece.bounds, words.NOT_SPACE)
    hashes = words.word_hashes(piece.data, spots.starts, spots.ends)
    size = min(ANCHOR, length)
    runs = words.rolled(hashes, size) if len(hashes) else hashes
    least, at = runs, np.arange(len(runs))

    def joined(step):
        later = np.full(len(runs), np.iinfo(np.uint64).max)
        where = at.copy()
        if step < len(runs):
            later[:-step], where[:-step] = least[step:], at[step:]
        less = later < least
        return np.where(less, later, least), np.where(less, where, at)

    n, wide = 1, length - size + 1
    while 2 * n <= wide:
        least, at = joined(n)
        n *= 2
    if n < wide:
        least, at = joined(wide - n)
    windows = np.flatnonzero(words.fits(spots.first, length))
    at = at[windows]
    change = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(change[1:] - 1, len(at) - 1) if len(at) else change
    return spots, hashes, at[change], windows[change], windows[last], runs[at[change]]


def _passages(hashes, anchor, low, high, length):
    """One hash for the words from the first to the last window of each anchor."""
    up, down = words.powers(1 << 18) if len(hashes) < 1 << 18 else words.powers.__wrapped__(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    body = (sums[high + length] - sums[low]) * down[low]
    return words.mix(body + words.mix(((anchor - low) * 4096 + high - low).astype(np.uint64)))


def _anchor_rows(length: int):
    schema = pa.schema([("fp", pa.int64()), ("nb", pa.int64()), ("doc", pa.int64()),
                        ("print", pa.int64()), ("m", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch):
                spots, hashes, at, low, high, prints = anchors(piece, length)
                if not len(at):
                    continue
                own = words.owners(spots.first)[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(prints.view(np.int64)),
                    pa.array(_passages(hashes, at, low, high, length).view(np.int64)),
                    *(piece.rows.column(c).take(pa.array(own)) for c in ("doc", "print")),
                    pa.array((at - spots.first[own]).astype(np.int32)),
                ], schema=schema)

    return run


def _find(own, m, marked_own, marked_m):
    """The place of each mark among the anchors, and which marks are anchors at all."""
    keys, wanted = own * (1 << 32) + m, marked_own * (1 << 32) + marked_m
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    good = keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return place, good


def _context_rows(length: int):
    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch):
                spots, _, at, low, high, prints = anchors(piece, length)
                own = words.owners(spots.first)[at]
                lists = piece.rows.column("ms")
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                asked = lists.flatten().to_numpy()
                place, good = _find(own, at - spots.first[own], of, asked)
                place, of, asked = place[good], of[good], asked[good]
                begin, end = spots.starts[low[place]], spots.ends[high[place] + length - 1]
                data = piece.data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(prints[place].view(np.int64)),
                    *(piece.rows.column(c).take(pa.array(of)) for c in ("doc", "print")),
                    pa.array(asked, pa.int32()),
                    pa.array(np.zeros(len(of), np.int32)),
                    pa.array([b" ".join(data[a:b].split()) for a, b in zip(begin, end)],
                             pa.binary()).cast(pa.string()),
                ], names=["fp", "doc", "print", "m", "j", "passage"])

    return run


def _dealt_again(length: int, ranks: range):
    """Passages of a shard, cut where the runs of these ranks by hash change between windows.

    Adds a hash of the shorter passage (``nb``) and its number of windows (``n``); ``j`` is the place
    of its first window among those of the anchor.
    """
    size = min(ANCHOR, length)

    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch, "passage"):
                spots = words.split(piece.data, piece.bounds, words.NOT_SPACE)
                hashes = words.word_hashes(piece.data, spots.starts, spots.ends)
                windows = np.flatnonzero(words.fits(spots.first, length))
                runs = np.lib.stride_tricks.sliding_window_view(
                    words.rolled(hashes, size), length - size + 1)
                own = words.owners(spots.first)[windows]
                shard = piece.rows.column("fp").to_numpy()[own].view(np.uint64)
                ordered = np.sort(runs[windows], axis=1)
                for rank in ranks:
                    shard = words.mix(words.mix(shard) + ordered[:, rank])
                change = np.ones(len(windows), bool)
                change[1:] = (shard[1:] != shard[:-1]) | (own[1:] != own[:-1])
                begin = np.flatnonzero(change)
                low, high = windows[begin], windows[np.append(begin[1:], len(windows)) - 1]
                own, shard = own[begin], shard[begin]
                data = piece.data.tobytes()
                cuts = zip(spots.starts[low], spots.ends[high + length - 1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.view(np.int64)),
                    pa.array(_passages(hashes, low, low, high, length).view(np.int64)),
                    *(piece.rows.column(c).take(pa.array(own)) for c in ("doc", "print", "m")),
                    pa.array((piece.rows.column("j").to_numpy()[own] + low - spots.first[own])
                             .astype(np.int32)),
                    pa.array((high - low + 1).astype(np.int32)),
                    pa.array([data[a:b] for a, b in cuts], pa.binary()).cast(pa.string()),
                ], names=["fp", "nb", "doc", "print", "m", "j", "n", "passage"])

    return run


def _stream_past_automata(length: int):
    """Rows sorted by anchor, document and place: a mask of the windows that came earlier."""

    def run(batches):
        anchor, automaton, waiting, last = None, None, None, None
        for batch in batches:
            masks = []
            shards = batch.column("fp").to_pylist()
            places = zip(*(batch.column(c).to_pylist() for c in PLACE))
            for key, place, passage in zip(shards, places, batch.column("passage")):
                if (key, place) == last:  # a repeated row is not earlier than itself
                    masks.append(0)
                    continue
                last = key, place
                row = passage.as_buffer().to_pybytes().split(b" ")
                if key != anchor:
                    anchor, automaton, waiting = key, SuffixAutomaton(), row
                    masks.append(0)
                    continue
                automaton.add(waiting)
                waiting = row
                known = automaton.matching(row)[length - 1:]
                masks.append(sum(1 << i for i, n in enumerate(known) if n >= length) << place[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc", "print", "m")), pa.array(masks, pa.int64())],
                names=["doc", "print", "m", "mask"],
            )

    return run


def repeated_marks(texts: DataFrame, length: int = 20) -> DataFrame:
    """From (doc, print, text): rows (doc, print, m, mask) of anchors with repeated windows.

    Bit j of the mask is the anchor's j-th window; -1 stands for all of them.
    """
    if not 1 <= length <= 60:
        raise ValueError("length must be between 1 and 60")
    known = texts.where("doc IS NOT NULL")
    rows = known.mapInArrow(
        _anchor_rows(length), "fp long, nb long, doc long, print long, m int")
    # tables that are joined with the rows of very common anchors are written apart from the join,
    # so that the join can split those rows
    counts = stored(rows.groupBy("fp").count().where("count > 1").select("fp"), "repeated")
    repeated = stored(rows.join(counts, "fp"), "anchors")
    place = F.struct("doc", "print", "m")
    first = repeated.groupBy("fp", "nb").agg(F.min(place).alias("first"))
    first = stored(first, "passages")
    marks = (
        repeated.join(first, ["fp", "nb"])
        .where(place != F.col("first"))
        .select("doc", "print", "m", F.lit(WHOLE).cast("long").alias("mask"))
    )
    several = _several(first)
    asked = (
        first.join(several, "fp")
        .groupBy(F.col("first.doc").alias("doc"), F.col("first.print").alias("print"))
        .agg(F.collect_list("first.m").alias("ms"))
    )
    contexts = stored(
        known.join(asked, ["doc", "print"]).mapInArrow(
            _context_rows(length),
            "fp long, doc long, print long, m int, j int, passage string",
        ).join(several, "fp"),
        "contexts",
    )
    runs, used, ready = length - min(ANCHOR, length) + 1, 1, []
    while used < runs:
        large = contexts.where(F.col("kinds") > SHARD)
        if large.isEmpty():
            break
        ready.append(contexts.where(F.col("kinds") <= SHARD))
        ranks = range(used, min(2 * used, runs))
        copies, contexts = _split_shards(large, length, ranks)
        marks, used = marks.unionByName(copies), ranks.stop
    for small in ready:
        contexts = contexts.unionByName(small)
    return marks.unionByName(_streamed(contexts, length))


def _several(first: DataFrame) -> DataFrame:
    """Shards with more than one passage, and how many they have."""
    return stored(
        first.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "several")


def _split_shards(large: DataFrame, length: int, ranks: range) -> tuple[DataFrame, DataFrame]:
    """Marks of shorter passages that are copies, and the first ones of those that differ."""
    kinds = "fp long, nb long, doc long, print long, m int, j int, n int, passage string"
    rows = stored(large.mapInArrow(_dealt_again(length, ranks), kinds), "dealt")
    place = F.struct(*PLACE)
    first = stored(rows.groupBy("fp", "nb").agg(F.min(place).alias("first")), "passages")
    placed = rows.join(first, ["fp", "nb"])
    copies = placed.where(place != F.col("first")).selectExpr(
        "doc", "print", "m", "shiftleft(shiftleft(1L, n) - 1, j) AS mask")
    contexts = placed.where(place == F.col("first")).select("fp", *PLACE, "passage")
    return copies, stored(contexts.join(_several(first), "fp"), "contexts")


def _streamed(contexts: DataFrame, length: int) -> DataFrame:
    shards = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        contexts.repartition(shards, "fp")
        .sortWithinPartitions("fp", *PLACE)
        .mapInArrow(_stream_past_automata(length), "doc long, print long, m int, mask long")
        .where("mask != 0")
    )


def _cut(length: int):
    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch):
                spots, _, at, low, high, _ = anchors(piece, length)
                n = len(spots.starts)
                own = words.owners(spots.first)[at]
                lists = piece.rows.column("marks")
                of = np.repeat(
                    np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()
                )
                marks = lists.flatten()
                place, good = _find(
                    own, at - spots.first[own], of, marks.field("m").to_numpy()
                )
                mask = marks.field("mask").to_numpy()[good]
                low, high = low[place[good]], high[place[good]]
                cover = np.zeros(n + 1, np.int64)
                for j in range(int((high - low).max(initial=-1)) + 1):
                    hit = (low + j <= high) & ((mask >> j) & 1 == 1)
                    np.add.at(cover, low[hit] + j, 1)
                    np.add.at(cover, low[hit] + j + length, -1)
                gone = np.cumsum(cover[:n]) > 0
                yield _result(piece, spots, gone)

    return run


def _result(piece, spots, gone):
    """Counts, removed spans and kept words of the texts of a piece."""
    first = spots.first
    edge = np.diff(gone.astype(np.int8), prepend=0)
    begins = np.union1d(np.flatnonzero(edge == 1), first[:-1][first[:-1] < first[1:]])
    begins = begins[gone[begins]]
    stops = np.union1d(np.flatnonzero(edge == -1), first[1:])
    ends = stops[np.searchsorted(stops, begins, "right")] if len(begins) else begins
    own = words.owners(first)[begins]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(begins, first), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array((begins - first[own]).astype(np.int32)),
             pa.array((ends - first[own]).astype(np.int32))], ["start", "end"]),
    )
    return pa.RecordBatch.from_arrays([
        piece.rows.column("row"),
        piece.rows.column("text"),
        pa.array(np.diff(first)),
        pa.array(words.sums_by_text(gone.astype(np.int64), first)),
        spans,
        kept_words(piece, spots, ~gone),
    ], names=["row", "text", "n_words", "n_removed", "spans", "kept"])


def kept_words(piece: words.Piece, spots: words.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = len(piece.data)
    edges = np.zeros(size + 1, np.int8)
    np.add.at(edges, spots.starts[keep], 1)
    np.add.at(edges, spots.ends[keep], -1)
    copied = np.cumsum(edges[:size], dtype=np.int8).view(bool)
    number = np.cumsum(keep) - keep
    at_first = np.append(number, number[-1:] + keep[-1:])[spots.first[:-1]] if len(keep) else number
    later = keep & (number > np.repeat(at_first, np.diff(spots.first))) if len(keep) else keep
    data = piece.data.copy()
    gaps = spots.starts[later] - 1
    data[gaps] = 0x20
    copied[gaps] = True
    total = np.zeros(size + 1, np.int64)
    np.cumsum(copied, out=total[1:])
    return pa.LargeStringArray.from_buffers(
        len(piece.bounds) - 1,
        pa.py_buffer(total[piece.bounds]),
        pa.py_buffer(data[copied]),
    ).cast(pa.string())


def remove_repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 20
) -> DataFrame:
    """Per row: ``row`` (struct of all columns but the text), ``text``, ``n_words``, ``n_removed``,
    ``spans`` (removed words, from start to before end) and ``kept`` (other words, one space apart).

    A word is removed if it lies in a window of ``length`` words that also starts earlier: in a
    document with a smaller id, or before in the same one.
    """
    rows = docs.select(
        F.struct(*others(docs, text_column)).alias("row"),
        F.col(text_column).cast("string").alias("text"),
        F.col(id_column).cast("long").alias("doc"),
    ).withColumn("print", F.xxhash64("text"))
    marks = repeated_marks(rows.select("doc", "print", "text"), length)
    marks = marks.groupBy("doc", "print").agg(F.collect_list(F.struct("m", "mask")).alias("marks"))
    out = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    out.add("n_words", "long").add("n_removed", "long")
    span = T.StructType().add("start", "integer").add("end", "integer")
    out.add("spans", T.ArrayType(span)).add("kept", "string")
    return rows.join(marks, ["doc", "print"], "left").mapInArrow(_cut(length), out)
