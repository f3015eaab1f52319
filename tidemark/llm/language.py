"""Languages of mixed texts: script ranges narrow the candidates of a word, per-word scores come from
byte n-grams, and Viterbi with a penalty for each switch labels spans of words.

The model is naive Bayes over hashed n-grams of two to four bytes within a word and its edges,
learnt from at most ``SAMPLE_ROWS`` texts of each language, chosen by a hash of their ids. The share
of a language's words in each script says which scripts it is a candidate for. All texts are labelled
whole; many texts take their Viterbi steps together. A document's language is the one with most
bytes, its score their share.

Rows: null texts and texts without a letter are ``und`` with score 0 and no spans, and so is
everything if there is nothing to learn from. Letters are what Unicode calls letters or marks; digits
and signs of any script part words. Rows without id or language are not learnt from.
Repeated rows are labelled alike; ties go to the language that sorts first. Other columns travel in a
struct, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import words
from tidemark.llm.labelled import held_out
from tidemark.llm.scratch import others

BITS = 18
SAMPLE_ROWS = 3_000
SMOOTH = 0.5
SWITCH = 12.0
FOREIGN = -30.0
RARE_SCRIPT = 0.005
TOGETHER = 8 << 20
LETTERS = words.table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
NO_LETTER = 255

# Code points of scripts, from Unicode's blocks. Marks that all scripts share count as Latin.
SCRIPT_RANGES = {
    "Latin": ((0x0000, 0x036F), (0x1AB0, 0x1AFF), (0x1D00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF),
              (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "Greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x0530, 0x058F), (0xFB13, 0xFB17)),
    "Hebrew": ((0x0590, 0x05FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)),
    "Devanagari": ((0x0900, 0x097F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x0980, 0x09FF),),
    "other Indic": ((0x0A00, 0x0DFF),),
    "Thai and Lao": ((0x0E00, 0x0EFF),),
    "Tibetan and Burmese": ((0x0F00, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "Khmer": ((0x1780, 0x17FF),),
    "Han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
}
OTHERS = len(SCRIPT_RANGES)
N_SCRIPTS = OTHERS + 1
LAST = 0x323AF


@cache
def kinds() -> np.ndarray:
    """For each code point the number of its script, ``OTHERS`` for scripts without a number, or
    ``NO_LETTER``. The last entry stands for all beyond."""
    out = np.full(LAST + 2, OTHERS, np.uint8)
    for number, ranges in enumerate(SCRIPT_RANGES.values()):
        for low, high in ranges:
            out[low : high + 1] = number
    signs = [c for c in range(len(out)) if unicodedata.category(chr(c))[0] not in "LM"]
    out[[*signs, LAST + 1]] = NO_LETTER
    return out


def scripts_of_bytes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the script of its character, or ``NO_LETTER``. Stray bytes are no letters."""
    out = np.where(LETTERS[data] & (data < 0x80), np.uint8(0), np.uint8(NO_LETTER))
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    code = padded[lead].astype(np.int64) & (0xFF >> (size + 1))
    for n in (1, 2, 3):
        code = np.where(size > n, code << 6 | padded[lead + n] & 0x3F, code)
    kind = kinds()[np.minimum(code, LAST + 1)]
    out[lead] = kind
    for n in (1, 2, 3):
        own = (size > n) & (padded[lead + n] & 0xC0 == 0x80)
        out[lead[own] + n] = kind[own]
    return out


class Model(NamedTuple):
    """Languages in order; log weights by n-gram and language; which languages use which script."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray


class Marked(NamedTuple):
    """Letters of a piece in small letters, zero elsewhere, with a zero around each text."""

    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    scripts: np.ndarray


def marked(data: np.ndarray, bounds: np.ndarray) -> Marked:
    n_texts = len(bounds) - 1
    place = np.arange(len(data)) + 1 + np.repeat(np.arange(n_texts), np.diff(bounds))
    letters = np.zeros(len(data) + n_texts + 3, np.uint8)
    kind = scripts_of_bytes(data)
    letters[place] = np.where(kind != NO_LETTER, words.LOWER[data], 0)
    script = np.zeros(len(letters), np.uint8)
    script[place] = np.where(kind != NO_LETTER, kind, 0)
    # capitals of the second half of Latin-1
    high = np.flatnonzero(letters[:-1] == 0xC3) + 1
    capital = high[(letters[high] >= 0x80) & (letters[high] <= 0x9E) & (letters[high] != 0x97)]
    letters[capital] += 0x20
    on = letters > 0
    starts = np.flatnonzero(on[1:] & ~on[:-1]) + 1
    ends = np.flatnonzero(on[:-1] & ~on[1:]) + 1
    first = np.searchsorted(starts, bounds + np.arange(n_texts + 1))
    scripts = np.maximum.reduceat(script, starts) if len(starts) else starts
    return Marked(letters, starts, ends, first, scripts)


def grams(letters: np.ndarray):
    """For each length: the places where n-grams begin and their numbers. Those of a word begin from
    the place before it to its last letter."""
    wide = letters.astype(np.uint32)
    on = letters > 0
    value = wide.copy()
    for n in (2, 3, 4):
        value = value[:-1] << np.uint32(8) | wide[n - 1 :]
        inner = on[1 : len(value) + 1] if n > 2 else on[: len(value)] | on[1 : len(value) + 1]
        if n == 4:
            inner = inner & on[2 : len(value) + 2]
        at = np.flatnonzero(inner)
        mixed = (value[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
        yield at, mixed >> np.uint32(32 - BITS)


def sample(
    docs: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id",
    text_column: str = "text", language_column: str = "lang",
) -> DataFrame:
    """(text, lang) of about ``rows`` documents of each language, or all it has, that are not held
    out: those whose hash of the id lies below the share that this is of the language's rows."""
    usable = docs.where(~held_out(id_column)).select(
        F.xxhash64(F.col(id_column).cast("long")).alias("h"),
        F.col(text_column).cast("string").alias("text"),
        F.col(language_column).cast("string").alias("lang"), F.col(id_column).alias("key"),
    ).dropna()
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return usable.select("text", "lang").limit(0)
    share = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, min(1.0, rows / v))))
    place = F.pmod("h", F.lit(1 << 30)) / (1 << 30)
    return usable.where(place < share[F.col("lang")]).select("text", "lang")


def fit(rows: DataFrame) -> Model:
    """Counts of n-grams by language, in one task as the sample is bounded."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in words.pieces(batch):
                found = marked(piece.data, piece.bounds)
                text_of_word = words.owners(found.first)
                langs = piece.rows.column("lang").to_pylist()
                edges = piece.bounds + np.arange(len(piece.bounds))
                for at, numbers in grams(found.letters):
                    of = np.clip(np.searchsorted(edges, at, "right") - 1, 0, len(langs) - 1)
                    for lang in set(langs):
                        own = np.array([x == lang for x in langs])
                        total = counts.setdefault(lang, np.zeros(1 << BITS))
                        total += np.bincount(numbers[own[of]], minlength=1 << BITS)
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])[text_of_word]
                    total = scripts.setdefault(lang, np.zeros(N_SCRIPTS))
                    total += np.bincount(found.scripts[own], minlength=N_SCRIPTS)
        for lang in counts:
            used = np.flatnonzero(counts[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([used.tolist()], pa.list_(pa.int32())),
                 pa.array([counts[lang][used].tolist()], pa.list_(pa.float64())),
                 pa.array([scripts[lang].tolist()], pa.list_(pa.float64()))],
                names=["lang", "grams", "counts", "scripts"])

    # the sample is filtered where it is read, then gathered
    found = rows.repartition(1).mapInArrow(
        run, "lang string, grams array<int>, counts array<double>, scripts array<double>"
    ).toArrow()
    order = sorted(range(found.num_rows), key=lambda i: found["lang"][i].as_py())
    languages = [found["lang"][i].as_py() for i in order]
    weights = np.full((1 << BITS, len(languages)), SMOOTH, np.float32)
    uses = np.zeros((N_SCRIPTS, len(languages)), bool)
    for n, i in enumerate(order):
        weights[found["grams"][i].values.to_numpy(), n] += found["counts"][i].values.to_numpy()
        share = found["scripts"][i].values.to_numpy()
        uses[:, n] = share >= RARE_SCRIPT * max(share.sum(), 1)
    weights = np.log(weights / weights.sum(0, keepdims=True))
    if languages:
        weights -= weights.mean(1, keepdims=True)
    # a script that no language is known for says nothing
    uses |= ~uses.any(1, keepdims=True)
    return Model(languages, weights.astype(np.float32), uses)


def word_scores(model: Model, found: Marked) -> np.ndarray:
    """A row per word: log likelihoods of the languages, far lower for those of other scripts."""
    total = np.zeros((len(found.letters), len(model.languages)), np.float32)
    for at, numbers in grams(found.letters):
        total[at] += model.weights[numbers]
    if not len(found.starts):
        return total[:0]
    scores = np.add.reduceat(total, found.starts - 1, axis=0)
    return scores + np.where(model.uses[found.scripts], 0, FOREIGN).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; texts of words ``first[i]`` to ``first[i + 1]`` take their
    steps together, longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    best_before = np.zeros(len(scores), np.int16)
    stays = np.zeros(scores.shape, bool)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for step in range(longest):
        n = active[step]
        at = begin[:n] + step
        if step:
            now = value[:n]
            best = now.argmax(1)
            jump = now[np.arange(n), best] - switch
            best_before[at] = best
            stays[at] = now >= jump[:, None]
            value[:n] = np.maximum(now, jump[:, None]) + scores[at]
        else:
            value[:n] = scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = value.argmax(1)
    for step in range(longest - 1, -1, -1):
        n = active[step]
        at = begin[:n] + step
        labels[at] = state[:n]
        if step:
            state[:n] = np.where(stays[at, state[:n]], state[:n], best_before[at])
    return labels


def _lettered(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts have a letter: ASCII ones are counted, other texts asked."""
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LETTERS[data] & (data < 0x80), out=plain[1:])
    found = plain[bounds[1:]] > plain[bounds[:-1]]
    for i in np.flatnonzero(~found & (np.diff(bounds) > 1)):
        text = data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(map(str.isalpha, text))
    return found


def _label(shared, switch: float):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches):
        model: Model = shared.value
        n_languages = len(model.languages)
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            for group in words.pieces(batch, most=TOGETHER):
                scores, sizes, counts = [], [], []
                for part in words.pieces(group.rows):
                    found = marked(part.data, part.bounds)
                    if n_languages:
                        scores.append(word_scores(model, found))
                    sizes.append(found.ends - found.starts)
                    counts.append(np.diff(found.first))
                sizes, counts = np.concatenate(sizes), np.concatenate(counts)
                lettered = _lettered(group.data, group.bounds) & (n_languages > 0)
                if not n_languages:
                    scores = [np.zeros((len(sizes), 1), np.float32)]
                first = np.concatenate([[0], np.cumsum(counts)])
                labels = viterbi(np.concatenate(scores), first, switch)
                n_texts, own = len(counts), words.owners(first)
                share = np.zeros((n_texts, max(n_languages, 1)))
                np.add.at(share, (own, labels), sizes)
                best = share.argmax(1)
                total = np.maximum(share.sum(1), 1)
                score = np.where(lettered, share[np.arange(n_texts), best] / total, 0.0)
                cut = np.ones(len(labels), bool)
                cut[1:] = (labels[1:] != labels[:-1]) | (own[1:] != own[:-1])
                cut &= lettered[own]
                begins = np.flatnonzero(cut)
                stops = np.flatnonzero(np.append(
                    (labels[1:] != labels[:-1]) | (own[1:] != own[:-1]), True)) + 1 \
                    if len(labels) else begins
                stops = stops[lettered[own[stops - 1]]] if len(stops) else stops
                of = own[begins]
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(begins, first), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array((begins - first[of]).astype(np.int32)),
                         pa.array((stops - first[of]).astype(np.int32)),
                         names.take(pa.array(labels[begins])) if n_languages
                         else pa.array([], pa.string())], fields=list(span)))
                langs = [model.languages[b] if ok else "und"
                         for b, ok in zip(best.tolist(), lettered.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*group.rows.columns, pa.array(langs, pa.string()), pa.array(score), spans],
                    names=[*group.rows.schema.names, "lang", "score", "spans"])

    return run


def label(
    docs: DataFrame, model: Model, text_column: str = "text", switch: float = SWITCH
) -> DataFrame:
    """Per row: ``row`` (struct of all columns but the text), ``text``, ``lang``, ``score`` and
    ``spans`` (words from start to before end, and their language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.struct(*others(docs, text_column)).alias("row"),
        F.col(text_column).cast("string").alias("text"),
    )
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    out = T.StructType([*rows.schema]).add("lang", T.StringType()).add("score", T.DoubleType())
    out.add("spans", T.ArrayType(span.add("lang", T.StringType())))
    return rows.mapInArrow(_label(shared, switch), out)
