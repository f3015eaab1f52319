"""Operators against plain versions, and on odd rows: nulls, empty and long texts, repeated rows,
empty tables, and extra columns whose names clash with those of the operators."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    automaton, bloom, bpe, covertree, decontaminate, labelled, language, minhash, quality,
    substring, toxicity, urls, warc, words,
)
from tidemark.llm.components import components
from tidemark.llm.queries import default_vocabulary

CLASHES = ["row", "doc", "score", "kept", "n_words", "spans", "ids", "label", "key", "clean",
           "items", "marks", "m", "fp", "lang", "rejected", "decoded", "n_removed"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *(c + "!" for c in CLASHES)) for i, t in rows], SCHEMA)


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, "one two three"), (2, None), (None, "one two three"), (4, ""), (4, ""), (5, " \n\t "),
            (6, long), (7, long), (7, long), (8, "\u00e9t\u00e9 \U0001f600 x" * 30), (9, "!?"), (-3, None),
            (None, None), (10, "x" * 300_000)]


def test_word_tables_match_the_patterns():
    text = bytes(range(1, 128)).decode() + " \u00e9a\u3000b A0"
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, "", "b c"])], names=["text"])
    for inside, pattern in ((words.NOT_SPACE, rb"[^\x20\x09-\x0D]+"),
                            (words.ALPHANUMERIC, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        [piece] = words.pieces(batch)
        spots = words.split(piece.data, piece.bounds, inside)
        data = piece.data.tobytes()
        found = [data[a:b] for a, b in zip(spots.starts, spots.ends)]
        expected = [re.findall(pattern, (t or "").encode()) for t in (text, None, "", "b c")]
        assert found == sum(expected, [])
        assert np.diff(spots.first).tolist() == [len(x) for x in expected]


def test_word_hashes_do_not_depend_on_place_or_block():
    texts = ["alpha beta " * 3, "beta", "x" * 200_000 + " beta", "gamma beta alpha"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    seen = {}
    for most in (1, 50, 1 << 20):
        for piece in words.pieces(batch, most=most):
            spots = words.split(piece.data, piece.bounds, words.NOT_SPACE)
            data = piece.data.tobytes()
            for h, a, b in zip(words.word_hashes(piece.data, *spots[:2]), *spots[:2]):
                assert seen.setdefault(data[a:b], h) == h
    assert len(set(seen.values())) == len(seen) == 4


def test_rolled_hashes_tell_runs_apart():
    h = words.mix(np.array([1, 2, 3, 1, 2, 3, 4], np.uint64))
    for k in (1, 2, 3):
        r = words.rolled(h, k)
        assert r[0] == r[3] and len(set(r[: 8 - k].tolist())) == 8 - k - (4 - k)


def test_automaton_knows_all_runs():
    draw = random.Random(3)
    for _ in range(200):
        rows = [[draw.choice("abc") for _ in range(draw.randint(0, 12))] for _ in range(4)]
        auto = automaton.SuffixAutomaton(rows)
        runs = {tuple(r[i:j]) for r in rows for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        text = [draw.choice("abcd") for _ in range(25)]
        expected = [max(n for n in range(i + 2) if not n or tuple(text[i + 1 - n:i + 1]) in runs)
                    for i in range(len(text))]
        assert auto.matching(text) == expected


# ---- substring dedup

def cut_plainly(rows, length):
    """The contract's rule, window by window."""
    seen, out = set(), []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(ws)
        for s in range(len(ws) - length + 1):
            run = tuple(ws[s:s + length])
            if run in seen:
                gone[s:s + length] = [True] * length
            seen.add(run)
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def passages(seed, n=60, vocabulary=25):
    draw = random.Random(seed)
    shared = [" ".join(f"w{draw.randrange(vocabulary)}" for _ in range(draw.randint(5, 40)))
              for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [draw.choice(shared) if draw.random() < 0.6 else
                 " ".join(f"w{draw.randrange(vocabulary * 40)}" for _ in range(draw.randint(0, 30)))
                 for _ in range(draw.randint(0, 6))]
        rows.append((i * 3, "  ".join(parts)))
    rows += [(1000 + i, rows[5][1]) for i in range(5)] + [(2000, "a a a a a " * 40)]
    return rows


@pytest.mark.parametrize("shard, length", [(1, 8), (1, 20), (3, 20), (256, 5), (256, 20)])
def test_substring_dedup_is_exact(spark, monkeypatch, shard, length):
    monkeypatch.setattr(substring, "SHARD", shard)
    rows = passages(length + shard)
    found = substring.remove_repeated_passages(
        frame(spark, rows).repartition(5), length=length).collect()
    got = sorted((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found)
    assert got == sorted(cut_plainly(rows, length))
    for r in found:
        ws = (r["text"] or "").split()
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
        gone = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert " ".join(w for i, w in enumerate(ws) if i not in gone) == r["kept"]


def test_substring_dedup_of_odd_rows(spark):
    found = substring.remove_repeated_passages(frame(spark, odd_rows())).collect()
    assert len(found) == len(odd_rows())
    by_id = {r["row"]["doc_id"]: r for r in found}
    assert by_id[2]["n_words"] == 0 and by_id[2]["kept"] == "" and by_id[2]["text"] is None
    assert by_id[1]["n_removed"] == 0 and by_id[6]["n_removed"] == 60_000 - 977 - 19 + 19
    assert by_id[7]["n_removed"] == 60_000 and by_id[7]["kept"] == ""
    assert all(r["row"]["kept"] == "kept!" for r in found)
    assert substring.remove_repeated_passages(frame(spark, [])).count() == 0


def test_a_common_line_in_many_contexts_is_dealt_again(spark, monkeypatch):
    """Also periodic texts, whose windows have the same runs in another order."""
    monkeypatch.setattr(substring, "SHARD", 4)
    draw = random.Random(5)
    line = " ".join(f"c{i}" for i in range(12))

    def noise(n):
        return " ".join(f"n{draw.randrange(6)}" for _ in range(n))

    rows = [(i, f"{noise(9)} {line} {noise(9)}") for i in range(40)]
    rows += [(100 + i, " ".join("abc"[(i + j) % 3] for j in range(21))) for i in range(6)]
    rows += [(200 + i, f"{noise(3)} {rows[i][1]}") for i in range(5)]
    found = substring.remove_repeated_passages(frame(spark, rows).repartition(4)).collect()
    got = sorted((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found)
    assert got == sorted(cut_plainly(rows, 20))


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Equal rows are not earlier than each other; different texts of one id keep their own cuts."""
    draw = random.Random(7)
    w, x, y = (" ".join(f"{c}{draw.randrange(900)}" for _ in range(30)) for c in "wxy")
    rows = [(1, w), (5, f"{w} {x}"), (5, f"{y} {y}"), (9, f"{x} {y}"), (9, f"{x} {y}"),
            (12, f"new {y} words")]
    found = substring.remove_repeated_passages(frame(spark, rows)).collect()
    got = sorted((r["row"]["doc_id"], r["text"], r["n_removed"]) for r in found)
    assert got == sorted([(1, w, 0), (5, rows[1][1], 30), (5, rows[2][1], 30),
                          (9, rows[3][1], 60), (9, rows[3][1], 60), (12, rows[5][1], 30)])


def test_equal_rows_in_a_shard_of_several_passages(spark):
    draw = random.Random(8)
    line, a, b, c = (" ".join(f"{k}{draw.randrange(900)}" for _ in range(14)) for k in "labc")
    rows = [(1, f"{a} {line} {b}")] * 2 + [(2, f"{c} {line} {a}")] * 2
    found = substring.remove_repeated_passages(frame(spark, rows).repartition(2)).collect()
    assert sorted((r["row"]["doc_id"], r["n_removed"]) for r in found) == [(1, 0), (1, 0), (2, 0), (2, 0)]


# ---- near duplicates

def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return set()
    return {tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))}


def components_plainly(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def families(seed):
    draw = random.Random(seed)
    rows = []
    for family in range(4):
        base = [f"f{family}w{draw.randrange(90)}" for _ in range(draw.randint(20, 120))]
        for _ in range(draw.randint(10, 25)):
            new = list(base)
            for _ in range(draw.randint(0, 4)):
                new[draw.randrange(len(new))] = f"n{draw.randrange(10**6)}"
            if draw.random() < 0.3:
                base = new
            rows.append(" ".join(new))
    rows += ["Only FOUR words here", "only four words here", "x", "", rows[0].upper()]
    draw.shuffle(rows)
    return [(10 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rows = families(block)
    found = minhash.near_duplicates(frame(spark, rows).repartition(4)).collect()
    assert {r["doc"]: (r["n_shingles"], r["component"]) for r in found} == components_plainly(rows)
    assert all(r["kept"] == (r["component"] == r["doc"]) for r in found)


def test_near_duplicates_of_odd_rows(spark):
    found = minhash.near_duplicates(frame(spark, odd_rows())).collect()
    by_id = {r["doc"]: r for r in found}
    assert len(found) == len({i for i, _ in odd_rows()})
    assert by_id[7]["component"] == 6 and not by_id[7]["kept"] and by_id[6]["kept"]
    for i in (2, 4, 5):
        assert by_id[i]["n_shingles"] == 0 and by_id[i]["component"] == i and by_id[i]["kept"]
    assert by_id[None]["kept"] and by_id[1]["component"] == 1
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_one_text_speaks_for_a_repeated_id(spark, parts):
    base = [f"w{i}" for i in range(60)]
    near, near_too = " ".join(base), " ".join(base[:-1] + ["other"])
    rows = [(1, near), (2, near_too), (3, ""), (3, None), (3, " ".join(base[:-1] + ["third"])), (9, "")]
    for order in (rows, rows[::-1]):
        found = minhash.near_duplicates(frame(spark, order).coalesce(1).repartition(parts)).collect()
        assert {r["doc"]: (r["n_shingles"], r["component"], r["kept"]) for r in found} == {
            1: (56, 1, True), 2: (56, 1, False), 3: (56, 1, False), 9: (0, 9, True)}


def test_texts_of_a_repeated_id_do_not_mix(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (5, " ".join(a[:-1] + ["x"])), (5, " ".join(b[:-1] + ["x"]))]
    found = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = minhash.near_duplicates(frame(spark, order).repartition(3)).collect()
        found.add(frozenset((r["doc"], r["component"]) for r in got))
    assert len(found) == 1
    [only] = found
    assert dict(only)[5] in (1, 2)


def test_circulant_signature_agrees_as_often_as_sets():
    draw = np.random.default_rng(0)
    every = words.mix(draw.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = every[:2500], every[500:]
    signs = minhash.signatures([a, b], 1500)
    assert abs((signs[0] == signs[1]).mean() - 2000 / 3000) < 0.05


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 300), (300, 400), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    got = dict(map(tuple, found))
    assert len(found) == len(got) == 204
    assert all(got[i] == 0 for i in range(201)) and {got[i] for i in (300, 400, 500)} == {300}


# ---- decontamination

def hits_plainly(text, items):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hit, names = set(), set()
    for name, item in items:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in item or "")
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        n = min(10, len(iw))
        if not n:
            continue
        windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i:i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(name)
    return len(ws), len(hit), sorted(str(n) for n in names if n is not None)


@pytest.mark.parametrize("shard_words", [20, 50_000])
def test_decontamination_is_exact(spark, monkeypatch, shard_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    draw = random.Random(5)

    def phrase(n, size):
        return " ".join(f"w{draw.randrange(size)}" for _ in range(n))

    items = [(i, phrase(draw.randint(1, 30), 12)) for i in range(12)]
    items += [(50, None), (51, "..."), (None, "null item of three"), (3, "again a third item text")]
    rows = [(i, ". ".join(draw.choice([phrase(draw.randint(0, 25), 14), draw.choice(items)[1] or "",
                                       phrase(5, 900)]) for _ in range(5))) for i in range(60)]
    rows += [(100, "NULL item, of three"), (101, None), (102, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(frame(spark, rows), bench).collect()
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found}
    assert got == {i: hits_plainly(t, items) for i, t in rows}
    by_id = {r["row"]["doc_id"]: r for r in found}
    assert by_id[100]["n_hit"] == 4 and by_id[100]["clean"] == "" and by_id[100]["rejected"]
    assert by_id[101]["clean"] is None and not by_id[101]["rejected"]
    for r in found:
        assert r["n_hit"] > 0 or r["clean"] == r["text"]
        assert hits_plainly(r["clean"], [])[0] == r["n_words"] - r["n_hit"]


def test_names_of_short_items_stay_with_one_state():
    items = [(f"s{i}", ["a"]) for i in range(4000)] + [("two", ["b", "a"])]
    items += [(f"l{i}", [f"w{i}", "b", "a"] * 5) for i in range(200)]
    index = decontaminate.ItemIndex(items)
    assert sum(len(names) for state in index.whole.values() for names in state.values()) == 4001
    spans, names = index.walk(["w1", "b", "a"])
    assert sorted(spans) == [(1, 3), (2, 3)] and len(names) == 4001 and "two" in names


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")
    found = decontaminate.decontaminate(frame(spark, odd_rows()), bench).collect()
    assert len(found) == len(odd_rows()) and all(r["row"]["clean"] == "clean!" for r in found)
    assert {r["row"]["doc_id"] for r in found if r["n_hit"]} == {6, 7}
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0
    none = decontaminate.decontaminate(frame(spark, odd_rows()), bench.limit(0)).collect()
    assert len(none) == len(odd_rows()) and not any(r["n_hit"] for r in none)


# ---- byte pair encoding

def test_bpe_equals_the_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(default_vocabulary())
    draw = random.Random(1)
    pool = [*map(chr, range(0x250)), *"\u1680\u2003\u2028\u200b\u3000\u4e00\U0001f600\u0301\u0966\ufeff\u180e"]
    rows = [(i, "".join(draw.choice(pool) if draw.random() < 0.5 else draw.choice(" ae'st0\n\t")
                        for _ in range(draw.randint(0, 60)))
             + "<|endoftext|> x" * (i % 7 == 0)) for i in range(1500)] + odd_rows()
    vocabulary = bpe.load_vocabulary(spark, default_vocabulary())
    encoded = bpe.encode(frame(spark, rows), vocabulary)
    back = bpe.decode(encoded.withColumn("again", F.col("ids")), vocabulary).collect()
    assert len(back) == len(rows)
    for r in back:
        text = r["row"]["text"] or ""
        ids = model.encode(text, add_special_tokens=False).ids
        assert r["row"]["again"] == ids and r["decoded"] == model.decode(ids, skip_special_tokens=False)
        assert r["row"]["row"]["ids"] == "ids!"
    assert bpe.encode(frame(spark, []), vocabulary).count() == 0


def test_bpe_single_and_side_by_side_merges_agree(spark):
    encoder = bpe.Encoder(bpe.load_vocabulary(spark, default_vocabulary()))
    draw = random.Random(2)
    pieces = {"".join(draw.choice("aethrnoi ") for _ in range(draw.randint(2, 60))) for _ in range(500)}
    for piece in pieces:
        data = piece.encode()
        [both] = encoder._merge_all([data], 1 << len(data).bit_length())
        assert list(both) == encoder.merge(piece)


def test_decoding_of_unknown_and_broken_ids(spark):
    vocabulary = bpe.load_vocabulary(spark, default_vocabulary())
    half = encoder_ids = [i for i, t in enumerate(vocabulary.tokens) if t == b"\xc3"]
    rows = [(1, [10**6, -4, None]), (2, None), (3, []), (4, encoder_ids)]
    found = bpe.decode(spark.createDataFrame(rows, "id long, ids array<int>"), vocabulary).collect()
    assert {r["row"]["id"]: r["decoded"] for r in found} == {1: "", 2: "", 3: "", 4: "\ufffd" * len(half)}


# ---- models

def test_held_out_rows(spark):
    import zlib
    found = spark.range(200).select("id", labelled.held_out("id").alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in found)


def labelled_rows(spark, n=400):
    draw = random.Random(8)
    plain = ["river", "stone", "walks", "under", "cloud", "paper", "lamp", "green"]
    rows, labels = [], []
    for i in range(n):
        ws = [draw.choice(plain) for _ in range(draw.randint(8, 40))]
        bad = draw.random() < 0.3
        if bad:
            ws.insert(draw.randrange(len(ws)), draw.choice(["grumous", "grumouser", "vilipend"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), labels


def test_toxicity_learns_words(spark):
    docs, labels, truth = labelled_rows(spark)
    model = toxicity.fit(labelled.sample(docs, labels, "toxic"))
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in truth]) > 0.97
    assert len(model.features) < 200
    odd = toxicity.score(frame(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(frame(spark, []), model).count() == 0
    nothing = toxicity.fit(labelled.sample(docs, labels.limit(0), "toxic"))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_sample_leaves_out_held_out_null_and_repeated_rows(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(50)] + [(1, "t1"), (None, "x"), (2, None)])
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(50)] + [(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    keys = [r["key"] for r in labelled.sample(docs, labels, "toxic").collect()]
    out = {r["id"] for r in spark.range(50).where(labelled.held_out("id")).collect()}
    assert sorted(keys) == sorted(set(range(50)) - out)
    assert labelled.sample(docs, labels, "toxic", rows=7).count() == 7


def test_quality_ranks_texts(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        ws = [draw.choice(["river", "stone", "walks", "under", "cloud", "paper"]) + str(draw.randrange(50))
              for _ in range(30)]
        good = draw.random() < 0.7
        text = " ".join(ws) if good else draw.choice(
            [" ".join(w.upper() + "!!" for w in ws), " | ".join(ws), " ".join([ws[0]] * 30)])
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(labelled.sample(docs, table, "quality"))
    got = {r["row"]["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in labels]) > 0.97
    odd = quality.score(frame(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score(frame(spark, []), model).count() == 0
    same = quality.fit(labelled.sample(docs, table.where("quality = 1"), "quality"))
    assert {r["score"] for r in quality.score(docs, same).collect()} == {1.0}


def test_quality_learns_from_every_row(spark, monkeypatch):
    """The share of good rows and the cut are of all rows, whatever the buckets, the partitions and how
    rare one kind is; rows that are held out teach nothing."""
    monkeypatch.setattr(labelled, "SAMPLE_ROWS", 10)
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice(["Stone", "river", "a|b", "!!"]) for _ in range(20 + i % 7))) for i in range(900)]
    labels = [(i, int(t.count("|") < 4)) for i, t in rows]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["id"] for r in spark.range(900).where(labelled.held_out("id")).collect()}

    def model(docs, labels):
        return quality.fit(labelled.with_labels(quality.measured(labelled.learnable(docs)), labels, "quality"))

    docs = frame(spark, rows)
    whole = model(docs, table)
    kept = [y for i, y in labels if i not in out]
    assert whole.share == np.mean(kept)
    scores = [r["score"] for r in quality.score(docs.where(~labelled.held_out("doc_id")), whole).collect()]
    assert abs(np.mean([s > 0.3 for s in scores]) - whole.share) < 0.01
    monkeypatch.setattr(quality, "BUCKET", 100)
    some = model(docs.repartition(7), table.repartition(3))
    assert np.array_equal(some.weights.round(9), model(docs.repartition(2).union(docs), table).weights.round(9))
    rare = model(docs, spark.createDataFrame([(i, int(i < 8)) for i, _ in rows], "doc_id long, quality int"))
    assert rare.weights.any() and rare.share == np.mean([i < 8 for i, _ in rows if i not in out])


def test_few_remembered_chunks_give_the_same_ids(spark):
    vocabulary = bpe.load_vocabulary(spark, default_vocabulary())
    texts = [" ".join(f"word{i}x{j} stone" for j in range(40)) for i in range(30)]
    encoders = [bpe.Encoder(vocabulary), bpe.Encoder(vocabulary)]
    encoders[1].remembered = 50
    found = [[e.encode(t) for t in texts] for e in encoders]
    assert found[0] == found[1] and len(encoders[1].known) + len(encoders[1].older) < 300 < len(encoders[0].known)


# ---- languages

LANGS = {"aa": "thing ring other that with", "bb": "keit ung lich schon und", "cc": "\u0434\u043e\u043c \u0440\u0435\u043a\u0430 \u0438"}


def test_scripts_are_those_of_code_points():
    names = list(language.SCRIPT_RANGES)

    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        marks = language.marked(data, np.array([0, len(data)]))
        texts = [marks.letters[a:b].tobytes().decode() for a, b in zip(marks.starts, marks.ends)]
        return [(t, names[s] if s < len(names) else "others") for t, s in zip(texts, marks.scripts)]

    assert found("ti\u1ebfng Vi\u1ec7t") == [("ti\u1ebfng", "Latin"), ("vi\u1ec7t", "Latin")]
    assert found("\u1f04\u03bd\u03b8\u03c1\u03c9\u03c0\u03bf\u03c2") == [
        ("\u1f04\u03bd\u03b8\u03c1\u03c9\u03c0\u03bf\u03c2", "Greek")]
    assert found("good\U0001f600day \u201cso\u201d\u2014\u2026") == [
        ("good", "Latin"), ("day", "Latin"), ("so", "Latin")]
    assert found("\u4e2d\u6587 \u3072\u3089 \ud55c\uad6d \U00020000 \u0661\u0662") == [
        ("\u4e2d\u6587", "Han"), ("\u3072\u3089", "kana"), ("\ud55c\uad6d", "Hangul"), ("\U00020000", "Han")]
    assert found("\u0939\u093f\u0928\u094d\u0926\u0940 \u10e5 \u16a0") == [
        ("\u0939\u093f\u0928\u094d\u0926\u0940", "Devanagari"), ("\u10e5", "Georgian"), ("\u16a0", "others")]


def test_broken_bytes_are_no_letters():
    data = np.array([0xFF, 0x41, 0x80, 0xE2, 0x82], np.uint8)
    assert (language.scripts_of_bytes(data) != language.NO_LETTER).tolist() == [False, True, False, False, False]


def test_language_labels_spans(spark):
    draw = random.Random(6)
    rows = []
    for i in range(240):
        lang = draw.choice(list(LANGS))
        rows.append((i, " ".join(draw.choice(LANGS[lang].split()) for _ in range(20)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.sample(docs))
    assert model.languages == ["aa", "bb", "cc"]
    mixed = "thing ring other that with thing " * 3 + "keit ung lich schon und keit " * 4
    found = language.label(frame(spark, [(1, mixed), (2, "1 2 ?!"), (3, None), (4, "\u0440\u0435\u043a\u0430"),
                                         (5, "\U0001f600 \u2026")]), model).collect()
    by_id = {r["row"]["doc_id"]: r for r in found}
    spans = [(s["start"], s["end"], s["lang"]) for s in by_id[1]["spans"]]
    assert spans == [(0, 18, "aa"), (18, 42, "bb")] and by_id[1]["lang"] == "bb"
    assert [by_id[i]["lang"] for i in (2, 3, 4, 5)] == ["und", "und", "cc", "und"]
    assert by_id[2]["spans"] == [] and by_id[3]["score"] == 0
    odd = language.label(frame(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert language.label(frame(spark, []), model).count() == 0
    nothing = language.fit(language.sample(docs.limit(0)))
    assert {r["lang"] for r in language.label(frame(spark, odd_rows()), nothing).collect()} == {"und"}


def test_viterbi_takes_the_best_path():
    import itertools
    draw = np.random.default_rng(1)
    sizes = [0, 5, 1, 7, 0, 3]
    first = np.cumsum([0] + sizes)
    scores = draw.normal(size=(sum(sizes), 3)).astype(np.float32)
    labels = language.viterbi(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:]):
        def value(path):
            return sum(scores[a + i, s] for i, s in enumerate(path)) - 0.7 * sum(
                x != y for x, y in zip(path, path[1:]))
        if b > a:
            best = max(value(p) for p in itertools.product(range(3), repeat=b - a))
            assert value(labels[a:b].tolist()) == pytest.approx(best, abs=1e-4)


# ---- urls

def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    for listed in (keys.where("key LIKE '%7'"), keys.where("key = 'k5'"), keys, keys.limit(0)):
        cascade = bloom.build(spark, bloom.plan(listed, keys.union(keys.limit(50))))
        inside = {r["key"] for r in listed.collect()}
        a, b = bloom.key_hashes(F.col("key"))
        rows = keys.select("key", a.alias("a"), b.alias("b")).toArrow()
        got = bloom.listed(cascade, rows["a"].to_numpy(), rows["b"].to_numpy())
        assert {k for k, g in zip(rows["key"].to_pylist(), got) if g} == inside
    assert not cascade.levels


def test_cascades_of_shards_are_exact(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BITS", 4096)
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = keys.where("key LIKE '%7'")
    plan = bloom.plan(listed, keys)
    a, b = bloom.key_hashes(F.col("key"))
    rows = keys.select("key", a.alias("a"), b.alias("b")).toArrow()
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    shard, got = bloom.shard_of(a, plan.n_shards), np.zeros(len(a), bool)
    assert plan.n_shards == 3
    for number in range(plan.n_shards):
        cascade = bloom.build(spark, plan, number)
        assert max(level.n_bits for level in cascade.levels) < 1.2 * 4096
        own = np.flatnonzero(shard == number)
        got[own] = bloom.listed(cascade, a[own], b[own])
    assert [k.endswith("7") for k in rows["key"].to_pylist()] == got.tolist()


def test_urls_with_many_rules_in_shards(spark, monkeypatch):
    """More lengths of rules than 256, and filters in shards, against the rules one by one."""
    monkeypatch.setattr(bloom, "MOST_BITS", 512)
    draw = random.Random(9)
    rules = [(f"h{i % 40}.org", "/" + "x" * i, draw.choice(["allow", "block"])) for i in range(300)]
    rules.append(("org", "/", "block"))
    rows = [(i, f"http://w.h{draw.randrange(45)}.org/" + "x" * draw.randrange(320)) for i in range(400)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3),
                       spark.createDataFrame(rules, "host string, path string, action string"))
    for r in found.collect():
        fits = [(len(h + p), h + p, a) for h, p, a in rules
                if r["host"].endswith("." + h) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == max(fits)[1:]


def test_urls(spark):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/x", "allow"), (None, "/", "block"),
         ("net", "", "block")], "host string, path string, action string")
    cases = {
        "http://A.com/xy?q#f": ("a.com", "/xy", "a.com/x", "block"),
        "http://c.b.a.com/x": ("c.b.a.com", "/x", "b.a.com/x", "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://aa.com/x": ("aa.com", "/x", "com/", "allow"),
        "s://q.net?x=/": ("q.net", "", "net", "block"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://\u00c9.com/\n/y": ("\u00c9.com", "/\n/y", "\u00c9.com"[2:] + "/", "allow"),
    }
    rows = [(u, "a", "b") for u in cases] + [("http://a.com", "a", "b")]
    table = spark.createDataFrame(rows, "url string, host string, verdict string")
    found = urls.judge(table, rules).collect()
    assert len(found) == len(rows) and all(r["row"]["host"] == "a" for r in found)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["row"]["url"]]
    assert urls.judge(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(table, rules.limit(0)).collect()} == {"allow"}


# ---- vectors

def test_top_k_is_exact(spark):
    draw = np.random.default_rng(2)
    vectors = [(int(i), [float(x) for x in draw.integers(-3, 4, 6)]) for i in range(400)]
    vectors += [(1000 + i, [1.0] * 6) for i in range(60)]
    odd = [(2000, None), (2001, [1.0, None] * 3), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6),
           (2004, []), (2005, [2.0]), (None, [1.0] * 6), (3, vectors[3][1]), (2100, [1.5])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    usable = covertree.usable(table, "vec_id", "embedding", F.transform("x", lambda c: c.cast("double")))
    found = covertree.top_k(usable, usable.where("id % 10 = 0"), 7).collect()
    every = vectors + [(2005, [2.0]), (2100, [1.5])]
    for query, v in every:
        if query % 10 == 0:
            scores = sorted((-np.dot(v, w), i) for i, w in every if i != query and len(w) == len(v))[:7]
            got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
            assert got == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert covertree.top_k(usable.limit(0), usable.limit(0)).count() == 0


def test_top_k_in_several_waves(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 16)
    monkeypatch.setattr(covertree, "WAVE", 32)
    draw = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in draw.integers(-9, 10, 5)]) for i in range(300)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    usable = covertree.usable(table, "vec_id", "embedding", F.col("x"))
    found = covertree.top_k(usable, usable.where("id % 3 = 0"), 4).collect()
    assert len(found) == 400
    for query, v in vectors[::3]:
        scores = sorted((-np.dot(v, w), i) for i, w in vectors if i != query)[:4]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        assert got == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


def test_of_vectors_that_share_an_id_the_largest_counts(spark):
    rows = [(1, [1.0, 5.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 3.0]), (3, None), (3, [0.0, 3.0])]
    extra = [(i, v, "clash", 7) for i, v in rows]
    for order in (extra, extra[::-1]):
        table = spark.createDataFrame(order, "vec_id long, embedding array<double>, id string, dim int")
        table = table.repartition(3)
        usable = covertree.usable(table, "vec_id", "embedding", F.col("x"))
        found = covertree.top_k(usable, usable.where("id = 2"), 5).collect()
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found)] == [(1, 3, 3), (2, 1, 2)]


def test_vectors_whose_products_are_not_exact_are_refused(spark):
    table = spark.createDataFrame([(1, [9e12]), (2, [9e12]), (3, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large to be exact"):
        covertree.usable(table, "vec_id", "embedding", F.col("x")).collect()
    most = spark.createDataFrame([(1, [94906265.0]), (2, [94906265.0])], "vec_id long, embedding array<double>")
    usable = covertree.usable(most, "vec_id", "embedding", F.col("x"))
    assert {r["score"] for r in covertree.top_k(usable, usable).collect()} == {94906265 ** 2}


def test_cover_tree_covers():
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=(300, 4)), np.zeros((40, 4))])
    tree = covertree.build(np.arange(len(x)), x)

    def points(node):
        if tree.leaf[node]:
            return tree.order[tree.start[node]:tree.end[node]].tolist()
        return sum((points(c) for c in range(tree.start[node], tree.end[node])), [])

    assert sorted(points(0)) == list(range(len(tree.points))) and len(tree.ids) == len(x)
    for node in range(len(tree.centre)):
        far = np.linalg.norm(tree.points[points(node)] - tree.points[tree.centre[node]], axis=1)
        assert far.max() <= tree.radius[node] + 1e-12


# ---- archives

def test_archives_round_trip(spark, tmp_path):
    big = "<p>\u00e9 WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 20
    rows = [(5, "http://a.com/x y\r\nz", big), (3, None, big), (9, "http://b.com", big), (4, "u", None),
            (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (10, "u", "\r\n"), (11, "u", "x\r\n\r\n"),
            (12, "u", "\r\n\r\n" * 70_000), (None, "n", big), (13, "u", "z" * 3_000_000), (7, "u", "short")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(table), path)
    records = warc.read_archives(spark, path)
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()} == {
        "request": 13, "metadata": 13, "response": 10, "revisit": 3}
    found = warc.assemble(records).collect()
    # the two equal rows are two captures
    assert len(found) == 13 and all(r["sound"] for r in found)
    for r in found:
        page = re.search(r"page-id: (-?\d*)", r["metadata"]["payload"].decode())[1]
        html = dict((str(i or ""), h) for i, _, h in rows)[page] or ""
        assert r["payload"].decode() == html and r["payload_bytes"] == len(html.encode())
        assert r["payload_sha256"] == hashlib.sha256(html.encode()).hexdigest()
        assert r["request"]["payload"] == b"" and r["request"]["http"].startswith(b"GET ")
        assert (r["type"] == "revisit") == (page in ("5", "9", ""))
        if r["type"] == "revisit":
            assert "page-id: 3" in r["refers_to"]["metadata"]["payload"].decode()
    empty = str(tmp_path / "none")
    warc.write_archives(warc.plan_records(table.limit(0)), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0


def test_archives_of_other_tools(spark, tmp_path):
    import gzip
    body = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\x00bin"
    record = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: "
              b"application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body)) + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record))
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r["type"] for r in found] == ["warcinfo", "response"]
    assert found[1]["payload"] == bytearray(b"\xff\xfe\x00bin")
    [capture] = warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert capture["record_id"] == "<urn:x>" and capture["request"] is None


def _record(number, body, length=None):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Type: application/http; "
            b"msgtype=response\r\nContent-Length: %s\r\n\r\n" % (number, length or b"%d" % len(block))
            + block + b"\r\n\r\n")


@pytest.mark.parametrize("ending", ["warc", "warc.bz2"])
def test_archives_that_spark_cuts_into_ranges(spark, tmp_path, ending):
    import bz2
    draw = random.Random(9)
    noise = [b"\r\n\r\nWARC/1.0\r\nContent-Length: 7\r\n\r\n", b"\r\n\r\n", bytes(draw.randbytes(9000)), b"text "]
    bodies = [b"".join(draw.choices(noise, k=draw.randint(0, 12))) for _ in range(400)]
    whole = b"".join(_record(i, body) for i, body in enumerate(bodies))
    for n in range(2):
        data = whole if n == 0 else whole[: len(whole) // 2]
        (tmp_path / f"{n}.{ending}").write_bytes(bz2.compress(data) if ending.endswith("bz2") else data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("256k", "64k", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = warc.read_archives(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        good = [r for r in found if r["defect"] is None]
        assert len(found) == len(good) + 1 and [r["defect"] for r in found if r["defect"]] == ["truncated"]
        names = [r["record_id"] for r in good]
        assert len(set(names)) == 400 and {f"<urn:{i}>" for i in range(400)} == set(names)
        for r in good:
            assert bytes(r["payload"]) == bodies[int(r["record_id"][5:-1])]


def test_broken_records_are_rows_with_a_defect(spark, tmp_path):
    import gzip
    parts = [_record(0, b"a"), _record(1, b"b\r\n\r\nc", b"soon"), _record(2, b"d"), _record(3, b"e", b"-4"),
             _record(4, b"f"), _record(5, b"whole", b"5000")]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(_record(6, b"no gap behind").removesuffix(b"\r\n\r\n")))
    found = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {k: r["defect"] for k, r in found.items()} == {
        "<urn:0>": None, "<urn:1>": "length", "<urn:2>": None, "<urn:3>": "length", "<urn:4>": None,
        "<urn:5>": "truncated", "<urn:6>": None}
    assert bytes(found["<urn:2>"]["payload"]) == b"d" and bytes(found["<urn:6>"]["payload"]) == b"no gap behind"
    assert warc.assemble(warc.read_archives(spark, str(tmp_path))).count() == 4


def test_pages_that_share_an_id_are_captures_of_their_own(spark, tmp_path):
    big, other = "x" * 200, "y" * 200
    rows = [(1, "u", big), (1, "v", other), (2, "u", big), (3, "u", "s"), (3, "u", "s"), (None, "u", other)]
    table = spark.createDataFrame([(*r, "n", "d") for r in rows],
                                  "page_id long, url string, html string, name string, digest string")
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(table), path)
    found = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len(found) == 6 and all(r["sound"] for r in found)
    assert sorted((r["type"], bytes(r["payload"])[:1]) for r in found) == [
        ("response", b"s"), ("response", b"s"), ("response", b"x"), ("response", b"y"),
        ("revisit", b"x"), ("revisit", b"y")]
