"""Manifest proofs, chat formatting and tokenizer alignment against plain versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, chat, manifest
from tidemark.llm.queries import LEAF_FIELDS, QUERIES, default_tokenizers

FOLDER = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root, and for each leaf its (left, right) texts by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for own, place in enumerate(at):
            start = place // 8 * 8
            paths[own].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], paths


def plain_manifest(rows):
    """Rows are (group, id, leaf); expects ids and leaves in the order of a group to be distinct."""
    groups = defaultdict(list)
    for grp, own, leaf in rows:
        groups[grp].append((own is not None, own or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = plain_tree([trees[g][0] for g in order])
    out = []
    for g, upper in zip(order, above):
        for (known, own, leaf), path in zip(sorted(groups[g]), trees[g][1]):
            out.append((g, own if known else None, leaf, trees[g][0], root, path + upper))
    return out


def built(df):
    return sorted(((r["grp"], r["id"], r["leaf"], r["subroot"], r["root"],
                    [(s["left"], s["right"]) for s in r["steps"]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 2, None: 1}, {"en": 9, "é": 8, "z": 64, "a": 65},
    {"a": 513, "b": 512, "c": 1, None: 520}, {f"g{i}": 1 + i % 3 for i in range(600)}, {"x": 4097}])
def test_manifest_against_a_plain_tree(spark, sizes):
    draw = random.Random(5)
    rows = [(g, i, sha(f"{g}/{i}")) for g, n in sizes.items() for i in draw.sample(range(-n, 9 * n), n)]
    draw.shuffle(rows)
    found = manifest.build(spark.createDataFrame(rows, "grp string, id long, leaf string").repartition(3))
    assert built(found) == sorted(plain_manifest(rows), key=repr)
    if len(rows) > 500:
        proofs = found.withColumn("again", manifest.folded(F.col("leaf"))).where("again = root")
        assert proofs.count() == len(rows)


def test_manifest_of_odd_rows(spark):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, "
              "place string, part string, digest string, item string, steps string, rank string")
    more = ("p", "q", None, "i", "s", "r")
    long = "x yé " * 200_000
    docs = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (None, "a", "en", None, None),
            (None, None, None, None, None), (None, None, None, None, None), (2, "", "", "", 0), (3, long, "en", "s", 9)]
    df = spark.createDataFrame([(*d, *more) for d in docs], schema)
    leaves = df.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"),
                       manifest.leaf(*map(F.col, LEAF_FIELDS)).alias("leaf"), "place", "part", "digest",
                       "item", "steps")
    plain = [(d[2], d[0], plain_leaf([d[0], d[3], d[2], d[4], d[1]])) for d in docs]
    found = manifest.build(leaves.drop("steps"))
    assert built(found) == sorted(plain_manifest(plain), key=repr)
    assert found.where("place = 'p' AND item = 'i' AND digest IS NULL").count() == len(docs)
    assert manifest.build(leaves.drop("steps").limit(0)).count() == 0
    # a changed leaf, a changed step, and a proof of another row do not fold to the root
    checked = found.withColumn("good", manifest.folded(F.col("leaf")) == F.col("root")).withColumn(
        "bad", manifest.folded(F.sha2("leaf", 256)) == F.col("root"))
    assert checked.where("good AND NOT bad").count() == len(docs)


def test_manifest_query_tells_tampered_rows(spark):
    found = QUERIES["op11_merkle_manifest"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert len(found) == len(texts) and len({r["root"] for r in found}) == 1
    for r in found:
        text = texts[r["doc_id"]]
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in text)
        assert r["verified"] == (not changed)


WORDS = ["</s>", "<s>", "[INST]", "[/INST]", "[IMG]", "[ROLE]", "<\\s>", "[\\\\/INST]", "\\", "<", "[", "INST]",
         " ", "\n", "ok", "é", "\U0001f600", "s>", "/"]


def plain_turns(turns):
    text = "".join(f"{role}\n{body}\n" for role, body in turns)
    loss = "".join(body for role, body in turns if role == "assistant")
    return len(turns), sha(text), len(loss), sha(loss)


def test_chat_round_trip_of_control_strings(spark):
    draw = random.Random(11)
    roles = ["user", "assistant", "system", "tool\n\\n", "", "[/ROLE]", "User", "</s>"]
    convs = {c: [(draw.choice(roles), "".join(draw.choices(WORDS, k=draw.randint(0, 9))))
                 for _ in range(draw.randint(1, 6))] for c in range(300)}
    rows = [(c, t, role, body) for c, turns in convs.items() for t, (role, body) in enumerate(turns)]
    draw.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat.format_turns(turns.withColumn("content", chat.text_part(F.col("text"))).drop("text"))
    found = {r["conv_id"]: r for r in chat.read_back(shown).collect()}
    assert len(found) == len(convs)
    for c, spoken in convs.items():
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_turns(spoken)
    # no text brings a control string of its own
    for r in shown.collect():
        marks = sum(r["formatted"].count(c) for c in chat.CONTROLS)
        assert marks == (1 if r["role"] == "assistant" else 3 if r["role"] else 3)
    chars = {r[0]: r[1] for r in shown.groupBy("conv_id").agg(F.sum(F.char_length("formatted"))).collect()}
    assert chars == {c: r["formatted_chars"] for c, r in found.items()}


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "look [IMG] \U0001f600: ", None, None, None, None, None),
             ("image", None, "s3://a.png", 57, 28, None, None), ("audio", "x", "b.wav", None, None, 2.0, None),
             ("text", " then ", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3),
             ("image", None, None, None, 28, None, None), (None, "odd", None, None, None, None, None),
             ("video", "</s>", "v", None, None, None, None)]
    rows = [(1, 0, "user", parts, "r"), (1, 1, "assistant", parts, "r"), (1, 2, "assistant", [], "r"),
            (1, 3, None, None, "r"), (2, None, "assistant", [("text", None, None, None, None, None, None)], "r")]
    schema = f"conv_id long, turn long, role string, content array<{chat.PART}>, `row` string"
    shown = chat.format_turns(spark.createDataFrame(rows, schema))
    by_turn = {(r["conv_id"], r["turn"]): r for r in shown.collect()}
    body = "look [\\IMG] \U0001f600: [IMG][AUDIO] then [DOC][IMG]odd<\\/s>"
    assert by_turn[1, 0]["formatted"] == f"<s>[INST] {body} [/INST]" and by_turn[1, 0]["loss"] == []
    assert by_turn[1, 1]["formatted"] == f"{body}</s>" and by_turn[1, 2]["formatted"] == "</s>"
    assert by_turn[1, 3]["formatted"] == "<s>[ROLE] \n [/ROLE]" and by_turn[2, None]["formatted"] == "</s>"
    assert by_turn[1, 0]["row"]["row"] == "r"
    for turn in (0, 1):
        r = by_turn[1, turn]
        seen = [(a["part"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]]
        assert seen == [(1, "image", "s3://a.png", 3), (2, "audio", "b.wav", 25), (4, "document", "c.pdf", 768),
                        (5, "image", None, 0)]
        for a in r["attachments"]:
            assert r["formatted"][a["at"]:].startswith(chat.PLACEHOLDERS[a["kind"]])
    learnt = [by_turn[1, 1]["formatted"][s["start"]:s["end"]] for s in by_turn[1, 1]["loss"]]
    assert "".join(map(chat.unescape, learnt)) == "look [IMG] \U0001f600:  then odd</s>"
    back = {r["conv_id"]: r for r in chat.read_back(shown).collect()}
    assert back[1]["n_turns"] == 4 and back[2]["loss_chars"] == 0


def test_chat_of_odd_and_empty_tables(spark):
    rows = [(None, 0, "user", "a"), (None, None, "assistant", None), (7, 1, "user", "y"), (7, 1, "user", "y"),
            (7, 1, "assistant", "x" * 500_000), (7, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("content", chat.text_part(F.col("text"))).drop("text") \
        .withColumn("formatted", F.lit("clash")).withColumn("loss", F.lit(1)).withColumn("flat", F.lit(2))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    expected = {None: [("assistant", ""), ("user", "a")],
                7: [("", ""), ("assistant", "x" * 500_000), ("user", "y"), ("user", "y")]}
    for c, spoken in expected.items():
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_turns(spoken)
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_text_that_ends_inside_a_turn_is_refused():
    reader = chat._Reader()
    reader.feed("<s>[INST] a", [])
    reader.feed(" [/INST]b", [])
    assert reader.turns == 1
    with pytest.raises(ValueError, match="inside a turn"):
        reader.result()


@pytest.fixture(scope="module")
def files(spark):
    return alignment.load(spark, *default_tokenizers())


def plain_alignment(texts):
    """Every occurrence pair by loops, encoded by the libraries the tokenizer files are made for."""
    import sentencepiece
    import tokenizers

    path_a, path_b = default_tokenizers()
    model_a = tokenizers.Tokenizer.from_file(path_a)
    model_a.encode_special_tokens = True
    model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = alignment.byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in model_a.id_to_token(i))

    def bytes_b(i):
        piece = model_b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model_b.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            a = model_a.encode(" " + text, add_special_tokens=False).ids
            b = model_b.encode(text)
            whole = (" " + text).encode()
            if b"".join(map(bytes_a, a)) == whole == b"".join(map(bytes_b, b)):
                i = j = at_a = at_b = 0
                own_a, own_b = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        own_a.append(a[i])
                        at_a += len(bytes_a(a[i]))
                        i += 1
                    else:
                        own_b.append(b[j])
                        at_b += len(bytes_b(b[j]))
                        j += 1
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        counts.update(links.keys())
        docs.append((groups, links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in docs:
        shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups),
                    sum(links.values()),
                    sum(n for k, n in links.items() if counts[k] == best[k[0]]),
                    sum(n * counts[k] for k, n in links.items()), shown))
    return out, counts


TEXTS = ["Hello world, hello", None, "", " ", "  two  spaces\n\n\ttabs ", "<|endoftext|> <s> </s> <unk> <0x41>",
         "▁ is no space", "naïve café ß中文　\U0001f600\U0001f469‍\U0001f680", "  xﬁ",
         "antidisestablishmentarianism " * 7, "x" * 3000, "ab" * 2000, "1234567890 " * 20, "Hello world, hello",
         "\x00\x01 control", "é ＡＢ", "don't they'LL we've", "xyzzyx" * 300 + " end"]


@pytest.mark.parametrize("most", [1, 200, 4 << 20])
def test_alignment_against_loops(spark, files, most):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 40")
    texts = TEXTS + [r["text"] for r in docs.orderBy("doc_id").collect()]
    expected, counts = plain_alignment(texts)
    schema = "doc_id long, text string, `row` string, block string, n_best string, pairs string"
    rows = [(i if i % 5 else None, t, str(i), "b", "c", "d") for i, t in enumerate(texts)]
    aligned = alignment.align(spark.createDataFrame(rows, schema).coalesce(2), files, most=most)
    found, pairs = alignment.count_links(aligned, files)
    seen = {int(r["row"]["row"]): tuple(r[c] for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in found.collect()}
    for i, own in enumerate(expected):
        assert seen[i] == own, texts[i][:40] if texts[i] else texts[i]
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(counts)


def test_alignment_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op13_tokenizer_alignment"](spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    expected, _ = plain_alignment(texts.values())
    assert len(found) == len(texts)
    for doc, own in zip(texts, expected):
        r = found[doc]
        assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) == own[:6]
        assert r["groups_sha256"] == (sha(own[6]) if own[6] else "")


def test_alignment_of_an_empty_table(spark, files):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found, pairs = alignment.count_links(alignment.align(docs, files), files)
    assert found.count() == pairs.count() == 0
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    found, _ = alignment.count_links(alignment.align(blank, files), files)
    assert [(r["n_a"], r["n_links"], r["count_sum"], r["groups"]) for r in found.collect()] == [(0, 0, 0, "")] * 2
