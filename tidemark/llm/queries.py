"""One query per operator on the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    alignment, bpe, chat, covertree, labelled, language, manifest, quality, toxicity, urls, warc,
)
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.substring import remove_repeated_passages
from tidemark.session import local_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_substring_dedup", r"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
        FROM documents),
    spots AS (
        SELECT doc_id, i, ws[i] AS word,
               CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS run
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
    judged AS (
        SELECT doc_id, i, word, run IS NOT NULL AND
               row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again
        FROM spots),
    cut AS (
        SELECT doc_id, i, word, bool_or(again) OVER (
            PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
        FROM judged),
    kept AS (
        SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
               string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS body
        FROM cut GROUP BY doc_id)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(body, '')) AS kept_sha256
    FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""")
def op7_substring_dedup(spark, folder):
    """Passages of 20 words or more that occur earlier in the corpus are cut out."""
    out = remove_repeated_passages(table(spark, folder, "documents"))
    return out.select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op10_minhash_near_dedup", r"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS ws
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i
              FROM docs WHERE len(ws) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
        WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM docs
        UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
    classes AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = c.doc_id AS kept
    FROM classes c LEFT JOIN sizes s ON c.doc_id = s.doc_id""")
def op10_minhash_near_dedup(spark, folder):
    """Components of documents whose five-word shingles agree to 75 percent or more."""
    return near_duplicates(table(spark, folder, "documents")).select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_decontaminate", rf"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all({LOWERED.format("text")},
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    items AS (
        SELECT item_id, ws, CAST(least(10, len(ws)) AS BIGINT) AS n
        FROM (SELECT item_id, regexp_extract_all({LOWERED.format("text")},
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
    windows AS (
        SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS run
        FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
    spots AS (
        SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS run
        FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i
              FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
    found AS (SELECT doc_id, i, s.n, item_id FROM spots s JOIN windows w
              ON s.run = w.run AND s.n = w.n),
    hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit
             FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot
                   FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found
                    WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           n_hit IS NOT NULL AS contaminated
    FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id""")
def op4_decontaminate(spark, folder):
    """Words of documents that lie in windows of benchmark items, and the items."""
    out = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op1_bpe")
def op1_bpe(spark, folder, path: str | None = None):
    """Every text's ids, and the text that decoding them gives."""
    vocabulary = bpe.load_vocabulary(spark, path or default_vocabulary())
    found = bpe.encode(table(spark, folder, "documents"), vocabulary, decoded=True)
    return found.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    """Scores from a model that learns from labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    rows = labelled.sample(docs, table(spark, folder, "labels"), "toxic")
    scored = toxicity.score(docs, toxicity.fit(rows)).select("row.doc_id", "score")
    return scored.select(
        "doc_id", labelled.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_quality")
def op3_quality(spark, folder):
    """Scores from a ranking learnt from all labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    measured = quality.measured(labelled.learnable(docs))
    rows = labelled.with_labels(measured, table(spark, folder, "labels"), "quality")
    scored = quality.score(docs, quality.fit(rows)).select("row.doc_id", "score")
    return scored.select(
        "doc_id", labelled.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op5_language_id")
def op5_language_id(spark, folder):
    """The language of each text, learnt from rows that are not held out."""
    docs = table(spark, folder, "documents")
    found = language.label(docs, language.fit(language.sample(docs)))
    return found.select(
        "row.doc_id", labelled.held_out("row.doc_id").alias("held_out"),
        F.col("lang").alias("lang_pred"), "score",
    )


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("op6_url_cascade", rf"""
    WITH parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0
                     THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
    rules(rule_host, rule_path, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
    fits AS (
        SELECT page_id, rule_host || rule_path AS rule, action,
               row_number() OVER (PARTITION BY page_id
                   ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS n
        FROM parts JOIN rules
             ON (host = rule_host OR ends_with(host, '.' || rule_host))
             AND starts_with(path, rule_path))
    SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND n = 1""")
def op6_url_cascade(spark, folder):
    """The rule that fits each page's url, and whether it allows or blocks."""
    rules = local_table(spark, URL_RULES, "host string, path string, action string")
    return urls.judge(table(spark, folder, "pages"), rules).select(
        "row.page_id", "host", "path", "rule", "verdict")


@query("op9_warc_captures", """
    WITH parts AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest FROM pages),
    firsts AS (
        SELECT *, CASE WHEN payload_bytes >= 100
                  THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
        FROM parts)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
    FROM firsts""")
def op9_warc_captures(spark, folder):
    """Pages written to archives, read back and assembled from their records."""
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, folder, "pages")), path)
    captures = warc.assemble(warc.read_archives(spark, path, payload=False))

    def page(metadata):
        return F.regexp_extract(F.col(metadata).getField("payload").cast("string"), "page-id: (-?[0-9]+)", 1) \
            .try_cast("long")

    return captures.select(
        page("metadata").alias("page_id"), "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", page("refers_to.metadata")).alias("refers_to"),
    )


@query("op8_cover_tree_top_k", """
    WITH parts AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(
            CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM parts q JOIN parts c ON q.vec_id % 100 = 0 AND q.vec_id != c.vec_id),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
            AS rank FROM scores)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op8_cover_tree_top_k(spark, folder):
    """The ten rows with the largest inner product for every hundredth vector."""
    vectors = covertree.usable(
        table(spark, folder, "embeddings"), "vec_id", "embedding",
        F.transform("x", lambda c: F.floor(1024 * c).cast("double")))
    return covertree.top_k(vectors, vectors.where("pmod(id, 100) = 0"), 10)


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf_sql(text: str) -> str:
    values = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


@query("op11_merkle_manifest", f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
               {_leaf_sql(f"translate(text, '{CAPITALS}', '{SMALL}')")} AS changed,
               list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)) AS signs
        FROM documents),
    judged AS (
        SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, signs),
            lambda crc, sign: list_reduce(
                list_prepend(xor(crc, sign), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
                lambda x, step: xor(x >> 1, 3988292384 * (x & 1))))) % 3 = 0 AS tampered,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
        FROM leaves),
    lower(lang, level, place, digest, beside) AS (
        SELECT lang, 0, rank, leaf, count(*) OVER (PARTITION BY lang) FROM judged
        UNION ALL
        SELECT lang, level + 1, place, digest, count(*) OVER (PARTITION BY lang)
        FROM (SELECT lang, level, place // 8 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
              FROM lower WHERE beside > 1 GROUP BY lang, level, place // 8)),
    subroots AS (
        SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
        FROM lower WHERE beside = 1),
    upper(level, place, digest, beside) AS (
        SELECT 0, place, subroot, count(*) OVER () FROM subroots
        UNION ALL
        SELECT level + 1, place, digest, count(*) OVER ()
        FROM (SELECT level, place // 8 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
              FROM upper WHERE beside > 1 GROUP BY level, place // 8)),
    nodes AS (
        SELECT 0 AS tree, lang, level, place, digest FROM lower WHERE beside > 1
        UNION ALL SELECT 1, NULL, level, place, digest FROM upper WHERE beside > 1),
    steps AS (
        SELECT tree, lang, level, place,
               string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead,
               string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind
        FROM nodes WINDOW run AS (PARTITION BY tree, lang, level, place // 8 ORDER BY place)),
    paths AS (
        SELECT j.doc_id, j.lang, j.leaf, j.rank, list([coalesce(s.ahead, ''), coalesce(s.behind, '')]
               ORDER BY s.tree, s.level) FILTER (WHERE s.level IS NOT NULL) AS path
        FROM judged j JOIN subroots r ON j.lang IS NOT DISTINCT FROM r.lang
        LEFT JOIN steps s ON (s.tree = 0 AND s.lang IS NOT DISTINCT FROM j.lang
                AND s.place = j.rank // CAST(power(8, s.level) AS BIGINT))
            OR (s.tree = 1 AND s.place = r.place // CAST(power(8, s.level) AS BIGINT))
        GROUP BY ALL)
    SELECT j.doc_id, j.leaf, r.subroot, u.digest AS root,
           sha256(list_aggregate(list_transform(coalesce(p.path, []), lambda s: s[1] || s[2]), 'string_agg', ''))
               AS proof_sha256,
           list_reduce(list_prepend([CASE WHEN tampered THEN changed ELSE j.leaf END, ''], coalesce(p.path, [])),
               lambda own, s: [sha256(s[1] || own[1] || s[2]), ''])[1] AS folded_root,
           folded_root = root AS verified
    FROM judged j JOIN paths p ON j.lang IS NOT DISTINCT FROM p.lang AND j.rank = p.rank
    JOIN subroots r ON j.lang IS NOT DISTINCT FROM r.lang
    CROSS JOIN (SELECT digest FROM upper WHERE beside = 1) u""")
def op11_merkle_manifest(spark, folder):
    """Each document's proof in the manifest, and whether a third of them, tampered with, still fits."""
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = [F.translate(c, CAPITALS, SMALL) if c == "text" else F.col(c) for c in LEAF_FIELDS]
    rows = manifest.build(docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("id"),
        manifest.leaf(*map(F.col, LEAF_FIELDS)).alias("leaf"),
        F.when(tampered, manifest.leaf(*lowered)).alias("changed")))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof().alias("proof_sha256"),
        manifest.folded(F.coalesce("changed", "leaf")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SPOKEN = "</s>[INST] ok [/INST]"


@query("op12_chat_format", rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{SPOKEN}' UNION ALL SELECT -1, 1, 'assistant', '{SPOKEN}'),
    shown AS (
        SELECT *, role = 'assistant' AS learnt, length(regexp_replace(body, '{chat.ESCAPE}', '\1\2x\3', 'g')) +
               CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('</s>')
               ELSE length('<s>[ROLE]  [/ROLE]') + 1 + length(regexp_replace(replace(replace(
                   role, '\', '\\'), chr(10), '\n'), '{chat.ESCAPE}', '\1\2x\3', 'g')) END AS chars
        FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body))
               AS turns_sha256,
           coalesce(sum(length(body)) FILTER (WHERE learnt), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE learnt), ''))
               AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM shown GROUP BY conv_id""")
def op12_chat_format(spark, folder):
    """Every conversation, and one that speaks the template's own language, formatted and read back."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    spoken = local_table(spark, [(-1, 0, "user", SPOKEN), (-1, 1, "assistant", SPOKEN)],
                         "conv_id long, turn long, role string, text string")
    turns = given.unionByName(spoken).withColumn("content", chat.text_part(F.col("text"))).drop("text")
    return chat.read_back(chat.format_turns(turns))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return default_vocabulary(), public_tokenizers.path("piece_bpe_32k.model")


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, folder, paths: tuple[str, str] | None = None):
    """Groups of two tokenizers' tokens in each document, and how common its links are."""
    files = alignment.load(spark, *(paths or default_tokenizers()))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, files).withColumn(
        "groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    found, _ = alignment.count_links(aligned.drop("groups"), files)
    return found.select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
