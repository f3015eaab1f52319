"""Chat formatting: turns of typed content parts become template text with a loss mask, and that text
is read back.

A turn's content is an array of parts (``PART``). A visitor goes through them in order: texts are
written with control strings escaped, images, audio and documents become placeholders whose reference,
place and expanded number of tokens are recorded. The template then marks the turn:

    user       <s>[INST] text [/INST]
    assistant  text</s>
    other      <s>[ROLE] name, line feed, text [/ROLE]

A control string inside a text gets a backslash behind its first sign; one that has backslashes there
gets one more. Hence texts hold no control string, and taking one backslash away is exact. The names
of other roles are written on one line, with backslash and line feed escaped first.

Every turn is formatted by itself with column expressions; a conversation's text is the text of its
rows in the order of their turns, so that no conversation has to fit a row. Reading back
goes through sorted partitions as a stream and holds one turn at a time.

Rows: null texts and roles count as empty, null or empty content as an empty text, parts of unknown
kind as their text, unknown sizes as no tokens. Rows of one turn stand in the order of role and
formatted text, null turns first; rows without a conversation are one conversation. An empty table
gives an empty one. Other columns travel in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.scratch import others

PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
# The control strings of the template and of placeholders.
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", *PLACEHOLDERS.values())

_BEHIND = "|".join(re.escape(c[1:]) for c in CONTROLS)
ESCAPE = rf"([<\[])(\\*)({_BEHIND})"
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_BEHIND})")
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]"
    r"|<s>\[ROLE\] (?P<name>.*?)\n(?P<other>.*?) \[/ROLE\]"
    r"|(?!<s>)(?P<assistant>.*?)</s>", re.DOTALL)


def escape(text: Column) -> Column:
    """The text with its control strings broken up."""
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_name(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def _role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name), flags=re.DOTALL)


def _patches(part: Column, side: int = 28) -> Column:
    return F.ceil(part["width"] / F.lit(side)) * F.ceil(part["height"] / F.lit(side))


def _seconds(part: Column, rate: float = 12.5) -> Column:
    return F.ceil(part["seconds"] * F.lit(rate))


def _pages(part: Column, each: int = 256) -> Column:
    return part["pages"] * F.lit(each)


# How many tokens stand for an attachment: image patches, pieces of sound, pages.
EXPANSIONS: dict[str, Callable[[Column], Column]] = {
    "image": _patches, "audio": _seconds, "document": _pages}


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.cast("string").alias("text"),
        *(F.lit(None).cast(t).alias(n) for n, t in (
            ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"),
            ("pages", "int")))))


_SPANS = "array<struct<start:int,end:int>>"
_RECORDS = "array<struct<part:int,kind:string,ref:string,at:int,tokens:bigint>>"
_FLAT = f"struct<body:string,texts:{_SPANS},attachments:{_RECORDS},n:int>"


def flatten(content: Column, expansions: dict[str, Callable[[Column], Column]] = EXPANSIONS) -> Column:
    """A struct of ``body``, ``texts`` (spans of escaped texts in it, in code points) and
    ``attachments`` (number of the part, kind, reference, place in the body, expanded tokens)."""
    empty = F.struct(F.lit(""), F.array().cast(_SPANS), F.array().cast(_RECORDS), F.lit(0)).cast(_FLAT)

    def visit(so_far: Column, part: Column) -> Column:
        attached = F.coalesce(part["kind"].isin(*PLACEHOLDERS), F.lit(False))
        shown = F.lit(None).cast("string")
        tokens = F.lit(None).cast("bigint")
        for kind, placeholder in PLACEHOLDERS.items():
            shown = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(shown)
            tokens = F.when(part["kind"] == kind, expansions[kind](part).cast("bigint")).otherwise(tokens)
        shown = F.coalesce(shown, escape(part["text"]), F.lit(""))
        at = F.char_length(so_far["body"])
        span = F.struct(at.alias("start"), (at + F.char_length(shown)).alias("end"))
        record = F.struct(
            so_far["n"].alias("part"), part["kind"].alias("kind"), part["ref"].alias("ref"),
            at.alias("at"), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"))
        return F.struct(
            F.concat(so_far["body"], shown).alias("body"),
            F.when(attached, so_far["texts"]).otherwise(F.concat(so_far["texts"], F.array(span))).alias("texts"),
            F.when(attached, F.concat(so_far["attachments"], F.array(record)))
            .otherwise(so_far["attachments"]).alias("attachments"),
            (so_far["n"] + 1).alias("n")).cast(_FLAT)

    return F.coalesce(F.aggregate(content, empty, visit), empty)


def format_turns(turns: DataFrame) -> DataFrame:
    """Turns (``conv_id``, ``turn``, ``role``, ``content`` and others) as template text. Per row:
    ``row`` (struct of all columns but the content), ``conv_id``, ``turn``, ``role``, ``formatted``,
    ``loss`` (spans of ``formatted`` in code points that a model learns to write) and ``attachments``
    with places in ``formatted``."""
    flat = turns.select(
        F.struct(*others(turns, "content")).alias("row"), "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), flatten(F.col("content")).alias("flat"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    flat = flat.select(
        "*",
        F.when(user, F.lit("<s>[INST] ")).when(assistant, F.lit(""))
        .otherwise(F.concat(F.lit("<s>[ROLE] "), _role_name(F.col("role")), F.lit("\n"))).alias("head"),
        F.when(user, F.lit(" [/INST]")).when(assistant, F.lit("</s>")).otherwise(F.lit(" [/ROLE]"))
        .alias("tail"))
    shift = F.char_length("head")
    return flat.select(
        "row", "conv_id", "turn", "role",
        F.concat("head", "flat.body", "tail").alias("formatted"),
        F.when(assistant, F.transform("flat.texts", lambda s: F.struct(
            (s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"))))
        .otherwise(F.array().cast(_SPANS)).alias("loss"),
        F.transform("flat.attachments", lambda a: a.withField("at", a["at"] + shift)).alias("attachments"))


class _Reader:
    """One conversation as its formatted text streams by."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def feed(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        for span in spans:
            learnt = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.rest += formatted
        at = 0
        while found := _TURN.match(self.rest, at):
            at = found.end()
            kind = found.lastgroup
            role = _role(found["name"]) if kind == "other" else kind
            self.turns += 1
            self.text.update(f"{role}\n{unescape(found[kind])}\n".encode())
        self.rest = self.rest[at:]

    def result(self) -> tuple:
        if self.rest:
            raise ValueError("the formatted text ends inside a turn")
        return (self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_READ = T.StructType([
    T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType())])


def _read(kind: pa.DataType):
    def run(batches):
        reader, current, done = None, None, []

        def rows():
            columns = list(zip(*done)) or [()] * (1 + len(_READ))
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", *_READ.names]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            ids, texts, spans = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))
            for own, text, loss in zip(ids, texts, spans):
                if reader is None or own != current:
                    if reader is not None:
                        done.append((current, *reader.result()))
                    reader, current = _Reader(), own
                reader.feed(text, loss)
            yield rows()
        if reader is not None:
            done.append((current, *reader.result()))
            yield rows()

    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from its formatted text: ``n_turns``, ``turns_sha256`` (of role, line
    feed, text, line feed for each turn), ``loss_chars`` and ``loss_sha256`` (of the text under the
    mask, unescaped) and ``formatted_chars``. A digest is one chain, so a conversation's turns go
    through one task; it holds one of them at a time."""
    kind = formatted.schema["conv_id"].dataType
    rows = (formatted.select("conv_id", "turn", "role", "formatted", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "formatted").drop("turn", "role"))
    out = T.StructType([T.StructField("conv_id", kind), *_READ])
    return rows.mapInArrow(_read(to_arrow_type(kind)), out)
