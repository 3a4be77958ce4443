"""Operator 9: chat formatting with Spark expressions only.

Turn structs are collected per conversation and sorted, adjacent turns of one role are merged into
one block by array functions, and the pieces are joined. Template:

    <|im_start|>ROLE<|im_sep|>TEXT<|im_more|>TEXT<|im_end|>\\n

``<|im_more|>`` stands between the texts of merged turns, so each input turn can be read back.
Control strings inside texts and roles are broken by one more backslash after their first
character; reading back removes it, whatever number of backslashes stood there before.

Defined cases: null text or role is empty; rows with a null conv_id form one conversation; turns are
ordered by turn (null first), then role, then text, so repeated rows and ties have one order; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

START, SEP, MORE, END = "<|im_start|>", "<|im_sep|>", "<|im_more|>", "<|im_end|>\n"
#: What must not stand in a text: our own marks and common marks of other templates.
_TAIL = r"(\||/?s>|/?INST\]|</?SYS>>|/?think>)"
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _TAIL, r"([<\[])\\(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(lengths: Column, size: int = 256) -> Column:
    """For each number of an array the sum of those before it. By chunks, so that a long array doesn't cost its square."""
    add = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x)
    chunks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda c: add(F.slice(a, c * size + 1, F.lit(size))))
    sums = lambda c: F.transform(c, lambda _, i: add(F.slice(c, F.lit(1), i)))

    def along(a: Column, start: Column) -> Column:
        return F.transform(a, lambda _, i: F.get(start, F.floor(i / size).cast("int")) + add(F.slice(a, F.floor(i / size).cast("int") * size + 1, i % size)))

    return _let(lengths, lambda a: _let(chunks(a), lambda c: _let(sums(c), lambda start: along(a, start))))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one: an array of (start, n) in ``turns``."""
    first = lambda i: F.when(i > 0, F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]).otherwise(F.lit(True))
    begins = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), first)
    return _let(begins, lambda s: F.transform(s, lambda x, k: F.struct(x.alias("start"), (F.coalesce(F.get(s, k + 1), F.size(turns)) - x).alias("n"))))


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length in code points of ``formatted``).

    The spans cover the escaped texts of ``loss_roles``, one span per turn; no mark lies inside.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("turn"))
    got = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))

    def made(t: Column, blocks: Column) -> Column:
        pieces = lambda b: F.transform(F.slice(t, b["start"] + 1, b["n"]), lambda x: x["text"])
        opening = lambda b: F.concat(F.lit(START), escape(F.get(t, b["start"])["role"]), F.lit(SEP))
        whole = F.array_join(F.transform(blocks, lambda b: F.concat(opening(b), F.array_join(pieces(b), MORE), F.lit(END))), "")
        # what stands before each turn's text: the end of the turn before, and what opens a block or parts two turns
        heads = F.flatten(F.transform(blocks, lambda b: F.concat(
            F.array(F.length(opening(b)) + F.when(b["start"] > 0, len(END)).otherwise(0)),
            F.array_repeat(F.lit(len(MORE)), b["n"] - 1),
        )))
        steps = F.zip_with(heads, t, lambda h, x: F.struct(h.alias("head"), F.length(x["text"]).alias("length"), x["role"].alias("role")))
        spans = _let(steps, lambda a: F.zip_with(a, _before(F.transform(a, lambda x: (x["head"] + x["length"]).cast("bigint"))), lambda x, s: F.struct((s + x["head"]).alias("start"), x["length"].cast("bigint").alias("length"), x["role"].alias("role"))))
        asked = F.filter(spans, lambda x: x["role"].isin(*loss_roles))
        return F.struct(whole.alias("formatted"), F.transform(asked, lambda x: F.struct(x["start"], x["length"])).alias("loss_spans"))

    out = _let(escaped, lambda t: _let(_blocks(t), lambda blocks: made(t, blocks)))
    return got.select("conv_id", out.alias("made")).select("conv_id", "made.formatted", "made.loss_spans")


def masked(formatted: Column, spans: Column, size: int = 4096) -> Column:
    """The texts under the spans, as they stand in ``formatted``: an array. Pieces of a fixed length are looked at, not the whole for each span."""
    whole = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def text(pieces: Column, s: Column) -> Column:
        first, last = (F.floor(x / size).cast("int") for x in (s["start"], s["start"] + F.greatest(s["length"], F.lit(1)) - 1))
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.substring(near, (s["start"] % size).cast("int") + 1, s["length"].cast("int"))

    return _let(whole, lambda pieces: F.transform(spans, lambda s: text(pieces, s)))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), one per input row, unescaped."""
    mark = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split(formatted, mark(END)), lambda b: b != "")

    def texts(block: Column) -> Column:
        parts = F.split(block, mark(SEP), 2)
        who = unescape(F.substring(parts[0], len(START) + 1, 1 << 30))
        return F.transform(F.split(parts[1], mark(MORE)), lambda t: F.struct(who.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, texts))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    made = format_chats(rows.unionByName(probe))
    back = made.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("back"), "loss_spans",
        F.array_join(F.transform(masked(F.col("formatted"), F.col("loss_spans")), unescape), "").alias("loss"),
    )
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("loss_spans").cast("long").alias("loss_turns"),
    )


# DuckDB: what must come back is what went in; the length of the output follows from the template.
OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
  regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?think>)', '\1\\\2\3', 'g') AS esc,
  regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?think>)', '\1\\\2\3', 'g') AS esc_role FROM rows),
a AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  count(*) FILTER (role = 'assistant') AS loss_turns,
  sum(length(esc) + CASE WHEN before IS NULL THEN 22 + length(esc_role) WHEN before = role THEN 11 ELSE 33 + length(esc_role) END) + 11 AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, loss_turns FROM a
"""
