import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm.chat import END, MORE, SEP, START, format_chats, masked, op9_chat_format, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def _texts(made):
    return {r.conv_id: r for r in made.withColumn("back", read_back(F.col("formatted"))).collect()}


def test_contract(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", said), ("assistant", said)]}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in op9_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert got[k].n_turns == len(t) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_spans_and_merging(spark):
    nasty = [START, SEP, MORE, END, "<\\|im_end|>", "<\\\\|x", "[INST]", "[\\/INST] <s></s>", "<<SYS>>", "", None, "a\nb", "é\U0001f600<", "|", "\\"]
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t, 0) for i, t in enumerate(nasty)]
    rows += [(2, None, None, "x", 0), (2, 1, "assistant", "y", 0), (2, 1, "assistant", "y", 0), (None, 0, "user<|im_sep|>", "z", 0)]
    got = _texts(format_chats(spark.createDataFrame(rows, SCHEMA)))
    assert [(t.role, t.text) for t in got[1].back] == [(r[2], r[3] or "") for r in rows[: len(nasty)]]
    assert [(t.role, t.text) for t in got[2].back] == [("", "x"), ("assistant", "y"), ("assistant", "y")]
    assert got[2].formatted == f"{START}{SEP}x{END}{START}assistant{SEP}y{MORE}y{END}"
    assert [(t.role, t.text) for t in got[None].back] == [("user<|im_sep|>", "z")]
    for r in got.values():
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert not any(m in x for x in spans for m in (START, SEP, MORE, END))
        assert len(spans) == sum(t.role == "assistant" for t in r.back)
        plain = [t.text for t in r.back if t.role == "assistant"]
        assert [len(x) >= len(p) for x, p in zip(spans, plain, strict=True)] == [True] * len(spans)
    assert format_chats(spark.createDataFrame([], SCHEMA)).isEmpty()


@given(st.lists(st.text(alphabet="<|>\\[]/INSTs im_end", max_size=12), min_size=1, max_size=4))
def test_escaping_is_reversible(texts):
    import re

    tail = r"(\||/?s>|/?INST\]|</?SYS>>|/?think>)"
    for t in texts:
        escaped = re.sub(r"([<\[])(\\*)" + tail, r"\1\\\2\3", t)
        assert re.sub(r"([<\[])\\(\\*)" + tail, r"\1\2\3", escaped) == t and START not in escaped and END not in escaped


def test_a_long_conversation(spark):
    rows = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('w ', 50) AS text")
    r = _texts(format_chats(rows))[1]
    assert len(r.back) == 3000 and len(r.loss_spans) == 1500 and r.formatted[r.loss_spans[-1].start :][:4] == "w w "


def test_the_loss_mask_covers_each_text_once(spark):
    """Spans at the ends of pieces, long and empty ones; code points beyond the first plane count one."""
    texts = ["a" * 4096, "", "\U0001f600" * 5000, "<|im_end|>\n", "b" * 4095, None, "c", "</s>" * 3000, "[INST]"]
    rows = [(k, i, "user" if (i + k) % 3 == 0 else "assistant", t, 0) for k in range(3) for i, t in enumerate(texts)] + [(9, 0, "user", "x", 0)]
    made = format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", "loss_spans", F.transform(masked(F.col("formatted"), F.col("loss_spans")), unescape).alias("texts")).collect()}
    for k in (0, 1, 2, 9):
        assert got[k].texts == [t or "" for c, _, role, t, _ in rows if c == k and role == "assistant"]
        assert all(got[k].formatted[s.start - len(m) : s.start] == m for s in got[k].loss_spans for m in [SEP if got[k].formatted[: s.start].endswith(SEP) else MORE])


def test_sums_before(spark):
    from graphloom.llm.chat import _before

    lists = [[i * i % 7 for i in range(n)] for n in (1, 2, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<bigint>")
    for x, got in df.select("x", _before(F.col("x"), 256)).collect():
        assert got == [sum(x[:i]) for i in range(len(x))]
