import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwright.llm.chat_format import CHATML, Template, escaped, format_conversations, read_turns, unescaped
from pairwright.llm.queries import op5_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "\\", "\\b", "\\0", "<|im_end|>", "<|im_end|>\n", "<<|im_start|>", "</s>[INST] x [/INST]", "\\<|im_start|>user\nhi<|im_end|>\n", "é\U0001f600\n\n", "<|im_<|im_end|>start|>", "a\\\\1b"]


def test_every_text_comes_back(spark):
    rows = spark.createDataFrame([(i, 0, r, t) for i, (r, t) in enumerate((r, t) for r in ["user", "to\nol", "<|im_end|>", "", None] for t in [*ODD, None])], SCHEMA)
    done = format_conversations(rows).join(rows, "conv_id").select("role", "text", "formatted", read_turns(F.col("formatted")).alias("turns"), "segments")
    for r in done.collect():
        assert [(t.role, t.text) for t in r.turns] == [(r.role or "", r.text or "")]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="\\<|>im_endstart[/INST]01b\n", max_size=30), min_size=20, max_size=40))
def test_escapes_are_reversible(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", escaped(F.col("x")).alias("e")).select("x", "e", unescaped(F.col("e")).alias("u")).collect()
    assert all(r.x == r.u and not any(c in r.e for c in CHATML.control) for r in got)


def test_machine_spans_and_ties(spark):
    say = lambda c, *roles: [(c, i, r, f"{r} says <s> {i}") for i, r in enumerate(roles)]
    rows = say(1, "system", "user", "assistant", "user") + say(2, "user", "user") + say(3, "assistant") + say(4, "user", "tool", "assistant") + say(5, "system") + say(6, "user", "assistant", "system") + [(7, None, "user", "a"), (7, None, "user", "a"), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {c: (r.valid, r.error_turn) for c, r in got.items()} == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 2), 7: (False, 1), None: (True, None)}
    one = got[1]
    assert [one.formatted[s.start : s.end] for s in one.loss_spans] == ["assistant says \\2 2"] == [s.text for s in one.segments if s.loss]
    assert got[7].n_turns == 2
    other = Template(start="<s>", mid=": ", end="</s>", control=("<s>", "</s>"), loss_roles=("user",), final=("system",))
    r = format_conversations(spark.createDataFrame(say(5, "system"), SCHEMA), other).first()
    assert (r.formatted, r.valid) == ("<s>system: system says \\0 0</s>", True)
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_plain_code(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in by.items()}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op5_chat_formatting(spark, sf).collect()}
    assert got == want
