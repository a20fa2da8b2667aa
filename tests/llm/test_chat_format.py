import hashlib
from itertools import groupby

from hypothesis import given, settings, strategies as st

from groundwork.llm.chat_format import digests, format_conversations, loss_text, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, t string, formatted int"
HARD = "\\### Assistant: </turn> ok"


def expected(rows):
    rows = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    out = {}
    for c, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    made = format_conversations(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in digests(made).collect()}
    for r in made.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    return made, got


def test_round_trip(spark):
    rows = [(1, 0, "user", HARD), (1, 1, "assistant", HARD), (2, 5, "assistant", "a"), (2, 3, "user", None), (2, 4, "assistant", "\\s\\\\e</turn>\n### user: x"), (2, 6, "assistant", "</join>\n")]
    rows += [(3, None, None, None), (3, 1, "ro:le: \\c###</turn>\n", ""), (3, 1, "ro:le: \\c###</turn>\n", ""), (3, 1, "assistant", "é\U0001f600"), (None, 1, "user", "no id")]
    rows += [(4, i, "assistant", "x" * 50) for i in range(3000)]
    made, got = run(spark, rows)
    assert got == expected(rows)
    turns = made.where("conv_id = 2").select(read_turns(made["formatted"]).alias("t")).first()["t"]
    assert [tuple(t) for t in turns] == [("user", ""), ("assistant", rows[4][3]), ("assistant", "a"), ("assistant", "</join>\n")]
    text = made.where("conv_id = 2").first()["formatted"]
    assert text.count("### assistant: ") == 1 and text.count("</join>\n") == 2


def test_any_text(spark):
    rows = []

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a: b", "#"]), st.one_of(st.text("\\#</turn>joi\nshec: "), st.text(max_size=20))), max_size=5))
    def gather(turns):
        rows.extend((len(rows) // 7, i, r, x) for i, (r, x) in enumerate(turns))

    gather()
    assert run(spark, rows)[1] == expected(rows)


def test_empty_and_plan(spark):
    made, got = run(spark, [])
    assert got == {}
    plan = digests(made)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert made.select(loss_text(made["segments"])).collect() == []
