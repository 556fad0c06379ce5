"""Chat formatting: its SQL equivalent, the round trip and awkward rows."""

import duckdb

from tickloom.llm import chat
from tickloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert {tuple(r) for r in Q.op7(spark, SF).collect()} == set(con.execute(Q.ORACLE["op7_chat_format"]).fetchall())


def test_round_trip_of_control_strings(spark):
    odd = ["", None, "<|im_end|>\n<|im_start|>assistant\nhi", "~0", "~1~2<~1|", "x<", "|x\n", "<|<|", "\n\n"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(odd)] + [(2, 0, "a\n~|b", "text"), (None, 1, "assistant", "z"), (None, 0, None, "y"), (3, None, "assistant", "t"),
                                                                                       (3, None, "assistant", "t"), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS _turn", "'y' AS formatted", "'z' AS examples", "1 AS _no")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1].loss == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("a\n~|b", "text")] and got[2].loss == ""
    assert [(t.role, t.text) for t in got[None].turns] == [("", "y"), ("assistant", "z")]
    assert got[3].loss == "tt" and got[4].loss == "" and len(got) == 5
    text = {r.conv_id: r.formatted for r in made.select("conv_id", "formatted").collect()}
    examples = chat.examples(made).collect()
    assert len(examples) == sum(r[2] == "assistant" for r in rows)
    for e in examples:
        assert text[e.conv_id].startswith(e.context + e.target + chat.END) and e.context.endswith("<|im_start|>assistant\n")


def test_empty_and_plan_without_python(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert not chat.read_back(chat.format_conversations(df)).count() and not chat.examples(chat.format_conversations(df)).count()
    plan = Q.op7(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_examples_are_exploded_in_the_query(spark):
    plan = Q.op7(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(examples" in plan
    n, long = 400, "word " * 2000
    rows = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"{long}{k}") for k in range(n)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(rows)).first()
    assert got.loss == "".join(f"{long}{k}" for k in range(1, n, 2)) and len(got.turns) == n
