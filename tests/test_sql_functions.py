"""SQL functions of a session against the functions of columns that they mirror."""

import json

from pyspark.sql import functions as F

from rillflow.functions import sql_functions, text
from rillflow.operators import rewards

FENCE = "`" * 3
META = json.dumps({"id": "gcd-train-use-1", "tool_test_set": [{"question": "q1", "answer": "1"}, {"question": "q2", "answer": "2"}]})
TEXTS = [
    None, "", "plain", f"<think>\\boxed{{0}}</think> \\boxed{{a{{1}}b}} FINAL_ANSWER: x\n<tool_rl_metadata> {META} </tool_rl_metadata> rest", "\\box{ 7 } \\boxed{8}", "FINAL_ANSWER:  9 \nFINAL_ANSWER:\nend", "\\boxed{} FINAL_ANSWER: y",
    f"{FENCE}python\nx = 1\n\ny\n{FENCE}\n{FENCE}json\n{{}}\n{FENCE} {FENCE}python\nz\n{FENCE}", '<tool_call> {"name": "f", "arguments": {"x": "é"}} </tool_call><tool_call>{bad}</tool_call><tool_call>{"name": "g"}</tool_call>', "<tool_rl_metadata>{bad</tool_rl_metadata>", "<tool_rl_metadata></tool_rl_metadata> \\boxed{ 5 }",
]


def test_scalars_say_the_same(spark):
    names = sql_functions.register(spark)
    assert len(names) == len(set(names)) == len(sql_functions.register(spark))  # again, in place of the first
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = spark.sql("SELECT id, rf_answer_boxed(t) AS a, rf_answer_box_first(t) AS b, rf_task_category(t) AS c, rf_strip_metadata(t) AS d, rf_metadata(t) AS e FROM {df}", df=df)
    want = df.select("id", text.answer_boxed("t").alias("a"), text.answer_box_first("t").alias("b"), text.task_category("t").alias("c"), text.strip_metadata("t").alias("d"), F.nullif(text.meta_json("t"), F.lit("")).alias("e"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert [r for r in zip(rows(got), rows(want), strict=True) if r[0] != r[1]] == []
    numbers = spark.range(30).select((F.col("id") / 7).alias("raw"), (F.col("id") % 9).cast("double").alias("turns"))
    both = spark.sql("SELECT rf_exec_norm(raw, 5), rf_efficiency(turns, 5), raw, turns FROM {n}", n=numbers).select("*", rewards.exec_norm("raw"), rewards.efficiency("turns")).collect()
    assert all(abs(r[0] - r[4]) < 1e-12 and abs(r[1] - r[5]) < 1e-12 for r in both)


def test_tables_say_the_same(spark):
    sql_functions.register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    code = spark.sql("SELECT d.id, b.at, b.body FROM {df} d, LATERAL rf_code_blocks(d.t, 'python') b", df=df)
    assert rows(code) == rows(df.select("id", F.posexplode(text.code_blocks("t", "python")))) == [(7, 0, "x = 1\n\ny"), (7, 1, "z")]
    calls = spark.sql("SELECT d.id, c.at, c.name, c.arguments FROM {df} d, LATERAL rf_tool_calls(d.t) c", df=df)
    want = df.select("id", F.posexplode(text.tool_call_blocks("t")).alias("at", "c")).select("id", "at", F.get_json_object("c", "$.name"), F.get_json_object("c", "$.arguments"))
    assert rows(calls) == rows(want) and len(rows(calls)) == 2 and json.loads(rows(calls)[0][3]) == {"x": "é"}
    asked = spark.sql("SELECT d.id, q.question, q.answer FROM {df} d, LATERAL rf_test_questions(d.t) q", df=df)
    assert rows(asked) == [(3, "q1", "1"), (3, "q2", "2")]
    assert "Python" not in code._jdf.queryExecution().executedPlan().toString() + calls._jdf.queryExecution().executedPlan().toString()
