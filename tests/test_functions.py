"""Scalars against tables of inputs and expected values."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.functions import jsonx, numbers, pycode, text, verify
from rillflow.operators import pool, rewards

FENCE = "`" * 3


def each(spark, rows, schema, column):
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "i int, " + schema).coalesce(1)
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


MATCH = [
    ("5 apples", "5", False), ("7/4", "1.75", False), ("a-b", "b-a", False), ("0xbeef", "0x1234", False), ("lantern", "lectern", False), ("yes", "no", False),
    ("**12**.", "12", True), ("0x1a2b", "6699", True), ("1,000", "1000", True), ("$5", "5.0", True), ("1000000", "1000001", True), ("17 steps", "7", False), ("the answer is cat", "cat", True),
    ("concat", "cat", False), ("", "x", False), (None, "x", False), ("x", None, False), ("2*3", "23", True), ("YES", "yes", True), ("007", "7", True), ("a \\E b", "\\E", True), ("0b101", "5", True), ("-0x10", "-16", True),
]


def test_answers_match(spark):
    assert each(spark, [m[:2] for m in MATCH], "p string, g string", verify.answers_match("p", "g")) == [m[2] for m in MATCH]


def test_extractors_differ(spark):
    said = [("<think>\\boxed{0}</think> \\boxed{a{b}c} FINAL_ANSWER: **7**.\nmore",), ("no mark",), ("\\boxed{x{y{z}}}",), ("FINAL_ANSWER: \n \\box{q}",), ("<answer> k </answer>",)]
    assert each(spark, said, "t string", text.answer_boxed("t")) == ["a{b}c", None, None, None, None]
    assert each(spark, said, "t string", text.answer_box_first("t")) == ["a{b}c", None, None, "q", None]
    assert each(spark, said, "t string", text.answer_rewards("t")) == ["**7**.", None, "x{y{z}}", "\\box{q}", "k"]  # a marked answer may stand on the next line
    assert each(spark, said, "t string", text.answer_offline("t"))[:2] == ["7.", "no mark"]
    assert each(spark, said, "t string", text.answer_offline("t", keep_star=True))[0] == "**7**."


def test_blocks_and_metadata(spark):
    t = f"a\n{FENCE}python\nx = 1\n{FENCE}\n{FENCE}json\n[]\n{FENCE}"
    assert each(spark, [(t,)], "t string", text.code_blocks("t", "python")) == [["x = 1"]]
    assert each(spark, [(t,), (t + f"\n{FENCE}bash\nls\n{FENCE}",)], "t string", text.one_python_one_json("t")) == [True, False]
    m = 'go <tool_rl_metadata> {"id": "gcd-train-1"} </tool_rl_metadata> on'
    assert each(spark, [(m,), ("plain ",), ("a<tool_rl_metadata>{bad</tool_rl_metadata>b",)], "t string", text.strip_metadata("t")) == ["go  on", "plain ", "ab"]
    assert each(spark, [("gcd-train-1",), (None,), ("",), ("x",), ("-train-x",)], "t string", text.task_category("t")) == ["gcd", "unknown", "unknown", "x", ""]


def test_main_guard(spark):
    code = "def f():\n    return 1\nif __name__ == '__main__':\n    print(f())\n\n    x = 2\ny = 3"
    assert each(spark, [(code,), ("a = 1",)], "t string", text.remove_main_guard("t")) == ["def f():\n    return 1\ny = 3", "a = 1"]


def test_arguments(spark):
    df = [('{"x": 1}', ["a"]), ('{"p": 1, "q": "z"}', ["a", "b"]), ('{"a": true}', ["a", "b"]), ("[1]", ["a"]), ('{"p": 1, "q": 2}', ["a", "b", "c"]), (None, [])]
    got = each(spark, df, "raw string, e array<string>", jsonx.remap_args(jsonx.coerce_args("raw"), "e"))
    assert got == [{"a": "1"}, {"a": "1", "b": "z"}, {"a": "true"}, {}, {"p": "1", "q": "2"}, {}]


def test_judge_scores(spark):
    full = {d: 3 for d in jsonx.DIMENSIONS}
    rows = [(json.dumps(full),), (f"<think>x</think> {FENCE}json\n{json.dumps(full | {'code_clarity': 6})}\n{FENCE}",), (json.dumps({"code_clarity": 1}),), ("none",)]
    assert [x is not None for x in each(spark, rows, "t string", jsonx.judge_scores("t"))] == [True, False, False, False]
    assert each(spark, rows[:1], "t string", jsonx.overall_quality(jsonx.judge_scores("t"))) == [0.6]


COMPAT = [
    ({"type": "object", "properties": {"c": {"type": "array", "items": [{}]}}}, 1, 0), ({"type": "array", "prefixItems": [{}], "items": False}, 0, 0), ({"type": "array", "minItems": 1, "maxItems": 2}, 0, 2),
    ({"type": "array", "uniqueItems": True, "contains": {}}, 2, 0), ({"type": "object", "properties": {"a": {"type": "string"}}}, 0, 0),
    ({"$defs": {"Point": {"type": "array", "items": [{}]}}, "type": "object", "properties": {"p": {"$ref": "#/$defs/Point"}}}, 1, 0), ({"type": "array", "minItems": 1, "items": {"type": "object"}}, 0, 1),
    ({"type": "object", "if": {}, "then": {}, "else": {}}, 0, 1), ({"oneOf": [{"type": "array", "items": [{}]}]}, 1, 0), ({"$defs": {"L": {"anyOf": [{"$ref": "#/$defs/L"}]}}, "$ref": "#/$defs/L"}, 0, 0),
]


def test_schema_compat(spark):
    got = each(spark, [(json.dumps(s),) for s, _, _ in COMPAT], "t string", jsonx.schema_compat("t"))
    assert [(len(g["errors"]), len(g["warnings"])) for g in got] == [c[1:] for c in COMPAT]


def test_tool_schemas(spark):
    def tool(**k):
        return {"type": "function", "function": {"name": "f", "description": "", "parameters": {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}} | k}

    rows = [[tool()], [], {"functions": [tool()]}, [tool(name="")], [tool(parameters={"type": "object", "properties": {}, "required": ["z"]})]]
    assert [g["ok"] for g in each(spark, [(json.dumps(r),) for r in rows], "t string", jsonx.tool_schema_check("t"))] == [True, False, False, False, False]
    assert [len(g) for g in each(spark, [(json.dumps(r),) for r in rows], "t string", jsonx.tool_definitions("t"))] == [1, 0, 1, 1, 1]


def test_code_facts(spark):
    code = "def g(self, a, b):\n  def inner(z): pass\nasync def h(q): pass\nclass C:\n  def __init__(self, k): pass\n"
    ok, bad = each(spark, [(code,), ("def (",)], "t string", pycode.py_facts("t"))
    assert [(f["name"], f["kind"], f["params"]) for f in ok["functions"]][:3] == [("g", "function", ["self", "a", "b"]), ("h", "async", ["q"]), ("C", "class", ["self", "k"])]
    assert not bad["ok"] and bad["error"].startswith("code_load_error")


def test_hanoi(spark):
    df = spark.range(1, 8).select(F.col("id").cast("int").alias("d"), numbers.hanoi_moves(F.col("id")).alias("m"))
    rows = df.select("d", F.size("m").alias("n"), verify.hanoi_valid("m", "d").alias("ok"), verify.disks_of_solution("m").alias("back")).collect()
    assert all(r["ok"] and r["n"] == 2 ** r["d"] - 1 and r["back"] == r["d"] for r in rows)
    bad = [("[('A', 'C')]", "[('A', 'B'), ('A', 'C'), ('B', 'C')]"), ("[('A', 'C'), ('A', 'B'), ('C', 'B'), ('B', 'A'), ('B', 'C'), ('A', 'C')]", "[('A', 'B'), ('A', 'C'), ('B', 'C')]")]
    assert each(spark, bad, "p string, g string", verify.hanoi_match("p", "g")) == [False, True]


def test_cryptarithm(spark):
    q = "Solve: SEND + MORE = MONEY please"
    good = "S=9, E=5, N=6, D=7, M=1, O=0, R=8, Y=2"
    words, result = verify.cryptarithm_parse("q")
    holds = verify.cryptarithm_holds(words, result, verify.parse_assignments("a"))
    assert each(spark, [(q, good), (q, good.replace("9", "8")), (q, "S=x"), (q, good.replace("M=1", "M=0"))], "q string, a string", holds) == [True, False, False, False]


def test_numbers(spark):
    assert each(spark, [(26, 760), (0, 5), (17, 17), (None, 4), (-12, 18), ((1 << 61), 1 << 60)], "a long, b long", numbers.gcd("a", "b")) == [2, 5, 17, None, 6, 1 << 60]
    assert each(spark, [(26, 760), (0, 5), (None, 4), (-4, 6)], "a long, b long", numbers.lcm("a", "b")) == [9880, 0, None, 12]
    assert each(spark, [([12, 18, 30],), ([],), ([7],), ([4, None],)], "v array<long>", numbers.fold_array("v", "gcd")) == [6, None, 7, None]
    assert each(spark, [([4, 6, 10],)], "v array<long>", numbers.fold_array("v", "lcm")) == [60]
    assert each(spark, [(656,), (1,), (97,), (4,)], "n long", numbers.prime_factors("n")) == [[2, 2, 2, 2, 41], [], [97], [2, 2]]
    assert each(spark, [(1373158607,)], "n long", numbers.count_bits("n")) == [18]


def test_rewards(spark):
    rows = [(1, 0, 0.0, "a"), (1, 1, 0.3, "a"), (1, 2, 0.6, "a"), (1, 3, 0.9, "a"), (1, 4, 1.2, "a"), (0, 5, 1.5, None), (0, 5, -1.0, None)]
    df = rewards.use_rewards(spark.createDataFrame(rows, "correct int, turns int, tool_exec_raw double, answer string"))
    got = [(round(r["efficiency_multiplier"], 6), round(r["use_correct_reward"], 6), round(r["env_reward"], 6)) for r in df.collect()]
    assert got == [(1.0, 2.0, 0.0), (0.88, 1.76, 0.2), (0.76, 1.52, 0.4), (0.448, 0.896, 0.6), (0.112, 0.224, 0.8), (0.0, 0.0, 0.5), (0.0, 0.0, -1.166667)]
    assert each(spark, [(n,) for n in (0, 1, 2, 3, 5, 9)], "n int", rewards.spam_penalty_of("n")) == [0, 0, -0.5, -1.0, -2.0, -2.0]


def test_pool(spark):
    adds = spark.createDataFrame([("c", 1, 0.9), ("c", 2, 0.5), ("c", 3, 0.1), ("c", 4, 0.7)], "category string, seq long, quality double")
    kept = pool.pool_state(adds, 2)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 4]
    assert [r["seq"] for r in pool.newest(kept, 2).orderBy("rn").collect()] == [4, 1] and pool.newest(kept, 0).count() == 0


@pytest.mark.parametrize(("n", "m", "want"), [(3, 3, [0, 1, 2]), (4, 2, [0, 0, 1, 1]), (3, 2, [0, 1, 1]), (2, 0, [None, None]), (2, 5, [0, 1])])
def test_alignment(spark, n, m, want):
    df = spark.range(n).coalesce(1)
    assert [r[0] for r in df.select(rewards.align_index(F.col("id"), F.lit(n), F.lit(m))).collect()] == want
