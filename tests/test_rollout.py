"""A whole batch: prompts of two batches, builds run on their tests, judges, the pool, and prompts that are too long."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.functions import jsonx
from rillflow.operators import execute, pool, registry, scoring
from rillflow.plans import catalogue, rollout

FENCE = "`" * 3
TOOL = [{"type": "function", "function": {"name": "add", "description": "", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}}]


def meta(**own):
    return f"go <tool_rl_metadata>{json.dumps(own)}</tool_rl_metadata>"


def entries(spark, rows):
    """Pool rows from (category, seq, function name)."""
    made = [(c, s, 0.5, f"def {f}(x):\n    return x", json.dumps([{"name": f, "description": "", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}}}])) for c, s, f in rows]
    return spark.createDataFrame(made, "category string, seq long, quality double, code string, schema string").withColumn("tools", jsonx.tool_definitions("schema")).drop("schema")


def test_every_schema_fault():
    assert [jsonx.tools_problem(text) for text, *_ in catalogue._SCHEMAS] == [reason for _, reason, *_ in catalogue._SCHEMAS]
    assert jsonx.compat_findings([]) == jsonx.compat_findings(3) == (["#: a schema must be an object"], [])
    errors, warnings = jsonx.compat_findings({"prefixItems": [{"type": "array", "items": 4}], "patternProperties": {"^a": {"type": "string", "contentSchema": {}}}, "type": "object", "oneOf": [True, {"uniqueItems": True, "type": "array"}]})
    assert errors == ["#/oneOf[1]: uniqueItems", "#/prefixItems[0]: items must be a schema"] and warnings == ['#/patternProperties/"^a": contentSchema']
    twice = {"$defs": {f"d{i}": {"anyOf": [{"$ref": f"#/$defs/d{i + 1}"}] * 2} for i in range(40)}, "$ref": "#/$defs/d0"}
    assert jsonx.compat_findings(twice) == (["#: references unfold to too many schemas"], [])


def test_batches_do_not_mix(spark):
    tools = entries(spark, [("cata", 1, "fa"), ("catb", 1, "fb"), ("catc", 1, "fc")])
    prompts = spark.createDataFrame([("b0", 0, meta(id="cata-train-1", task_type="use", target_question="q", target_answer="1")), ("b1", 0, meta(id="catb-train-1", task_type="use", target_question="q", target_answer="1"))], "batch_id string, prompt_index long, prompt string")
    parsed = rollout.parse_prompts(prompts)
    names = lambda df: {r["batch_id"]: sorted(t["name"] for t in r["tools"]) for r in df.collect()}
    assert names(rollout.offered_tools(parsed, tools, 2, 0, 0)) == {"b0": ["fa"], "b1": ["fb"]}
    mixed = names(rollout.offered_tools(parsed, tools, 2, 1, 3))
    assert {k: len(v) for k, v in mixed.items()} == {"b0": 2, "b1": 2} and "fa" in mixed["b0"] and "fb" in mixed["b1"]


def test_distractors(spark):
    tools = entries(spark, [(f"c{i}", s, f"f{i}") for i in range(11) for s in range(3)])
    prompts = spark.createDataFrame([(b, i, f"c{i % 13}") for b in ("x", "y") for i in range(60)], "batch_id string, prompt_index long, category string")
    drawn = pool.distractors(prompts, tools, 3, 5, ["batch_id", "prompt_index"])
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, pool.distractors(prompts, tools, 3, 5, ["batch_id", "prompt_index"]).collect()))
    per: dict = {}
    for r in drawn.collect():
        per.setdefault((r["batch_id"], r["prompt_index"]), []).append(r["category"])
    assert set(per) == {(b, i) for b in ("x", "y") for i in range(60)}
    assert all(len(c) == len(set(c)) == 3 and f"c{i % 13}" not in c for (_, i), c in per.items())
    assert len({frozenset(c) for c in per.values()}) > 60  # an order of its own for each prompt
    few = pool.distractors(prompts, entries(spark, [("c0", 1, "f"), ("c1", 1, "g")]), 3, 5, ["batch_id", "prompt_index"]).groupBy("batch_id", "prompt_index").count().collect()
    assert all(r["count"] == (1 if r["prompt_index"] % 13 < 2 else 2) for r in few)


def test_builds_are_scored_and_enter_the_pool(spark, tmp_path):
    tests = [{"question": "add one to 1", "answer": "2"}, {"question": "add one to 4", "answer": "5"}]
    prompts = spark.createDataFrame([("b", i, meta(id="inc-train-1", task_type="build", tool_test_set=tests) + f" {i}") for i in range(3)], "batch_id string, prompt_index long, prompt string")

    def reply(text):
        if text.startswith("go"):
            body = "x + 1" if text.endswith("0") else "x + 2"
            return "nothing" if text.endswith("2") else f"{FENCE}python\ndef add(x):\n    return {body}\n{FENCE}\n{FENCE}json\n{json.dumps(TOOL)}\n{FENCE}"
        if "Tool result: " in text:
            return "\\boxed{" + text.rpartition("Tool result: ")[2] + "}"
        return '<tool_call>{"name": "add", "arguments": {"x": ' + text.split()[-1] + "}}</tool_call>"

    client = execute.FunctionClient(lambda texts: [reply(t) for t in texts])
    judge = execute.FunctionClient(lambda texts: [json.dumps(dict.fromkeys(jsonx.DIMENSIONS, 5)) for _ in texts])
    old = entries(spark, [("inc", 7, "old")])
    _, scored, tools = rollout.rollout(prompts, old, client, str(tmp_path), judge=judge)
    got = {r["prompt_index"]: r for r in scored.collect()}
    assert [got[i]["score"] for i in range(3)] == [2.0, 0.0, None] and [got[i]["build_eval_reward"] for i in range(3)] == [1.0, 0.0, None]
    assert got[0]["env_reward"] == 2.5 and got[1]["tool_call_count"] == got[1]["tool_success_call_count"] == 2 and got[1]["tool_success_items"] == 0
    assert got[0]["judge_reward"] == 1.0 and got[2]["step1_failure_reason"] == "missing_python_or_schema"
    assert sorted((r["category"], r["seq"], r["quality"]) for r in tools.collect()) == [("inc", 7, 0.5), ("inc", 8, 1.0)]
    _, again, _ = rollout.rollout(prompts, old, client, str(tmp_path), colocated=True, partial=0.25)
    got = {r["prompt_index"]: r for r in again.collect()}
    assert (got[0]["total_items"], got[0]["score"], got[1]["score"]) == (6, 6.0, 1.5)


def test_prompts_that_are_too_long(spark, tmp_path):
    states = spark.createDataFrame([("short", "1"), ("word " * 90, "1")], "prompt string, target_answer string").withColumns({"code": F.lit(""), "tools": F.array().cast(jsonx.TOOLS)})
    client = execute.FunctionClient(lambda texts: ["\\boxed{1}" for _ in texts])
    got = rollout.run_use(states, client, str(tmp_path), count_tokens=lambda p: F.size(F.split(p, " ")), max_model_len=100).collect()
    assert sorted((r["too_long"], r["answer"], r["correct"]) for r in got) == [(False, "1", 1), (True, None, 0)]


def test_judges_are_asked_only_what_is_open(spark):
    calls = spark.sparkContext.accumulator(0)

    def yes(texts):
        calls.add(len(texts))
        return ["<think>no</think> Yes, they are." if "0x10" in t else "no" for t in texts]

    rows = [(1, "16", "16", 1), (2, "0x10", "16", 0), (3, "15", "16", 0), (4, None, "16", 0), (5, "x", None, 0), (6, "", "16", 0)]
    use = spark.createDataFrame(rows, "k int, answer string, target_answer string, correct int").coalesce(1)
    got = {r["k"]: r["correct"] for r in scoring.judge_answers(use, execute.FunctionClient(yes)).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0} and calls.value == 2
    facts = [("def add(x):\n    return x", 1.0), ("def add(x:", None), ("def other(x):\n    return x", None), ("def add(y):\n    return y", 0.5)]
    builds = spark.createDataFrame([(i, c, json.dumps(TOOL)) for i, (c, _) in enumerate(facts)], "k int, code string, schema string").withColumn("tools", jsonx.tool_definitions("schema")).withColumn("qs", F.array(F.struct(F.lit("q").alias("question"))))
    full = execute.FunctionClient(lambda texts: [json.dumps(dict.fromkeys(jsonx.DIMENSIONS, 5)) for _ in texts])
    assert {r["k"]: r["judge_reward"] for r in scoring.judge_builds(builds, full, "qs").collect()} == {0: 1.0, 1: -0.5, 2: 0.0, 3: 0.5}
    silent = execute.FunctionClient(lambda texts: [None for _ in texts])
    assert {r["k"]: r["judge_reward"] for r in scoring.judge_builds(builds, silent, "qs").collect()} == {0: 0.0, 1: -0.5, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("n", [31, 30])
def test_the_older_half_goes(spark, n):
    rows = spark.range(n).selectExpr("id * 3 AS seq", "CAST(id AS STRING) AS session_id", "'' AS code", "'' AS function_name")
    assert sorted(r["seq"] for r in registry.evict_registry(rows, 10).collect()) == [3 * i for i in range(n // 2, n)]
