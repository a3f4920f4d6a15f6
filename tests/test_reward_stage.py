"""The reward stage over whole completions, against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.functions import text, verify
from rillflow.operators import execute, payloads, reward_stage

MESSAGES = "rollout_id string, question string, answer string, messages array<struct<role: string, content: string, name: string, tool_calls: array<struct<name: string, arguments: string>>>>, env_reward string"
FENCE = "`" * 3
SUM = "Solve this cryptarithm:\n\n  AB\n+ BA\n-----\n CC\n\nEach letter stands for a digit."
ASKED = "How many cows are there in the second field now?"


def said(content, *calls, role="assistant", name=None):
    return {"role": role, "content": content, "name": name, "tool_calls": [{"name": n, "arguments": a if isinstance(a, (str, type(None))) else json.dumps(a)} for n, a in calls]}


def fenced(kind, body):
    return f"{FENCE}{kind}\n{body}\n{FENCE}"


#: name: (question, answer, messages, correctness, usage, format, spam, python, json, step 1, step 2)
CASES = {
    "equal": (ASKED, "4", [said("final answer : 4")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    "boxed, the last one never closes": (ASKED, "4", [said("\\boxed{4} and \\boxed{5")], 2.0, 0.0, 0.5, -0.5, 0.0, 0.0, 0.0, 0.0),
    "on the next line": (ASKED, "1/2", [said("<think>FINAL_ANSWER: 9</think> FINAL_ANSWER:\n1/2")], 2.0, 0.0, 0.5, -0.5, 0.0, 0.0, 0.0, 0.0),
    "tagged": (ASKED, "4", [said("<answer> 4 </answer>")], 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "judge says yes": (ASKED, "x + 1", [said("FINAL_ANSWER: 1 + x")], 1.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    "judge says no": (ASKED, "x + 1", [said("FINAL_ANSWER: x + 2")], 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    "no answer": (ASKED, "4", [said("it is 4")], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "no truth": (ASKED, " ** ", [said("FINAL_ANSWER: 4")], 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    "word sum": (SUM, "A=1, B=2, C=3", [said("FINAL_ANSWER: A=2,B=1,C=3")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    "knights": (None, "Ann is a knight, Bob is a knave", [said("FINAL_ANSWER: Bob is a knave and Ann is a Knight!")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    "another question": (ASKED, "4", [said("", ("call_tool", {"question": "How many sheep are there?"})), said("FINAL_ANSWER: 4")], 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.5),
    "the question in other words": (ASKED, "4", [said("", ("call_tool", {"arguments": {"problem_text": "Please say: " + ASKED}})), said("FINAL_ANSWER: 4")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.5),
    "two tools": (ASKED, "4", [said("", ("create_tool", {"code": "def f():\n    return 4"}), ("call_tool", {"schema": {"a": 1}})), said("4", role="tool", name="call_tool"), said("FINAL_ANSWER: 4")], 2.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0, 1.0),
    "code fails": (ASKED, "4", [said("", ("create_tool", {"code": "raise ValueError"})), said("FINAL_ANSWER: 4")], 2.0, 0.3, 0.5, 0.0, 0.0, 0.0, 0.5, 0.0),
    "code does not parse": (ASKED, "4", [said("", ("create_tool", {"code": "def f(: pass"})), said("FINAL_ANSWER: 4")], 2.0, 0.3, 0.5, 0.0, -1.0, 0.0, 0.0, 0.0),
    "arguments do not parse": (ASKED, "4", [said("", ("create_tool", "{bad"), ("call_tool", "{bad")), said("FINAL_ANSWER: 4")], 2.0, 1.0, 0.5, 0.0, 0.0, -1.0, 0.0, 0.0),
    "arguments are no object": (ASKED, "4", [said("", ("call_tool", "[1]"), ("call_tool", None)), said("FINAL_ANSWER: 4")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
    "schemas": (ASKED, "4", [said("", ("call_tool", {"schema": "{bad", "json_schema": 3, "tool_schema": None, "arguments": "[1"})), said("FINAL_ANSWER: 4")], 2.0, 0.0, 0.5, 0.0, 0.0, -1.5, 0.0, 0.5),
    "schema as a text": (ASKED, "4", [said("", ("call_tool", {"json_schema": '{"a": 1}'})), said("FINAL_ANSWER: 4")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0),
    "blocks": (ASKED, "4", [said('<tool_call>{"code": "x = ("}</tool_call><tool_call> {bad} </tool_call>\n' + fenced("python", "x = (") + "\n" + fenced("json", "{") + "\nFINAL_ANSWER: 4")], 2.0, 0.0, 0.5, 0.0, -2.0, -1.0, 0.0, 0.0),
    "fences": (ASKED, "4", [said(fenced("python", "x = 1") + "\n" + fenced("json", '{"schema": {}}') + "\nFINAL_ANSWER: 4")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0, 1.0),
    "spam": (ASKED, "4", [said("FINAL_ANSWER: 4\n" * 7)], 2.0, 0.0, 0.5, -2.0, 0.0, 0.0, 0.0, 0.0),
    "nothing": (ASKED, "4", [], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "after a tool response": (ASKED, "4", [said("FINAL_ANSWER: 9 </tool_response> FINAL_ANSWER: 4", role="user")], 2.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0),
}
NAMES = ("correctness_reward", "tool_usage_reward", "format_reward", "final_answer_spam_penalty", "tool_python_syntax_penalty", "tool_json_schema_penalty", "step1", "step2")


@pytest.fixture(scope="module")
def table(spark):
    judge = execute.FunctionClient(lambda texts: ["Yes." if "1 + x" in t else "<think>yes?</think>No." for t in texts])
    rows = [(n, c[0], c[1], c[2], {"equal": "0.25", "spam": "none"}.get(n)) for n, c in CASES.items()]
    return {r["rollout_id"]: r for r in reward_stage.reward_table(spark.createDataFrame(rows, MESSAGES), judge).collect()}


@pytest.mark.parametrize("case", list(CASES))
def test_every_reward(table, case):
    got, want = table[case], dict(zip(NAMES, CASES[case][3:], strict=True))
    assert {n: got[n] for n in NAMES} == want
    assert got["tool_syntax_schema_penalty"] == max(-2.0, want["tool_python_syntax_penalty"] + want["tool_json_schema_penalty"])
    assert got["process_renorm_reward"] == 0.5 * want["step1"] + 0.5 * want["step2"] + (want["correctness_reward"] > 0) - 1
    assert got["env_reward"] == (0.25 if case == "equal" else 0.0) and got["judge_reward"] == 0.0


def test_without_a_judge(spark):
    rows = [(n, *CASES[n][:3], None) for n in ("equal", "judge says yes")]
    got = {r["rollout_id"]: r["correctness_reward"] for r in reward_stage.correctness(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {"equal": 2.0, "judge says yes": 0.0}


def test_alignment(spark):
    """Truths that pair off, repeat, are cut, pad, or lack."""
    sizes = {"same": (3, 3), "repeat": (4, 2), "cut": (2, 5), "pad": (5, 2), "none": (2, 0)}
    done = [(b, p, f"{b}{p}") for b, (n, _) in sizes.items() for p in range(n)]
    truths = [(b, p, f"q{p}", f"a{p}") for b, (_, m) in sizes.items() for p in range(m)]
    got = reward_stage.aligned(spark.createDataFrame(done, "batch_id string, position long, rollout_id string"), spark.createDataFrame(truths, "batch_id string, position long, question string, answer string"))
    per = {}
    for r in sorted(got.collect(), key=lambda r: (r["batch_id"], r["position"])):
        per.setdefault(r["batch_id"], []).append(r["answer"])
    assert per == {"same": ["a0", "a1", "a2"], "repeat": ["a0", "a0", "a1", "a1"], "cut": ["a0", "a1"], "pad": ["a0", "a1", "a1", "a1", "a1"], "none": [None, None]}


def test_group_rewards(spark):
    rows = spark.createDataFrame([("g", "a", 2.0, -0.5), ("g", "b", 0.0, 0.0), ("h", "c", 1.0, 0.0)], "batch_id string, rollout_id string, x double, y double")
    got = {r["rollout_id"]: (r["total"], round(r["advantage"], 3)) for r in reward_stage.group_rewards(rows, {"x": 1.0, "y": 2.0}).collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, -1.0), "c": (1.0, 0.0)}


def test_word_sums(spark):
    rows = [
        (SUM, "A=1, B=2, C=3", True), (SUM, "A=1,B=2,C=4", False), (SUM, "A=1,B=1,C=2", False), (SUM, "A=1,B=2", False), (SUM, "A=1,B=2,C=3,D=4", False), (SUM, "A=x,B=2,C=3", False), (SUM, "so A=1, B=2, C=3", False), (SUM, "A=9,A=1,B=2,C=3, hello", True),
        (SUM, "A=0,B=1,C=1", False), (SUM, "A=0,B=3,C=3", False), ("no sum", "A=1", False), (None, "A=1", False), (SUM, None, False), (SUM, "", False), ("cryptarithm:\n\nAB\n\nEach letter", "A=1,B=2", False),
        ("cryptarithm:\n\n A\n+ B\n---\nCD\n\nEach letter", "A=9,B=8,C=1,D=7", True), ("cryptarithm:\n\n A\n+ B\n---\nCD\n\nEach letter", "A=1,B=2,C=0,D=3", False), ("cryptarithm:\n\n A\n+ B\n---\nCD\n\nEach letter. Leading letters may be zero", "A=1,B=2,C=0,D=3", True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, p string, want boolean")
    assert [r["i"] for r in df.where(verify.cryptarithm_solved("q", "p") != F.col("want")).collect()] == []


def test_payload_kinds(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "s": "x", "n": 1, "z": null, "l": []}',), ("{bad",), (None,)], "payload string")
    got = df.select(*[payloads.field_kind("payload", k).alias(k) for k in ("a", "s", "n", "z", "l", "missing")]).collect()
    assert tuple(got[0]) == ("object", "string", "other", None, "other", None) and set(got[1]) == set(got[2]) == {None}


def test_balanced_boxes(spark):
    cases = {"\\boxed{a{b}c}": "a{b}c", "\\boxed{1} \\boxed{2": "1", "\\boxed{\\boxed{3}}": "3", "\\boxed{x \\boxed{4": None, "none": None, "\\boxed{}": "", "}{\\boxed{5}}": "5"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(text.balanced_boxed("t")).collect()] == list(cases.values())
