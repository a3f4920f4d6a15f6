"""Tool sessions, payloads and penalties."""

from pyspark.sql import functions as F

from rillflow.operators import execute, payloads, registry

MESSAGES = "rollout_id string, question string, messages array<struct<role: string, content: string, name: string, tool_calls: array<struct<name: string, arguments: string>>>>"
FENCE = "`" * 3


def completions(spark):
    def said(content, calls=None, role="assistant", name=None):
        return {"role": role, "content": content, "name": name, "tool_calls": calls}

    rows = [
        ("a", "How many cows are there now?", [said("", [{"name": "create_tool", "arguments": '{"code": "def f(: pass", "question": "how many COWS are there now"}'}]), said("ok", role="tool", name="call_tool")]),
        ("b", "How many cows?", [said(f'<tool_call>{{"name": "f", "arguments": {{"question": "other"}}}}</tool_call><tool_call>{{bad}}</tool_call>\n{FENCE}json\n{{\n{FENCE}\n{FENCE}python\nx = (\n{FENCE}')]),
        ("c", None, [said("nothing")]), ("d", "q", []),
    ]
    return spark.createDataFrame(rows, MESSAGES)


def test_payloads(spark):
    df = completions(spark)
    got = sorted((r["rollout_id"], r["source"], r["invalid_json"]) for r in payloads.tool_payloads(df).collect())
    assert got == [("a", "call", False), ("b", "block", False), ("b", "block", True)]
    assert {r["rollout_id"]: r["names"] for r in payloads.tool_names(df).collect()}["a"] == ["create_tool", "call_tool"]


def test_penalties(spark):
    got = {r["rollout_id"]: (r["python_penalty"], r["json_penalty"], r["both_penalty"]) for r in payloads.penalties(completions(spark)).collect()}
    assert got["b"] == (-1.0, -1.0, -2.0) and got["c"] == got["d"] == (0.0, 0.0, 0.0)
    assert {r["rollout_id"]: r["score"] for r in payloads.step2_scores(completions(spark)).collect()} == dict.fromkeys("abcd", 0.0)  # none calls a tool


def test_shifted(spark):
    got = {r["rollout_id"]: r["shifted"] for r in payloads.shifted(completions(spark)).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_registry(spark):
    asked = spark.createDataFrame([(1, "def f(x):\n    return x + 1", "f"), (2, "def g(", "g"), (3, "def h(): pass", "other")], "seq long, code string, function_name string")
    made = registry.create_tools(asked)
    ids = {r["seq"]: r["session_id"] for r in made.collect()}
    assert len(ids[1]) == 8 and ids[2] is None and ids[3] is None
    table = registry.register(None, made)
    calls = spark.createDataFrame([(1, ids[1], '{"x": 41}'), (2, "zz", "{}"), (3, ids[1], "[1]"), (4, ids[1], '{"y": 1}')], "call_id long, session_id string, args string")
    got = {r["call_id"]: r["tool_result"] for r in registry.call_tools(calls, table).collect()}
    assert got[1] == "42" and got[2].startswith("Error: no tool") and got[3].startswith("Error: arguments") and got[4].startswith("Error:")
    many = spark.range(30).selectExpr("id AS seq", "CAST(id AS STRING) AS session_id", "'' AS code", "'' AS function_name")
    assert registry.evict_registry(many, 10).agg({"seq": "min"}).first()[0] >= 14 and registry.evict_registry(many, 30).count() == 30


def test_execution_limits():
    assert execute.run_code("while True: pass", timeout=1)["status"] == "Error"
    assert execute.run_code("def f(flag):\n    return flag", "f", {"flag": True})["stdout"] == "True"
    assert execute.run_code("import os\nprint(sorted(os.environ))")["stdout"].find("HOME") < 0



def test_jobs_are_dealt_and_apart(spark):
    """Jobs of one partition run in several places, each in a process of its own; one that ends its parent harms no other."""
    code = F.when(F.col("id") == 7, "import os\nos.kill(os.getppid(), 9)").otherwise("import builtins, os\nprint(os.getppid(), os.getpid(), hasattr(builtins, 'left'))\nbuiltins.left = 1")
    jobs = spark.range(80).coalesce(1).select("id", code.alias("code"), F.lit(None).cast("string").alias("function"), F.lit("{}").alias("args"), F.lit(10).alias("timeout"))
    rows = execute.execute_jobs(jobs).collect()
    assert sorted(r["id"] for r in rows) == list(range(80))
    assert [r["id"] for r in rows if r["status"] == "Error"] == [7]
    said = [r["stdout"].split() for r in rows if r["id"] != 7]
    assert len({x[0] for x in said}) > 1 and len({x[1] for x in said}) == 79 and {x[2] for x in said} == {"False"}


def test_ends_of_runs():
    """Return codes, exit handlers, threads and what is no UTF-8."""
    with execute.Runner() as runner:
        assert [runner.run(f"import sys\nsys.exit({x})")["status"] for x in ("", "0", "3", "'bye'")] == ["Success", "Success", "Error", "Error"]
        assert runner.run("import atexit\natexit.register(print, 'end')")["stdout"] == "end"
        assert runner.run("import threading, time\nthreading.Thread(target=lambda: (time.sleep(0.2), print('late'))).start()")["stdout"] == "late"
        assert runner.run("import sys\nsys.stdout.buffer.write(b'a\\xff')")["stdout"] == "a\ufffd"
        assert "ZeroDivisionError" in runner.run("1 / 0")["stderr"]
        assert runner.run("import time\ntime.sleep(9)", timeout=1)["stderr"] == "Execution timed out"
        assert runner.run("print(len(bytearray(1 << 30)))")["status"] == "Error"