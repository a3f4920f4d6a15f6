"""Streams of rollouts and the pool as keyed state: equal to the batch fold, across restarts, repeats and new fields."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.functions import jsonx
from rillflow.operators import execute, metrics, pool
from rillflow.plans import rollout
from rillflow.streaming import pool_keeper, rollout_stream

FENCE = "`" * 3
TOOL = "[" + json.dumps({"type": "function", "function": {"name": "add", "description": "", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}}) + "]"


def additions(spark, rows):
    """(category, batch, pos, quality, cap)"""
    made = [(c, b, p, q, f"def f{p}(x):\n    return {b}", [(f"f{p}", "d", "{}")], cap) for c, b, p, q, cap in rows]
    return spark.createDataFrame(made, pool_keeper.ADDITION)


def batch_fold(rows, default):
    """category -> [(seq, quality, code)] and counts, in plain Python."""
    held, counts = {}, {}
    for c, b, p, q, cap in sorted(rows, key=lambda r: (r[1], r[2])):
        own, n = held.setdefault(c, []), counts.setdefault(c, [0, 0])
        if len(own) >= (default if cap is None else cap):
            own.remove(min(own, key=lambda t: (t[1] is not None, t[1] or 0.0, t[0])))
            n[1] += 1
        n[0] += 1
        own.append((n[0], q, f"def f{p}(x):\n    return {b}"))
    return held, counts


def read_pool(spark, folder):
    out = {}
    for r in pool_keeper.pool_snapshot(spark, f"{folder}/keeper").collect():
        assert r["tools"][0]["description"] == "d"
        out.setdefault(r["category"], []).append((r["seq"], r["quality"], r["code"]))
    return {c: sorted(t) for c, t in out.items()}


def test_state_equals_batch_fold_over_restarts(spark, tmp_path):
    rows = [(f"c{(k * 7) % 3}", k // 12, k % 12, None if k % 17 == 0 else (k * 37 % 23) / 10, [4, None, 2, 6][k // 12 % 4]) for k in range(96)]
    assert pool_keeper.pool_snapshot(spark, f"{tmp_path}/keeper").collect() == []
    changes = []
    for first in range(0, 8, 2):  # two batches, then the query stops and is started again
        for b in (first, first + 1):
            additions(spark, [r for r in rows if r[1] == b]).coalesce(1).write.parquet(f"{tmp_path}/in/batch={b}")
        if first == 4:  # a batch that is written again is not added again
            additions(spark, [r for r in rows if r[1] == 1]).coalesce(1).write.parquet(f"{tmp_path}/in/again=1")
        q = pool_keeper.keep_pool(pool_keeper.additions_of(spark, f"{tmp_path}/in", files=1), f"{tmp_path}/keeper", f"{tmp_path}/changes", cap=3)
        q.awaitTermination(300)
        assert q.exception() is None
        held, counts = batch_fold([r for r in rows if r[1] < first + 2], 3)
        assert read_pool(spark, tmp_path) == {c: sorted(t) for c, t in held.items()}
    changes = spark.read.parquet(f"{tmp_path}/changes")
    last = {r["category"]: (r["added"], r["evicted"], r["kept"]) for r in changes.groupBy("category").agg(F.max("added").alias("added"), F.max("evicted").alias("evicted"), F.max_by("kept", F.struct("batch", "seq")).alias("kept")).collect()}
    assert last == {c: (*counts[c], len(held[c])) for c in held}
    same = spark.createDataFrame([(c, s, q) for c, t in held.items() for s, q, _ in t], "category string, seq long, quality double")
    fixed = [r[:4] + (None,) for r in rows]
    numbered = spark.createDataFrame(fixed, "category string, batch long, pos long, quality double, cap int").selectExpr("category", "row_number() OVER (PARTITION BY category ORDER BY batch, pos) AS seq", "quality")
    assert same.count() > 0  # and with one cap for all batches the state's rule is pool_state's
    assert {(r["category"], r["seq"]) for r in pool.pool_state(numbered, 3).select("category", F.col("seq").cast("long").alias("seq")).collect()} == {(c, t[0]) for c, own in batch_fold(fixed, 3)[0].items() for t in own}


def test_tools_gain_a_field(spark, tmp_path):
    """A pool kept without tools goes on with them: tools from before have null there."""
    plain = "seq long, quality double, code string"
    for b, tool in ((0, plain), (1, pool_keeper.TOOL)):
        additions(spark, [("c", b, p, 1.0, 5) for p in range(2)]).coalesce(1).write.parquet(f"{tmp_path}/in/batch={b}")
        q = pool_keeper.keep_pool(pool_keeper.additions_of(spark, f"{tmp_path}/in"), f"{tmp_path}/keeper", f"{tmp_path}/changes{b}", tool=tool)
        q.awaitTermination(300)
        assert q.exception() is None
    got = sorted((r["seq"], r["tools"] and r["tools"][0]["name"]) for r in pool_keeper.pool_snapshot(spark, f"{tmp_path}/keeper").collect())
    assert got == [(1, None), (2, None), (3, "f0"), (4, "f1")]


def prompts(spark, batch):
    """Builds of two categories, and use prompts that only later batches' pools cover."""
    tests, rows = [{"question": "add one to 1", "answer": "2"}], []
    for i in range(6):
        own = {"id": f"inc{i % 2}-train-{i}", "task_type": "build" if i < 4 else "use", "tool_test_set": tests, "target_question": f"add one to {batch}", "target_answer": str(batch + 1)}
        rows.append((f"b{batch}", i, f"Build <tool_rl_metadata>{json.dumps(own)}</tool_rl_metadata> {4 * batch + i}"))
    return spark.createDataFrame(rows, rollout_stream.PROMPTS)


@pytest.fixture(scope="module")
def client():
    def reply(text):
        if text.startswith("Build"):
            n = int(text.split()[-1])
            return "nothing" if n % 4 == 3 else f"{FENCE}python\ndef add(x):\n    return x + {1 if n % 4 else 2}\n{FENCE}\n{FENCE}json\n{TOOL}\n{FENCE}"
        if "Tool result: " in text:
            return "\\boxed{" + text.rpartition("Tool result: ")[2] + "}"
        return '<tool_call>{"name": "add", "arguments": {"x": ' + text.split()[-1] + "}}</tool_call>"

    return execute.FunctionClient(lambda texts: [reply(t) for t in texts])


def test_stream_of_rollouts_equals_batches_in_turn(spark, tmp_path, client):
    folder, source = str(tmp_path / "stream"), str(tmp_path / "prompts")
    for batches in ((0, 1), (2,)):  # stopped after two, then started again from its checkpoint
        for b in batches:
            prompts(spark, b).coalesce(1).write.mode("append").parquet(source)
        q = rollout_stream.rollout_stream(rollout_stream.prompts_of(spark, source), client, folder, cap=2)
        q.awaitTermination(600)
        assert q.exception() is None
    tools = spark.createDataFrame([], f"category string, seq long, quality double, code string, tools {jsonx.TOOLS.simpleString()}")
    names = ["batch_id", "name", "value"]
    for b in range(3):
        used, scored, after = rollout.rollout(prompts(spark, b), tools, client, str(tmp_path / f"own{b}"))
        after = pool.add_builds(tools, scored, rollout.PROMPT, 2)
        rows = lambda df: sorted(((r["prompt_index"], r["env_reward"]) for r in df.collect()), key=repr)
        assert rows(spark.read.parquet(f"{folder}/used/batch={b}")) == rows(used)
        assert rows(spark.read.parquet(f"{folder}/builds/batch={b}")) == rows(scored)
        want = sorted(map(tuple, metrics.rollout_metrics(used, scored, after).select(names).collect()))
        assert sorted(map(tuple, spark.read.parquet(f"{folder}/metrics/batch={b}").select(names).collect())) == want
        tools = spark.createDataFrame(after.collect(), after.schema)
    kept = lambda df: sorted((r["category"], r["seq"], r["quality"], r["code"]) for r in df.collect())
    assert kept(pool_keeper.pool_snapshot(spark, f"{folder}/keeper")) == kept(tools) and tools.count() == 4
    values = {r["name"]: r["value"] for r in spark.read.parquet(f"{folder}/metrics/batch=1").collect()}
    assert values["rollout/use/pool_coverage_rate"] == 1.0 and values["rollout/pool/total_tools"] == 4.0 and values["rollout/build/step1_fail_missing_python_or_schema_rate"] == 0.25
