"""A task from proposals to the full test, its logs, datasets on disk and the console's lines."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.operators import dialogue, execute
from rillflow.plans import experiment
from rillflow.sources import sinks, tasks

FENCE = "`" * 3
SCHEMA = json.dumps({"functions": [{"name": "total", "description": "", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}}]})


def chat():
    def model(messages, tools, choice):
        if messages[-1]["role"] == "tool":
            return {"content": f"FINAL_ANSWER: {messages[-1]['content']}", "prompt_tokens": 7, "completion_tokens": 2}
        if not tools:
            return {"content": "FINAL_ANSWER: 3", "prompt_tokens": 5, "completion_tokens": 2}
        a, b = messages[-1]["content"].split(" and ")
        return {"content": None, "tool_calls": [{"id": "1", "name": "total", "arguments": json.dumps({"a": int(a), "b": int(b)})}], "prompt_tokens": 6, "completion_tokens": 1}

    return dialogue.FunctionChat(model)


def proposals():
    def write(prompts):
        bodies = {0: "a + b", 1: "a - b"}
        out = []
        for p in prompts:
            n = sum(map(ord, p)) % 3
            out.append("no tool" if n == 2 else f"{FENCE}python\ndef total(a, b):\n    return {bodies[n]}\n{FENCE}\n{FENCE}json\n{SCHEMA}\n{FENCE}")
        return out

    return execute.FunctionClient(write)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, f"{i} and {i % 7 + 1}", str(i + i % 7 + 1)) for i in range(60)]
    return spark.createDataFrame(rows, "ordinal long, question string, answer string")


def test_from_proposals_to_the_full_test(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(experiment, "QUESTIONS", 4)
    sampled = experiment.samples(data, 6)
    per = {(r["attempt"], r["part"]): r["count"] for r in sampled.groupBy("attempt", "part").count().collect()}
    assert per == {(a, p): n for a in range(6) for p, n in (("reference", 10), ("test", 4))}
    assert len({tuple(sorted(r["o"])) for r in sampled.where("part = 'test'").groupBy("attempt").agg(F.collect_list("ordinal").alias("o")).collect()}) > 1
    got = experiment.run(data, data.limit(5), "gcd", proposals(), chat(), str(tmp_path / "work"), 6, artifacts=str(tmp_path / "out"))
    assert got["accuracy"] == got["validation_accuracy"] == 1.0 and got["total"] == 5
    made = sinks.read_artifacts(spark, str(tmp_path / "out/proposals"), "gcd")
    assert 0 < made.count() <= 6 and made.where("code LIKE '%a + b%'").count() > 0
    entry = spark.read.json(str(tmp_path / "out/evaluations_log")).first()
    assert entry["stats"]["correct"] and entry["stats"]["total_rounds"] == 2 and entry["round_usage"]["0"]["tool_used"] == 1 and len(entry["messages"]) == 5
    none = experiment.baseline(data, "gcd", chat(), str(tmp_path / "work"), artifacts=str(tmp_path / "out"))
    assert none["total"] == 60 and none["hit"] == sum(r["answer"] == "3" for r in data.collect())
    with pytest.raises(ValueError, match="no proposal"):
        experiment.run(data, data, "gcd", execute.FunctionClient(lambda ps: ["nothing" for _ in ps]), chat(), str(tmp_path / "other"), 2)


def test_chat_as_a_model(spark):
    got = experiment.ChatModel(chat()).generate(spark.createDataFrame([("x", 1)], "prompt string, turn int")).first()
    assert (got["prompt"], got["turn"], got["reply"]) == ("x", 1, "FINAL_ANSWER: 3")


def test_logs(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias("prompt_index"), F.lit("a|b").alias("answer"))
    assert sinks.write_event_log(df, str(tmp_path / "events"), "scored", {"prompt_index": F.col("prompt_index"), "score": F.lit(0.5)})
    got = spark.read.json(str(tmp_path / "events"))
    assert {"ts", "event", "rank", "world_size", "pid", "prompt_index", "score"} == set(got.columns) and got.count() == 3 and got.first()["pid"] > 0
    (tmp_path / "file").write_text("x")
    assert not sinks.write_event_log(df, str(tmp_path / "file/below"), "scored", {}) and not sinks.write_event_log(df, "", "scored", {})
    for _ in range(2):
        sinks.write_debug_table(df, str(tmp_path / "debug"), ["prompt_index", "answer"])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "debug")).collect()]
    assert lines.count("| prompt_index | answer |") == 1 and lines.count("| 1 | a b |") == 2
    talk = spark.createDataFrame([("use", 1, "x = 1", [("user", "hi"), ("assistant", None)]), ("use", 2, None, [])], "task_type string, prompt_index long, code string, messages array<struct<role: string, content: string>>")
    assert sinks.rollout_prints(talk, "TURN", False).count() == 0
    (line,) = [r["line"] for r in sinks.rollout_prints(talk, "TURN", True).collect()]
    assert line.startswith("===== TURN | task=use | prompt_index=1 =====\n----- TOOL PYTHON CODE -----\nx = 1") and "user:\nhi\n\nassistant:\n" in line


def test_datasets_on_disk(spark, tmp_path, capsys):
    first = tasks.write_datasets(spark, str(tmp_path), ["gcd", "cryptarithm"])
    assert {r["task"]: r["status"] for r in first.collect()} == {"gcd": "ok", "cryptarithm": "ok"}
    again = tasks.write_datasets(spark, str(tmp_path), ["gcd", "no such task"])
    assert {r["status"]: r["n"] for r in tasks.build_counts(again).collect()} == {"ok": 0, "failed": 1, "skipped": 1}
    stored = spark.read.parquet(str(tmp_path / "task=cryptarithm"))
    assert stored.where("split = 'train'").select("question").distinct().count() == 6 and stored.where("question LIKE '%EARTH%'").count() == 0
    assert tasks.main(["--list"]) == 0 and "word_ladder" in capsys.readouterr().out and tasks.tasks(spark).count() == 23
