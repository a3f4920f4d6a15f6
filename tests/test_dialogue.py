"""Conversations over rounds, their statistics, the external evaluator, and the connectors against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from rillflow.functions import jsonx
from rillflow.operators import dialogue, execute, metrics

SCHEMA = json.dumps([{"name": "twice", "description": "", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}}}])


def questions(spark, rows):
    return spark.createDataFrame(rows, "key long, question string, target string, code string").withColumn("tools", jsonx.tool_definitions(F.lit(SCHEMA)))


def client():
    def model(messages, tools, choice):
        """Calls the tool once (an unknown one first, where asked to), then answers with what it said."""
        last, asked = messages[-1], messages[1]["content"]
        if "crash" in asked:
            raise ValueError("no model")
        usage = {"prompt_tokens": 10 * len(messages), "completion_tokens": 3}
        if last["role"] == "user" and "plain" not in asked:
            assert choice == ("required" if messages[0]["content"] else "auto")
            names = ["other", "twice"] if "strange" in asked else ["twice"]
            return {"tool_calls": [{"id": str(i), "name": n, "arguments": '{"x": 4}'} for i, n in enumerate(names)], **usage}
        if "loop" in asked:
            return {"tool_calls": [{"id": "0", "name": "twice", "arguments": "[]"}], **usage}
        said = last["content"] if last["role"] == "tool" else "8"
        return {"content": f"so FINAL_ANSWER: {said}\n\\boxed{{{said}}}", **usage}

    return dialogue.FunctionChat(model)


ROWS = [(1, "go", "8", "def twice(x):\n    return 2 * x"), (2, "plain", "8", "def twice(x):\n    return 2 * x"), (3, "strange", "8", "def twice(x):\n    return 2 * x"), (4, "loop", "8", "def twice(x):\n    return 2 * x"), (5, "crash", "8", ""), (6, "go", "9", "def twice(x):\n    return 2 * x")]


def test_dataset_evaluation(spark, tmp_path):
    log = dialogue.evaluate_dataset(questions(spark, ROWS), client(), str(tmp_path), "none", max_rounds=4)
    got = {r["key"]: r for r in log.collect()}
    assert {k: r["total_rounds"] for k, r in got.items()} == {1: 2, 2: 1, 3: 2, 4: 4, 5: 0, 6: 2}
    assert {k: (r["tool_calls_made"], r["tool_calls_successful"], r["tool_calls_failed"]) for k, r in got.items()} == {1: (1, 1, 0), 2: (0, 0, 0), 3: (2, 1, 1), 4: (4, 1, 3), 5: (0, 0, 0), 6: (1, 1, 0)}
    assert [m["role"] for m in got[3]["messages"]] == ["system", "user", "assistant", "tool", "tool", "assistant"]
    assert got[3]["messages"][3]["content"] == "function : other does not exist" and got[3]["tool_names_used"] == ["twice"]
    assert got[1]["total_prompt_tokens"] == 20 + 40 and got[1]["total_completion_tokens"] == 6 and got[1]["conversation_length"] == 5
    assert got[5]["error"] == "ValueError: no model" and got[4]["final_answer_text"] is None
    assert {k for k, r in got.items() if r["correct"]} == {1, 2, 3}
    assert metrics.accuracy(log).first()["total"] == 6
    per = {r["round"]: (r["reached"], r["tool_successes"], r["with_success"]) for r in dialogue.round_successes(log).collect()}
    assert per == {0: (5, 4, 4), 1: (4, 0, 0), 2: (1, 0, 0), 3: (1, 0, 0)}


def test_external_rollout(spark, tmp_path):
    rows = [*ROWS[:1], (7, "go", "8", "def twice(x:"), (8, "go", "8", "def thrice(x):\n    return x"), ROWS[4][:3] + ("def twice(x):\n    return x",)]
    got = {r["key"]: r for r in dialogue.external_rollout(questions(spark, rows), client(), str(tmp_path)).collect()}
    assert got[1]["ok"] and got[1]["extracted_answer"] == "8" and got[1]["used_tools"]
    assert not got[7]["ok"] and got[7]["code_load_error"].startswith("code_load_error") and got[7]["total_rounds"] == 0
    assert got[8]["code_load_error"] == "missing_functions: twice" and got[5]["error"] == "ValueError: no model" and not got[5]["ok"]


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/run":
                ran = execute.run_code(body["code"])
                out = {"status": ran["status"], "run_result": {"stdout": ran["stdout"], "stderr": ran["stderr"]}}
            elif self.path == "/v1/chat/completions":
                tool = body["messages"][-1]["role"] == "user"
                call = [{"id": "a", "type": "function", "function": {"name": body["tools"][0]["function"]["name"], "arguments": '{"x": 21}'}}]
                out = {"choices": [{"message": {"content": None, "tool_calls": call} if tool else {"content": "FINAL_ANSWER: " + body["messages"][-1]["content"]}}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}}
            elif self.path == "/v1/messages":
                asked.append((dict(self.headers), body))
                last = body["messages"][-1]["content"]
                if isinstance(last, str):
                    content = [{"type": "text", "text": "let me see"}, {"type": "tool_use", "id": "t1", "name": body["tools"][0]["name"], "input": {"x": 21}}, {"type": "tool_use", "id": "t2", "name": "other", "input": {}}]
                else:
                    content = [{"type": "text", "text": "FINAL_ANSWER: "}, {"type": "text", "text": last[0]["content"]}]
                out = {"content": content, "usage": {"input_tokens": 7, "output_tokens": 2}}
            else:
                self.send_error(500)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    for headers, body in asked:
        assert headers["X-Api-Key"] == "k" and body["max_tokens"] == 8192 and body["temperature"] == 0.7 and body["tools"][0]["input_schema"]["type"] == "object"
    own.shutdown()


def test_connectors(spark, server, tmp_path):
    assert execute.run_in_sandbox(f"{server}/run", "def f(x):\n    return x + 1", "f", {"x": 2})["stdout"] == "3"
    assert execute.run_in_sandbox(f"{server}/none", "print(1)")["status"] == "Error"
    tool = spark.createDataFrame([("twice_task", ROWS[0][3], SCHEMA)], "task string, code string, schema string")
    tests = spark.createDataFrame([(1, "double 21", "42"), (2, "double 21", "43")], "ordinal long, question string, answer string")
    score, log = dialogue.full_test(tool, tests, dialogue.http_chat(f"{server}/v1", "m"), str(tmp_path), "twice_task", sandbox=f"{server}/run")
    assert score.first().asDict() | {"usage": 1.0} == {"hit": 1, "total": 2, "accuracy": 0.5, "usage": 1.0}
    assert {r["total_prompt_tokens"] for r in log.collect()} == {10}


BIG = 2**53


def test_keys_come_back_as_they_are(spark, tmp_path):
    """64-bit keys beside a null one, repeated ones too: through tool runs and whole conversations."""
    code = "def twice(x):\n    return 2 * x"
    rows = [(BIG + 1, "go", "8", code), (None, "go", "8", code), (BIG + 3, "plain", "8", code), (BIG + 3, "crash", "8", code)]
    asked = questions(spark, rows).coalesce(1)
    jobs = asked.select("key", "code", F.lit("twice").alias("function"), F.lit('{"x": 4}').alias("args"), F.lit(10).alias("timeout"), "tools")
    ran = execute.execute_jobs(jobs).collect()
    assert sorted(((r["key"], r["stdout"]) for r in ran), key=repr) == sorted([(BIG + 1, "8"), (None, "8"), (BIG + 3, "8"), (BIG + 3, "8")], key=repr)
    assert ran[0]["tools"][0]["name"] == "twice"
    log = dialogue.converse(asked, client(), str(tmp_path), max_rounds=3).collect()
    assert sorted((r["key"], r["question"], r["error"] is None) for r in log if r["key"]) == [(BIG + 1, "go", True), (BIG + 3, "crash", False), (BIG + 3, "plain", True)]
    assert [(r["key"], r["total_rounds"]) for r in log if r["key"] is None] == [(None, 2)]


def test_routing_by_the_models_name(spark, server, tmp_path):
    """The same conversation by the other API: calls and results as blocks, a choice of tools, usage, and an unknown tool."""
    asked = questions(spark, [(1, "double 21", "42", ROWS[0][3])])
    for model, tokens in (("claude-none", 7), ("anthropic.none", 7), ("other", 5)):
        log = dialogue.evaluate_dataset(asked, dialogue.model_chat(f"{server}/v1", model, "k"), str(tmp_path / model), "none", system="Use tools.", max_rounds=3)
        (row,) = log.collect()
        assert (row["correct"], row["final_answer_text"], row["total_prompt_tokens"], row["error"]) == (True, "FINAL_ANSWER: 42", 2 * tokens, None)
        assert row["tool_calls_made"] == (2 if tokens == 7 else 1) and row["tool_calls_successful"] == 1


def test_blocks():
    call = lambda i: {"id": f"c{i}", "name": "f", "arguments": '{"x": 1}' if i else "bad"}
    talk = [{"role": "system", "content": "S"}, {"role": "user", "content": "U"}, {"role": "assistant", "content": None, "tool_calls": [call(0), call(1)]}, {"role": "tool", "content": "r0"}, {"role": "tool", "content": None}, {"role": "assistant", "content": "done"}]
    system, blocks = dialogue.as_blocks(talk)
    assert system == "S" and [b["role"] for b in blocks] == ["user", "assistant", "user", "assistant"]
    assert blocks[1]["content"] == [{"type": "tool_use", "id": "c0", "name": "f", "input": {}}, {"type": "tool_use", "id": "c1", "name": "f", "input": {"x": 1}}]
    assert blocks[2]["content"] == [{"type": "tool_result", "tool_use_id": "c0", "content": "r0"}, {"type": "tool_result", "tool_use_id": "c1", "content": ""}]
