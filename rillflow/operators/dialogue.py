"""Questions answered over rounds by a chat model with tools: dataset evaluation, the external evaluator, the full test.

A round is a DataFrame step: the model is asked for every open conversation, its tool calls are run as rows of their own,
and their results come back as messages in order. Every round is written down, so a retried task repeats no earlier one.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rillflow.functions import jsonx, pycode, text
from rillflow.operators import evaluate, execute, metrics

CALLS = "array<struct<id: string, name: string, arguments: string>>"
MESSAGES = f"array<struct<role: string, content: string, name: string, tool_calls: {CALLS}>>"
USAGE = "array<struct<round: int, prompt_tokens: long, completion_tokens: long, tool_used: int>>"
REPLY = f"content string, tool_calls {CALLS}, prompt_tokens long, completion_tokens long, error string"
#: Rounds of a dataset's evaluation and of the external evaluator, and what its system message says.
DATASET_ROUNDS = 10
EVALUATOR_ROUNDS = 5
EVALUATOR_SYSTEM = "Use tools to solve the given question."


class ChatClient(Protocol):
    """Adds the REPLY columns to rows of (messages, tools, choice); error is null where the model answered."""

    def chat(self, rows: DataFrame) -> DataFrame: ...


class FunctionChat:
    """Asks a Python function (messages, tools, choice) -> reply dict, on the executors."""

    def __init__(self, function: Callable[[list, list, str], dict]) -> None:
        self.function = function

    def chat(self, rows: DataFrame) -> DataFrame:
        reply = StructType.fromDDL(REPLY)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = to_arrow_schema(reply)
            for batch in batches:
                said: list[dict] = []
                for messages, tools, choice in zip(*(batch.column(c).to_pylist() for c in ("messages", "tools", "choice")), strict=True):
                    try:
                        said.append(self.function([_plain(m) for m in messages], [_plain(t) for t in tools], choice))
                    except Exception as e:  # noqa: BLE001  a call that fails is a row that says so
                        said.append({"error": f"{type(e).__name__}: {e}"})
                made = [pa.array([r.get(f.name) for r in said], f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *kinds.names])

        # A row carries its reply: nothing is asked twice or joined back, so keys may be null or repeated.
        return rows.mapInArrow(ask, StructType([*rows.schema.fields, *reply.fields]))


def _plain(value: object) -> object:
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) or hasattr(value, "tolist") else value


def http_chat(base_url: str, model: str, api_key: str = "", timeout: float = 30.0, **options: object) -> FunctionChat:
    """A client of an OpenAI-compatible endpoint."""

    def ask(messages: list, tools: list, choice: str) -> dict:
        offered = [{"type": "function", "function": {"name": t["name"], "description": t.get("description") or "", "parameters": json.loads(t.get("parameters") or "{}")}} for t in tools]
        said = [{**m, "tool_calls": [{"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": c["arguments"]}} for c in m["tool_calls"]]} if m.get("tool_calls") else m for m in messages]
        body = {"model": model, "messages": said, **options, **({"tools": offered, "tool_choice": choice} if offered else {})}
        asked = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            reply = json.load(got)
        own, usage = reply["choices"][0]["message"], reply.get("usage") or {}
        calls = [{"id": c.get("id"), "name": c["function"]["name"], "arguments": c["function"]["arguments"]} for c in own.get("tool_calls") or []]
        return {"content": own.get("content"), "tool_calls": calls, "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens")}

    return FunctionChat(ask)


#: Models whose names begin so are asked by the Messages API, all others by chat completions; what a call asks for.
MESSAGES_MODELS = ("claude", "anthropic")
TEMPERATURE, MAX_TOKENS = 0.7, 8192
MESSAGES_VERSION = "2023-06-01"
CHOICES = {"auto": "auto", "required": "any", "none": "none"}


def as_blocks(messages: list[dict]) -> tuple[str, list[dict]]:
    """System text and messages of the Messages API: calls are blocks of an assistant's message, their results, in order of the
    calls, blocks of the user's message behind it."""
    system, out, open_calls = [], [], []
    for m in messages:
        if m["role"] == "system":
            system.append(m.get("content") or "")
        elif m["role"] == "tool":
            block = {"type": "tool_result", "tool_use_id": open_calls.pop(0) if open_calls else "", "content": m.get("content") or ""}
            if out and out[-1]["role"] == "user" and isinstance(out[-1]["content"], list):
                out[-1]["content"].append(block)
            else:
                out.append({"role": "user", "content": [block]})
        elif m.get("tool_calls"):
            open_calls = [c["id"] for c in m["tool_calls"]]
            text_ = [{"type": "text", "text": m["content"]}] if m.get("content") else []
            out.append({"role": "assistant", "content": text_ + [{"type": "tool_use", "id": c["id"], "name": c["name"], "input": _object(c["arguments"])} for c in m["tool_calls"]]})
        else:
            out.append({"role": m["role"], "content": m.get("content") or ""})
    return "\n\n".join(x for x in system if x), out


def _object(arguments: str | None) -> dict:
    try:
        value = json.loads(arguments or "{}")
    except ValueError:
        value = None
    return value if isinstance(value, dict) else {}


def messages_chat(base_url: str, model: str, api_key: str = "", timeout: float = 30.0, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS, **options: object) -> FunctionChat:
    """A client of a Messages API endpoint."""

    def ask(messages: list, tools: list, choice: str) -> dict:
        system, blocks = as_blocks(messages)
        offered = [{"name": t["name"], "description": t.get("description") or "", "input_schema": _object(t.get("parameters"))} for t in tools]
        body = {"model": model, "messages": blocks, "max_tokens": max_tokens, "temperature": temperature, **({"system": system} if system else {}), **options, **({"tools": offered, "tool_choice": {"type": CHOICES.get(choice, "auto")}} if offered else {})}
        headers = {"Content-Type": "application/json", "x-api-key": api_key, "anthropic-version": MESSAGES_VERSION}
        asked = urllib.request.Request(f"{base_url.rstrip('/')}/messages", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            reply = json.load(got)
        said = [b["text"] for b in reply["content"] if b.get("type") == "text"]
        calls = [{"id": b.get("id"), "name": b["name"], "arguments": json.dumps(b.get("input") or {})} for b in reply["content"] if b.get("type") == "tool_use"]
        usage = reply.get("usage") or {}
        return {"content": "".join(said) if said else None, "tool_calls": calls, "prompt_tokens": usage.get("input_tokens"), "completion_tokens": usage.get("output_tokens")}

    return FunctionChat(ask)


def model_chat(base_url: str, model: str, api_key: str = "", timeout: float = 30.0, **options: object) -> FunctionChat:
    """The client that a model's name asks for, with the published temperature unless another is given."""
    if model.startswith(MESSAGES_MODELS):
        return messages_chat(base_url, model, api_key, timeout, **options)
    return http_chat(base_url, model, api_key, timeout, **{"temperature": TEMPERATURE, **options})


def start(questions: DataFrame, system: str) -> DataFrame:
    """States from (key, question, target, code, tools); other columns are not carried."""
    first = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(CALLS).alias("tool_calls"))
    zero = F.lit(0).cast("long")
    return questions.select(
        "key", "question", "target", "code", "tools", F.array(first("system", F.lit(system)), first("user", F.col("question"))).cast(MESSAGES).alias("messages"), F.array().cast(USAGE).alias("round_usage"),
        *[zero.alias(c) for c in ("tool_calls_made", "tool_calls_successful", "tool_calls_failed")], F.array().cast("array<string>").alias("tool_names_used"),
        F.lit(None).cast("string").alias("final_answer_text"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("done"),
    )


def one_round(states: DataFrame, client: ChatClient, number: int, choice: str, timeout: float, folder: str, sandbox: str | None = None) -> DataFrame:
    """All states after one more round of those still open."""
    spark, path = states.sparkSession, f"{folder}/replies-{number}-{uuid.uuid4().hex}"
    client.chat(states.where("NOT done").drop("error").withColumn("choice", F.when(F.size("tools") > 0, F.lit(choice)).otherwise(F.lit("none")))).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    said = spark.read.parquet(path)  # asked once, read twice; a row's number holds from here on, whatever its key
    calls = said.where("error IS NULL").select("_row", "code", "tools", F.posexplode("tool_calls").alias("at", "call")).withColumns({"function": F.col("call.name"), "args": F.col("call.arguments"), "timeout": F.lit(timeout)})
    known = F.exists("tools", lambda t: t["name"] == F.col("function"))
    ran = execute.execute_jobs(calls.where(known).select("_row", "at", "code", "function", "args", "timeout"), sandbox=sandbox).select("_row", "at", "function", (F.col("status") == "Success").alias("ok"), F.when(F.col("status") == "Success", F.col("stdout")).otherwise(F.col("tool_result")).alias("content"))
    strange = calls.where(~known).select("_row", "at", "function", F.lit(False).alias("ok"), F.concat(F.lit("function : "), "function", F.lit(" does not exist")).alias("content"))
    results = ran.unionByName(strange).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "function", "ok", "content"))).alias("results"))
    rows = said.join(results, "_row", "left").withColumn("results", F.coalesce("results", F.array().cast("array<struct<at: int, function: string, ok: boolean, content: string>>")))
    fine, called = F.col("error").isNull(), F.size("results") > 0
    good = F.filter("results", lambda r: r["ok"])
    own = F.struct(F.lit("assistant").alias("role"), F.col("content"), F.lit(None).cast("string").alias("name"), "tool_calls")
    told = F.transform("results", lambda r: F.struct(F.lit("tool").alias("role"), r["content"].alias("content"), r["function"].alias("name"), F.lit(None).cast(CALLS).alias("tool_calls")))
    usage = F.struct(F.lit(number).alias("round"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"), F.size(good).alias("tool_used"))
    after = rows.select(
        "key", "question", "target", "code", "tools",
        F.when(fine, F.concat("messages", F.array(own).cast(MESSAGES), told.cast(MESSAGES))).otherwise(F.col("messages")).alias("messages"), F.when(fine, F.array_append("round_usage", usage)).otherwise(F.col("round_usage")).cast(USAGE).alias("round_usage"),
        (F.col("tool_calls_made") + F.size("results")).alias("tool_calls_made"), (F.col("tool_calls_successful") + F.size(good)).alias("tool_calls_successful"), (F.col("tool_calls_failed") + F.size("results") - F.size(good)).alias("tool_calls_failed"),
        F.array_distinct(F.concat("tool_names_used", F.transform(good, lambda r: r["function"]))).alias("tool_names_used"),
        F.when(fine & ~called, F.col("content")).alias("final_answer_text"), "error", (~fine | ~called).alias("done"),
    )
    return states.where("done").unionByName(after)


def converse(questions: DataFrame, client: ChatClient, folder: str, max_rounds: int = DATASET_ROUNDS, system: str = "", first_choice: str = "auto", timeout: float = 30.0, sandbox: str | None = None) -> DataFrame:
    """Conversations of (key, question, target, code, tools) with their statistics; an error ends a conversation."""
    spark, states = questions.sparkSession, start(questions, system)
    for number in range(max_rounds):
        path = f"{folder}/round-{number}-{uuid.uuid4().hex}"
        one_round(states, client, number, first_choice if number == 0 else "auto", timeout, folder, sandbox).write.parquet(path)
        states = spark.read.schema(states.schema).parquet(path)
        if states.where("NOT done").isEmpty():
            break
    total = lambda c: F.aggregate("round_usage", F.lit(0).cast("long"), lambda a, r: a + r[c])
    return states.withColumns({
        "total_rounds": F.size("round_usage"), "total_prompt_tokens": total("prompt_tokens"), "total_completion_tokens": total("completion_tokens"),
        "used_tools": F.col("tool_calls_successful") > 0, "conversation_length": F.size("messages"),
    }).drop("done")


def evaluate_dataset(questions: DataFrame, client: ChatClient, folder: str, task: str, system: str = "", **options: object) -> DataFrame:
    """converse's rows with `correct` by the task's own equality; a conversation without an answer is wrong, and counted."""
    rows = converse(questions, client, folder, system=system, **options).withColumn("said", F.coalesce("final_answer_text", F.lit("")))
    right = F.coalesce(evaluate.eval_equality(task, "said", "target"), F.lit(False)) & F.col("final_answer_text").isNotNull()
    return rows.withColumn("correct", right).drop("said")


def full_test(best: DataFrame, tests: DataFrame, client: ChatClient, folder: str, task: str, system: str = "", **options: object) -> tuple[DataFrame, DataFrame]:
    """(hit, total, accuracy, usage) and the log of the best tool (code, schema) of a task on its test split (ordinal, question, answer)."""
    tool = best.where(F.col("task") == task).select("code", jsonx.tool_definitions("schema").alias("tools")).limit(1)
    asked = tests.select(F.col("ordinal").alias("key"), "question", F.col("answer").alias("target")).join(F.broadcast(tool))  # one row
    log = evaluate_dataset(asked, client, folder, task, system, **options)
    return metrics.accuracy(log), log


def external_rollout(questions: DataFrame, client: ChatClient, folder: str, max_rounds: int = EVALUATOR_ROUNDS, timeout: float = 30.0, **options: object) -> DataFrame:
    """The external evaluator: a tool must be used in the first round; code that does not load is not asked about at all.

    Adds ok, extracted_answer and code_load_error to converse's rows.
    """
    rows = questions.withColumn("facts", pycode.py_facts("code"))
    lacks = F.array_except(jsonx.tool_names("tools"), pycode.function_names("facts", with_async=True))
    problem = F.when(~F.col("facts.ok"), F.col("facts.error")).when(F.size(lacks) > 0, F.concat(F.lit("missing_functions: "), F.array_join(lacks, ",")))
    rows = rows.withColumn("code_load_error", problem)
    asked = converse(rows.where("code_load_error IS NULL").drop("facts"), client, folder, max_rounds, EVALUATOR_SYSTEM, "required", timeout, **options).withColumn("code_load_error", F.lit(None).cast("string"))
    refused = converse(rows.where("code_load_error IS NOT NULL").drop("facts"), client, folder, 0, EVALUATOR_SYSTEM).join(rows.select("key", "code_load_error"), "key")
    every = asked.unionByName(refused.withColumn("error", F.col("code_load_error")))
    return every.withColumns({"ok": F.col("error").isNull(), "extracted_answer": text.answer_box_first("final_answer_text")})


def round_successes(log: DataFrame) -> DataFrame:
    """Per round: conversations that reached it, tool calls that succeeded in it, and conversations with one."""
    each = log.select(F.explode("round_usage").alias("u")).select("u.*")
    return each.groupBy("round").agg(F.count("*").alias("reached"), F.sum("tool_used").alias("tool_successes"), F.count_if(F.col("tool_used") > 0).alias("with_success"))
