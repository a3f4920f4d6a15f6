"""A rollout batch as DataFrames: parse, route, gate, score builds, run use turns, reward.

The pool is read as a snapshot: tools built in a batch are visible from the next on. Turns are a driver loop of a fixed
number of steps; each step's states are written down, so a retried task repeats no model call of earlier turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import jsonx, pycode, text, verify
from rillflow.operators import execute, pool, rewards, scoring
from rillflow.operators.execute import ModelClient

PROMPT = ["batch_id", "prompt_index"]
Counter = Callable[[Column], Column]
META = "struct<id:string,task_type:string,target_question:string,target_answer:string,tool_test_set:array<struct<question:string,answer:string>>>"


def parse_prompts(prompts: DataFrame) -> DataFrame:
    """Adds meta, clean_prompt, task_type and category to (batch_id, prompt_index, prompt)."""
    meta = F.from_json(text.meta_json("prompt"), META)
    rows = prompts.withColumn("meta", meta).withColumn("clean_prompt", text.strip_metadata("prompt"))
    return rows.withColumn("task_type", text.task_type(F.col("meta")["task_type"])).withColumn("category", text.task_category(F.col("meta")["id"]))


def gate_builds(outputs: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds code, tools, reason, format_ok and the step-1 rewards to model outputs. UDFs run once per row, on parsed columns."""
    rows = outputs.withColumn("code", F.try_element_at(text.code_blocks(reply, "python"), F.lit(-1))).withColumn("schema", F.try_element_at(text.code_blocks(reply, "json"), F.lit(-1)))
    rows = rows.withColumn("format_ok", F.coalesce(text.one_python_one_json(reply), F.lit(False)))
    rows = rows.withColumn("facts", pycode.py_facts("code")).withColumn("tools", jsonx.tool_definitions("schema"))
    wrapped = F.to_json(F.transform("tools", lambda t: F.struct(F.lit("function").alias("type"), F.struct(t["name"].alias("name"), t["description"].alias("description"), F.parse_json(t["parameters"]).alias("parameters")).alias("function"))))
    rows = rows.withColumn("checked", jsonx.tool_schema_check(wrapped)).withColumn("compat", jsonx.schema_compat(F.try_element_at("tools", F.lit(1))["parameters"]))
    names, have = jsonx.tool_names("tools"), pycode.function_names("facts", with_async=True)
    reason = rewards.gate_reason(
        F.col("code").isNotNull() & F.col("schema").isNotNull() & (F.size("tools") > 0), (F.size(names) > 0) & (F.size(names) == F.size("tools")), F.size(F.array_except(names, have)) == 0,
        pycode.schema_params_covered("facts", "tools"), F.col("checked")["ok"], F.col("compat")["ok"],
    )
    rows = rows.withColumn("step1_failure_reason", reason)
    return rows.withColumn("step1", rewards.gate_rewards("step1_failure_reason", "format_ok")).select(*outputs.columns, "code", "tools", "format_ok", "step1_failure_reason", "step1.*")


def use_turn(states: DataFrame, client: ModelClient, turn: int, timeout: int = 30, count_tokens: Counter | None = None, max_model_len: int | None = None) -> DataFrame:
    """One turn of active states (prompt, code, tools, answer, tool_exec_raw, turns, tool_ok, too_long, done)."""
    short = scoring.fits("prompt", count_tokens, max_model_len)
    active = states.where(~F.col("done") & short).withColumn("turn", F.lit(turn))
    got = client.generate(active).withColumn("said", F.coalesce("reply", F.lit("")))
    got = got.withColumn("answer", text.answer_boxed("said"))
    call = F.try_element_at(text.tool_call_blocks("said"), F.lit(1))
    got = got.withColumn("function", F.coalesce(F.get_json_object(call, "$.name"), F.get_json_object(call, "$.function_name"))).withColumn("raw_args", F.get_json_object(call, "$.arguments"))
    own = F.filter("tools", lambda t: t["name"] == F.col("function"))
    args = F.to_json(jsonx.remap_args(jsonx.coerce_args("raw_args"), jsonx.param_names(own)))
    plain = F.when(F.forall(F.map_keys(jsonx.coerce_args("raw_args")), lambda k: F.array_contains(jsonx.param_names(own), k)), F.col("raw_args")).otherwise(args)
    jobs = got.where("answer IS NULL AND function IS NOT NULL").withColumn("args", plain).withColumn("timeout", F.lit(timeout))
    ran = execute.execute_jobs(jobs.select(*got.columns, "args", "timeout"))
    ran = ran.withColumn("tool_exec_raw", F.col("tool_exec_raw") + F.col("reward_delta")).withColumn("prompt", F.concat("prompt", F.lit("\n"), "said", F.lit("\n\nTool result: "), "tool_result")).withColumn("turns", F.col("turns") + 1)
    ran = ran.withColumn("tool_ok", F.col("tool_ok") + (F.col("status") == "Success").cast("int"))
    rest = got.where("answer IS NOT NULL OR function IS NULL").withColumn("done", F.lit(True))
    long = states.where(~F.col("done") & ~short).withColumn("done", F.lit(True)).withColumn("too_long", F.lit(True))
    return states.where("done").unionByName(long).unionByName(rest.select(*states.columns)).unionByName(ran.select(*states.columns))


def run_use(states: DataFrame, client: ModelClient, folder: str, max_iters: int = 5, count_tokens: Counter | None = None, max_model_len: int | None = None) -> DataFrame:
    """Turns until none is active, at most max_iters; every turn is written to `folder`."""
    spark = states.sparkSession
    rows = states.withColumns({"answer": F.lit(None).cast("string"), "tool_exec_raw": F.lit(0.0), "turns": F.lit(0), "tool_ok": F.lit(0), "too_long": F.lit(False), "done": F.lit(False)})
    for turn in range(max_iters):
        path = f"{folder}/turn-{turn}-{uuid.uuid4().hex}"
        use_turn(rows, client, turn, count_tokens=count_tokens, max_model_len=max_model_len).write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        if rows.where("NOT done").isEmpty():
            break
    return rows.withColumn("correct", F.coalesce(verify.answers_match("answer", "target_answer"), F.lit(False)).cast("int"))


def offered_tools(use: DataFrame, tools: DataFrame, max_tools: int, max_distractors: int, seed: int) -> DataFrame:
    """(batch_id, prompt_index, tools, code): for use prompts whose category the pool covers, its newest tools and some of
    other categories, merged in an order shuffled for each prompt."""
    picked = pool.newest(tools, max_tools).select("category", "seq", "code", "tools")
    own = use.select(*PROMPT, "category").join(picked, "category").select(*PROMPT, "category", "seq", "code", "tools")
    covered = own.select(*PROMPT, "category").distinct()
    others = pool.distractors(covered, tools, max_distractors, seed, PROMPT).join(tools.select("category", "seq", "code", "tools"), ["category", "seq"])
    every = own.unionByName(others.select(*own.columns))
    return pool.merge_schemas(every.withColumn("pos", F.xxhash64(F.lit(seed), *PROMPT, "category", "seq")), PROMPT)


def rollout(
    prompts: DataFrame, tools: DataFrame, client: ModelClient, folder: str, max_tools: int = 2, max_distractors: int = 0, seed: int = 0, evaluator: ModelClient | None = None, judge: ModelClient | None = None,
    partial: float = 0.0, colocated: bool = False, count_tokens: Counter | None = None, max_model_len: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(use rows with rewards, scored builds, the pool after the batch).

    prompts: (batch_id, prompt_index, prompt), where only the pair names a prompt. tools: the pool's snapshot (category, seq,
    quality, code, tools). Use prompts of covered categories go to the turns, all others build. Builds that pass the gates
    are run on their own test questions by the evaluator (the client itself, if none is given) and enter the pool if they
    score; a judge, if given, rates builds and settles answers that do not match.
    """
    parsed = parse_prompts(prompts)
    wanted = parsed.where(F.col("task_type") == "use")
    merged = offered_tools(wanted, tools, max_tools, max_distractors, seed)
    use = wanted.join(merged, PROMPT).select(*PROMPT, "category", F.col("meta")["target_question"].alias("prompt"), F.col("meta")["target_answer"].alias("target_answer"), "code", "tools")
    used = run_use(use, client, folder, count_tokens=count_tokens, max_model_len=max_model_len)
    used = rewards.use_rewards(scoring.judge_answers(used, judge) if judge else used)
    build = parsed.join(merged.select(*PROMPT), PROMPT, "left_anti").withColumn("tests", F.col("meta")["tool_test_set"]).select(*PROMPT, "category", "task_type", "tests", F.col("clean_prompt").alias("prompt"), F.lit(0).alias("turn"))
    path = f"{folder}/builds-{uuid.uuid4().hex}"
    gate_builds(client.generate(build)).write.parquet(path)  # read more than once from here on, asked and parsed once
    gated = build.sparkSession.read.parquet(path)
    questions = scoring.build_questions(gated.where("step1_failure_reason IS NULL"), "tests", PROMPT, least=scoring.LEAST_ITEMS if colocated else 1)
    answered = run_use(questions, evaluator or client, folder, count_tokens=count_tokens, max_model_len=max_model_len)
    scored = gated.join(scoring.build_evaluation(answered, PROMPT, partial, colocated), PROMPT, "left")
    scored = scored.withColumn("env_reward", F.col("env_reward") + F.coalesce("build_eval_reward", F.lit(0.0)))
    if judge:
        scored = scoring.judge_builds(scored.withColumn("schema", F.try_element_at(text.code_blocks("reply", "json"), F.lit(-1))), judge, "tests").drop("schema")
    return used, scored, pool.add_builds(tools, scored, PROMPT)
