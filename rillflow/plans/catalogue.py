"""All queries over the driver's tables, by name, and the SQL that must give the same rows.

The tables hold no completions, so text queries build them from other columns, alike in Spark and in SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions import jsonx, logic, numbers, pycode, text, verify
from rillflow.operators import evaluate, execute, ladder, metrics, pool, rewards, rows
from rillflow.plans import rollout
from rillflow.sources import tasks as task_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- conversations ---------------------------------------------------------------------------------------------
_SAID = "concat(text, ' FINAL_ANSWER: **', CASE WHEN (conv_id + turn) % 3 = 0 THEN reverse(concat(role, '-', CAST(turn AS STRING))) ELSE upper(concat(role, '-', CAST(turn AS STRING))) END, '**.\nbye')"


@query("""
WITH c AS (SELECT role, role || '-' || CAST(turn AS VARCHAR) AS truth,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN reverse(role || '-' || CAST(turn AS VARCHAR)) ELSE upper(role || '-' || CAST(turn AS VARCHAR)) END AS said FROM conversations)
SELECT role, CAST(count(*) FILTER (WHERE lower(said) = lower(truth)) AS BIGINT) AS hit, count(*) AS total,
  round(count(*) FILTER (WHERE lower(said) = lower(truth)) / count(*)::DOUBLE, 6) AS accuracy FROM c GROUP BY role""")
def answer_accuracy(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", F.concat("role", F.lit("-"), F.col("turn").cast("string")).alias("truth"), F.expr(_SAID).alias("said"))
    c = c.withColumn("correct", verify.answers_match(text.answer_offline("said"), "truth")).withColumn("used_tools", F.lit(False))
    return metrics.accuracy(c, "role").select("role", "hit", "total", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_said, count(*) AS n_turns, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id")
def chat_last_assistant(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_said"), F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles, array_to_string(list(DISTINCT role ORDER BY role), ',') AS distinct_roles FROM conversations GROUP BY conv_id")
def chat_roles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    return c.select("conv_id", F.array_join(roles, ",").alias("roles"), F.array_join(F.array_sort(F.array_distinct(roles)), ",").alias("distinct_roles"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt, count(*) AS n_parsed FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def chatml_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    c = c.withColumn("prompt", text.chatml_render("m"))
    return c.select("conv_id", "prompt", F.size(text.chatml_messages("prompt")).cast("long").alias("n_parsed"))


@query("""
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, conv_id % 3 + 1 AS m FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN n % m = 0 THEN floor(i / (n / m)) ELSE least(i, m - 1) END AS INTEGER) AS answer_index FROM n""")
def align_answers(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count("*").over(w)).withColumn("m", F.col("conv_id") % 3 + 1)
    return c.select("conv_id", "turn", rewards.align_index(F.col("i"), F.col("n"), F.col("m")).alias("answer_index"))


@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS question, left(replace(text, chr(10), '\\n'), 240) AS preview FROM conversations")
def normalize_question(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_question("text").alias("question"), text.safe_preview("text").alias("preview"))


# ---- documents: rows, splits, dedup ----------------------------------------------------------------------------
@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rows.keep_first(d, "text", "doc_id").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, CAST(2 + (rn - 1) // 70 AS INTEGER) AS difficulty FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)")
def difficulty_bands(spark, sf_dir):
    d = rows.rank_within(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "rn")
    return d.select("doc_id", "lang", (2 + F.floor((F.col("rn") - 1) / 70)).cast("int").alias("difficulty"))


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
SELECT doc_id, source, CASE WHEN rn <= 10 THEN 'reference' ELSE 'test' END AS part FROM r WHERE rn <= 110""")
def dataset_splits(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", rn.alias("rn")).where("rn <= 110")
    return d.select("doc_id", "source", F.when(F.col("rn") <= 10, "reference").otherwise("test").alias("part"))


@query("SELECT doc_id, inputs, targets FROM (SELECT doc_id, lang AS inputs, source AS targets FROM documents)")
def alias_eval(spark, sf_dir):
    return rows.alias_eval(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("question"), F.col("source").alias("answer"))).select("doc_id", "inputs", "targets")


@query("""
WITH b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE n_chars > 400),
n AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS i FROM b GROUP BY lang),
t AS (SELECT lang, n, i, 60 * i AS room FROM n),
k AS (SELECT lang, greatest(0, least(n, room - coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take, i FROM t)
SELECT doc_id, b.lang AS lang FROM b JOIN (
  WITH RECURSIVE c AS (SELECT i, lang, least(n, 60) AS take, least(n, 60) AS kept FROM t WHERE i = 1
    UNION ALL SELECT t.i, t.lang, greatest(0, least(t.n, t.room - c.kept)), c.kept + greatest(0, least(t.n, t.room - c.kept)) FROM c JOIN t ON t.i = c.i + 1)
  SELECT lang, take FROM c) x ON b.lang = x.lang WHERE rn <= take""")
def capped_bands(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 400, F.col("source")).alias("answer"))
    return rows.cumulative_cap(d, "lang", "doc_id", 60).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 1 AND a.text = b.text) AND (doc_id % 2 = 1) IS NOT TRUE")
def cross_split_anti(spark, sf_dir):
    """The two splits are the odd ids and the rest; of the rest, the rows whose text the odd ones do not hold."""
    d = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 2 == 1, "train").otherwise("test"))
    return rows.without_overlap(d.where("split = 'test'"), d.where("split = 'train'"), "text").select("doc_id", "lang")


# ---- part: extraction and matching -----------------------------------------------------------------------------
_T3 = "```"
_COMPLETION = "concat('<think>', p_type, ' \\\\boxed{0}</think>Let me see. \\\\boxed{', p_brand, '} or \\\\boxed{a{', p_size, '}b}\nFINAL_ANSWER: **', p_name, '**.\nFINAL_ANSWER: ', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(p_size, ' ', p_brand) END, '\nbye <answer> ', p_type, ' </answer>')"
_COMPLETION_SQL = "'<think>' || p_type || ' \\boxed{0}</think>Let me see. \\boxed{' || p_brand || '} or \\boxed{a{' || p_size || '}b}' || chr(10) || 'FINAL_ANSWER: **' || p_name || '**.' || chr(10) || 'FINAL_ANSWER: ' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_size || ' ' || p_brand END || chr(10) || 'bye <answer> ' || p_type || ' </answer>'"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("said", F.expr(_COMPLETION))


@query(f"WITH s AS (SELECT *, split_part({_COMPLETION_SQL}, '</think>', 2) AS t FROM part) SELECT p_partkey, 'a{{' || p_size || '}}b' AS boxed, 'a{{' || p_size || '}}b' AS box_first, trim(regexp_extract_all(t, '(?i)FINAL[_\\s]*ANSWER\\s*:\\s*([^\\n\\r]*)', 1)[-1]) AS rewards, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_size || ' ' || p_brand END AS offline, CASE WHEN p_partkey % 4 = 0 THEN 'a{{' || p_size || '}}b' ELSE p_size || ' ' || p_brand END AS mixed FROM s")
def extract_final_answer(spark, sf_dir):
    p = _part(spark, sf_dir)
    offline = text.answer_offline("said")
    return p.select("p_partkey", text.answer_boxed("said").alias("boxed"), text.answer_box_first("said").alias("box_first"), text.answer_rewards("said").alias("rewards"), F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(offline).alias("offline"), F.coalesce(F.when(F.col("p_partkey") % 4 == 0, text.balanced_boxed("said")), offline).alias("mixed"))


@query(f"""
WITH s AS (SELECT p_partkey, repeat('final answer : x ', p_size % 8) || CASE WHEN p_size % 5 = 0 THEN 'nothing' ELSE {_COMPLETION_SQL} END AS said FROM part),
n AS (SELECT *, CAST(greatest(len(regexp_extract_all(said, '(?i)FINAL[_\\s]*ANSWER\\s*:')), len(regexp_extract_all(said, '\\\\boxed\\{{'))) AS INTEGER) AS n_tags FROM s)
SELECT p_partkey, n_tags, CASE WHEN n_tags <= 1 THEN 0.0 ELSE -least(2.0, 0.5 * (n_tags - 1)) END::DOUBLE AS penalty, CASE WHEN n_tags > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS format_bonus, array_to_string(string_split(said, '</think>')[-1:], '') AS after_think FROM n""")
def reward_spam_penalty(spark, sf_dir):
    marks = F.repeat(F.lit("final answer : x "), (F.col("p_size") % 8).cast("int"))
    p = _part(spark, sf_dir).withColumn("said", F.concat(marks, F.when(F.col("p_size") % 5 == 0, F.lit("nothing")).otherwise(F.col("said"))))
    return p.select("p_partkey", text.answer_tag_count("said").alias("n_tags"), rewards.spam_penalty("said").alias("penalty"), rewards.format_reward("said").alias("format_bonus"), text.after_think(F.col("said")).alias("after_think"))


@query("""SELECT p_partkey, 'def f(x):' || chr(10) || '    return ' || p_size AS code, '{"name": "f", "size": ' || p_size || '}' AS schema, p_partkey % 3 <> 0 AS one_each FROM part""")
def extract_fences(spark, sf_dir):
    fences = f"concat('Here:\n{_T3}python\ndef f(x):\n    return ', p_size, '\n{_T3}\nand\n{_T3}json\n{{\"name\": \"f\", \"size\": ', p_size, '}}\n{_T3}\n', CASE WHEN p_partkey % 3 = 0 THEN '{_T3}bash\nls\n{_T3}' ELSE '' END)"
    p = table(spark, sf_dir, "part").withColumn("said", F.expr(fences))
    return p.select("p_partkey", F.try_element_at(text.code_blocks("said", "python"), F.lit(-1)).alias("code"), F.try_element_at(text.code_blocks("said", "json"), F.lit(-1)).alias("schema"), text.one_python_one_json("said").alias("one_each"))


@query("""SELECT p_partkey, 'Solve ' || p_name || ' now' AS clean, CASE WHEN p_partkey % 5 = 0 THEN 'use' ELSE 'build' END AS task_type, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand WHEN 2 THEN 'unknown' ELSE '' END AS category FROM part""")
def strip_metadata(spark, sf_dir):
    ident = "CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, '-train-', p_size) WHEN 1 THEN p_brand WHEN 2 THEN '' ELSE concat('-train-', p_size) END"
    meta = f"to_json(named_struct('id', {ident}, 'task_type', CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'Build' END, 'target_answer', p_type))"
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("b").alias("batch_id"), F.col("p_partkey").alias("prompt_index"), F.concat(F.lit("Solve "), "p_name", F.lit(" now <tool_rl_metadata> "), F.expr(meta), F.lit(" </tool_rl_metadata>")).alias("prompt"))
    got = rollout.parse_prompts(p)
    return got.select("p_partkey", F.col("clean_prompt").alias("clean"), "task_type", "category")


_PRED = "CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat('**', p_size, '**.') WHEN 3 THEN concat('$', p_size, ',000') WHEN 4 THEN concat('it is ', p_brand, ' I think') WHEN 5 THEN concat('x', p_brand, 'y') WHEN 6 THEN '' WHEN 7 THEN concat(p_size, '.0') ELSE concat('0', p_size) END"
_GT = "CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN CAST(p_size AS STRING) WHEN 3 THEN concat(p_size, '000') WHEN 4 THEN p_brand WHEN 5 THEN p_brand WHEN 6 THEN p_name WHEN 7 THEN CAST(p_size AS STRING) ELSE concat(p_size, 'x') END"


@query(f"""
WITH v AS (SELECT p_partkey, {_PRED} AS pred, {_GT.replace('STRING', 'VARCHAR')} AS gt FROM part),
n AS (SELECT p_partkey, trim(regexp_replace(rtrim(trim(replace(pred, '*', ''), '"''` ' || chr(9) || chr(10)), '.'), '\\s+', ' ', 'g')) AS p, trim(gt) AS g FROM v),
d AS (SELECT *, try_cast(replace(replace(p, ',', ''), '$', '') AS DOUBLE) AS a, try_cast(g AS DOUBLE) AS b FROM n)
SELECT p_partkey, p AS normal, CASE WHEN p = '' OR g = '' THEN false ELSE p = g OR lower(p) = lower(g) OR coalesce(abs(a - b) / greatest(abs(a), abs(b), 1.0) < 1e-6, false)
  OR (length(g) <= 10 AND b IS NULL AND regexp_matches(lower(p), '(^|[^a-z0-9])' || regexp_escape(lower(g)) || '($|[^a-z0-9])')) END AS matched FROM d""")
def answers_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PRED).alias("pred"), F.expr(_GT).alias("gt"))
    return p.select("p_partkey", text.normalize_answer("pred").alias("normal"), verify.answers_match("pred", "gt").alias("matched"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || '.0|' || upper(p_brand) || '|' || p_type AS line, p_size % 2 = 0 AS same_base FROM part")
def match_integers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.concat_ws("|", F.concat(F.col("p_size").cast("string"), F.lit(".0")), F.upper("p_brand"), "p_type")
    same = verify.answers_match(F.concat(F.lit("0x"), F.hex("p_partkey")), (F.col("p_partkey") + F.col("p_size") % 2).cast("string"))
    return p.select("p_partkey", line.alias("line"), same.alias("same_base"))


# ---- events: JSON, metrics, rewards ----------------------------------------------------------------------------
@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) = 1 AS one_key FROM events")
def props_json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), (F.size(jsonx.coerce_args("props")) == 1).alias("one_key"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'n' END || '=' || json_extract_string(props, '$.k') AS args FROM events")
def props_remap_args(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("expected", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("k"), F.lit("m"))).otherwise(F.array(F.lit("n"), F.lit("m"))))
    got = F.map_entries(jsonx.remap_args(jsonx.coerce_args("props"), "expected"))
    return e.select("event_id", F.array_join(F.transform(got, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("args"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 6 OR event_id % 3 = 2 THEN NULL ELSE CAST(event_id % 7 AS DOUBLE) END AS correctness,
  CASE WHEN event_id % 7 = 6 OR event_id % 3 = 2 THEN 0.0 ELSE round((event_id % 7 + 9.0) / 20.0, 6) END::DOUBLE AS quality FROM events""")
def judge_scores(spark, sf_dir):
    reply = "concat('<think>hm</think>', CASE WHEN event_id % 3 = 2 THEN 'no json' ELSE concat('Scores: {\"code_correctness\": ', event_id % 7, ', \"code_clarity\": 3, \"schema_quality\": 2.5, \"schema_code_alignment\": 3.5, \"overall_quality\": 4}') END)"
    e = table(spark, sf_dir, "events").withColumn("scores", jsonx.judge_scores(F.expr(reply)))
    return e.select("event_id", F.col("scores")["code_correctness"].alias("correctness"), F.round(jsonx.overall_quality("scores"), 6).alias("quality"))


def _states(spark, sf_dir):
    """Rollout states from events: a user is a batch, an event type a category."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch_id"), "event_id", F.when(F.col("event_id") % 3 == 0, "build").otherwise("use").alias("task_type"), F.col("event_type").alias("category"), (F.col("event_id") % 6).cast("int").alias("num_turns"),
        F.col("value").alias("env_reward"), (F.col("event_id") % 5).alias("tool_call_count"), F.least(F.col("event_id") % 5, F.col("event_id") % 3).alias("tool_success_call_count"), (F.col("event_id") % 4 == 0).alias("pool_used"),
        F.when(F.col("event_id") % 11 == 0, F.element_at(F.array(*[F.lit(g) for g in rewards.GATES]), (F.col("event_id") % 6 + 1).cast("int"))).alias("step1_failure_reason"), (F.col("event_id") % 7 < 3).alias("final_answer_correct"),
    )


_STATES_SQL = """s AS (SELECT user_id AS batch_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'build' ELSE 'use' END AS task_type, event_type AS category, event_id % 6 AS num_turns, value AS env_reward,
  event_id % 5 AS calls, least(event_id % 5, event_id % 3) AS good, event_id % 4 = 0 AS pool_used, CASE WHEN event_id % 11 = 0 THEN event_id % 6 END AS reason, event_id % 7 < 3 AS correct FROM events)"""


@query(f"""WITH {_STATES_SQL}, w AS (SELECT batch_id, avg(num_turns) AS a, min(num_turns)::DOUBLE AS b, max(num_turns)::DOUBLE AS c, avg(env_reward) FILTER (WHERE task_type = 'build') AS d,
  avg(env_reward) FILTER (WHERE task_type = 'use') AS e, avg(CASE WHEN calls = 0 THEN 0 ELSE good / calls END) FILTER (WHERE task_type = 'build') AS f,
  avg(correct::INT) FILTER (WHERE task_type = 'use') AS g, count(*) FILTER (WHERE task_type = 'use' AND pool_used) / nullif(count(*) FILTER (WHERE task_type = 'use'), 0) AS h,
  count(*) FILTER (WHERE task_type = 'build' AND reason IS NOT NULL) / nullif(count(*) FILTER (WHERE task_type = 'build'), 0) AS i, count(*) FILTER (WHERE task_type = 'use' AND reason IS NOT NULL) / nullif(count(*) FILTER (WHERE task_type = 'use'), 0) AS j,
  avg(calls) FILTER (WHERE task_type = 'build') AS k, avg(good) FILTER (WHERE task_type = 'build') AS l FROM s GROUP BY batch_id),
x AS (SELECT batch_id, unnest(['num_turns_mean', 'num_turns_min', 'num_turns_max', 'rollout/build/env_reward', 'rollout/use/env_reward', 'rollout/build/tool_success_call_rate', 'rollout/use/final_answer_correct_rate', 'rollout/use/pool_coverage_rate', 'rollout/build/step1_failed_rate', 'rollout/use/step1_failed_rate', 'rollout/build/tool_call_count', 'rollout/build/tool_success_call_count']) AS name, unnest([a, b, c, d, e, f, g, h, i, j, k, l]) AS value FROM w)
SELECT batch_id, name, round(value, 6) AS value FROM x WHERE value IS NOT NULL
UNION ALL SELECT batch_id, 'rollout/' || task_type || '/step1_fail_' || ['missing_python_or_schema', 'schema_missing_function_name', 'schema_function_mismatch', 'schema_param_mismatch', 'invalid_tool_schema', 'xgrammar_incompatible_schema'][r + 1] || '_rate', round(avg(CASE WHEN reason = r THEN 1 ELSE 0 END), 6)
  FROM s, range(6) t(r) GROUP BY batch_id, task_type, r""")
def rollout_metrics(spark, sf_dir):
    return metrics.batch_metrics(_states(spark, sf_dir)).select("batch_id", "name", F.round("value", 6).alias("value"))


@query(f"""WITH {_STATES_SQL}, c AS (SELECT batch_id, task_type, reason, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY batch_id, task_type) AS rate FROM c)
SELECT batch_id, task_type, ['missing_python_or_schema', 'schema_missing_function_name', 'schema_function_mismatch', 'schema_param_mismatch', 'invalid_tool_schema', 'xgrammar_incompatible_schema'][reason + 1] AS step1_failure_reason, n, round(rate, 6) AS rate FROM r WHERE reason IS NOT NULL""")
def metric_failure_rates(spark, sf_dir):
    return metrics.failure_rates(_states(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query("SELECT 'rollout/by_task/' || replace(event_type, '-', '_') || '/env_reward' AS name, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def metric_by_task(spark, sf_dir):
    return metrics.by_category(_states(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"WITH {_STATES_SQL} SELECT task_type, category, count(*) AS n, round(avg(env_reward), 6) AS mean FROM s GROUP BY ROLLUP (task_type, category)")
def metric_rollup(spark, sf_dir):
    return metrics.metric_rollup(_states(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6), 5) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantage(spark, sf_dir):
    return metrics.group_advantage(table(spark, sf_dir, "events"), "user_id", "value").select("event_id", F.round("advantage", 5).alias("advantage"))


@query("""WITH b AS (SELECT event_id, (event_id % 7 < 3)::INT AS correct, event_id % 6 AS turns, (event_id % 9 - 4) * 0.3 AS raw, event_id % 5 = 0 AS none FROM events),
c AS (SELECT *, least(raw / 1.5, 1.0) AS norm, least(turns / 5.0, 1.0) AS r FROM b), d AS (SELECT *, CASE WHEN r <= 0.5 THEN 1 - 0.6 * r ELSE 0.7 * (1 - 2 * (r - 0.5)) * (1 - 2 * (r - 0.5)) END AS eff FROM c)
SELECT event_id, round(norm::DOUBLE, 6) AS tool_exec_norm, round(eff::DOUBLE, 6) AS efficiency_multiplier, round((2.0 * correct * eff)::DOUBLE, 6) AS use_correct_reward, (CASE WHEN none THEN -0.5 ELSE 0 END)::DOUBLE AS no_answer_penalty,
  (CASE WHEN NOT none AND correct = 0 THEN 0.1 ELSE 0 END)::DOUBLE AS final_attempt_reward, round((norm + CASE WHEN none THEN -0.5 ELSE 0 END)::DOUBLE, 6) AS env_reward FROM d""")
def reward_use_total(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7 < 3).cast("int").alias("correct"), (F.col("event_id") % 6).alias("turns"), ((F.col("event_id") % 9 - 4) * 0.3).alias("tool_exec_raw"), F.when(F.col("event_id") % 5 != 0, F.lit("a")).alias("answer"))
    got = rewards.use_rewards(e)
    return got.select("event_id", *[F.round(c, 6).alias(c) for c in ("tool_exec_norm", "efficiency_multiplier", "use_correct_reward")], "no_answer_penalty", "final_attempt_reward", F.round("env_reward", 6).alias("env_reward"))


@query("SELECT event_id, round(0.5 * (event_id % 3) / 2.0 + 0.5 * (event_id % 2) + CASE WHEN value > 0 THEN 1 ELSE 0 END - 1, 6)::DOUBLE AS renorm, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 0) AS env, (-least(2.0, 0.5 * (event_id % 6)))::DOUBLE AS penalty FROM events")
def reward_renorm(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", F.round(rewards.renorm((i % 3) / 2.0, (i % 2).cast("double"), "value"), 6).alias("renorm"), rewards.passthrough(F.when(i % 4 == 0, F.lit("bad")).otherwise(i.cast("string"))).alias("env"), rewards.capped_penalty(0.5 * (i % 6)).alias("penalty"))


@query("""WITH g AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 4 WHEN event_id % 19 = 0 THEN 5 END AS k, event_id % 2 = 0 AS f FROM events)
SELECT event_id, ['missing_python_or_schema', 'schema_missing_function_name', 'schema_function_mismatch', 'schema_param_mismatch', 'invalid_tool_schema', 'xgrammar_incompatible_schema'][k + 1] AS reason,
  CASE WHEN f THEN 0.5 ELSE 0.0 END::DOUBLE AS build_format_reward, CASE WHEN coalesce(k, 6) > 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS schema_fn_reward, CASE WHEN coalesce(k, 6) > 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS schema_param_reward,
  CASE WHEN k IS NULL THEN 1.0 + CASE WHEN f THEN 0.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS env_reward, k IS NOT NULL AS done FROM g""")
def step1_gate_reason(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    e = e.select("event_id", rewards.gate_reason(i % 13 != 0, i % 11 != 0, i % 7 != 0, i % 5 != 0, i % 17 != 0, i % 19 != 0).alias("reason"), (i % 2 == 0).alias("f"))
    return e.withColumn("s", rewards.gate_rewards("reason", "f")).select("event_id", "reason", "s.*")


@query("""WITH b AS (SELECT user_id AS build_id, event_id % 3 AS ok_calls, event_id % 2 AS bad_calls, event_id % 4 <> 0 AS has, event_id % 5 < 3 AS matched FROM events)
SELECT build_id, count(*) FILTER (WHERE ok_calls > 0 AND has AND matched) AS score, count(*) AS items, CAST(sum(ok_calls + bad_calls) AS BIGINT) AS made, CAST(sum(ok_calls) AS BIGINT) AS succeeded, CAST(sum(bad_calls) AS BIGINT) AS failed,
  count(*) FILTER (WHERE ok_calls + bad_calls > 0) AS tool_called_items, count(*) FILTER (WHERE ok_calls > 0) AS tool_success_items, round(count(*) FILTER (WHERE ok_calls > 0 AND has AND matched) / count(*), 6) AS build_eval_reward FROM b GROUP BY build_id""")
def build_scores(spark, sf_dir):
    i = F.col("event_id")
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("build_id"), (i % 3).alias("ok_calls"), (i % 2).alias("bad_calls"), F.when(i % 4 != 0, F.lit("a")).alias("answer"), (i % 5 < 3).alias("matched"))
    return metrics.build_scores(b).withColumn("build_eval_reward", F.round("build_eval_reward", 6))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from rillflow.streaming.pool_stream import windowed_rewards

    return windowed_rewards(table(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 6))


# ---- pool ------------------------------------------------------------------------------------------------------
def _tools(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("seq"), F.col("p_retailprice").alias("quality"), F.col("p_name").alias("name"))


@query("SELECT category, seq, CAST(rn AS INTEGER) AS rn FROM (SELECT p_brand AS category, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn <= 3")
def pool_newest_n(spark, sf_dir):
    return pool.newest(_tools(spark, sf_dir), 3).select("category", "seq", "rn")


@query("SELECT p_brand AS category, count(*) AS n FROM part GROUP BY p_brand")
def pool_counts(spark, sf_dir):
    return pool.counts(_tools(spark, sf_dir))


@query("""WITH RECURSIVE o AS (SELECT p_brand AS category, p_partkey AS seq, p_retailprice AS quality, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
f AS (SELECT category, i, [{'quality': quality, 'seq': seq}] AS pool FROM o WHERE i = 1
  UNION ALL SELECT f.category, o.i, list_append(CASE WHEN len(f.pool) >= 10 THEN list_sort(f.pool)[2:] ELSE f.pool END, {'quality': o.quality, 'seq': o.seq}) FROM f JOIN o ON o.category = f.category AND o.i = f.i + 1),
l AS (SELECT category, unnest(arg_max(pool, i)) AS t FROM f GROUP BY category) SELECT category, t.seq AS seq, t.quality AS quality FROM l""")
def pool_evict(spark, sf_dir):
    return pool.pool_state(_tools(spark, sf_dir)).select("category", "seq", "quality")


@query("""WITH c AS (SELECT DISTINCT p_brand AS category FROM part), n AS (SELECT count(*) AS n FROM c)
SELECT o_orderkey AS prompt_index, CAST(least(3, n - CASE WHEN c.category IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS picks, CAST(least(3, n - CASE WHEN c.category IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS categories, 0::BIGINT AS own, 0::BIGINT AS strangers
FROM orders CROSS JOIN n LEFT JOIN c ON c.category = 'Brand#' || (o_orderkey % 60)""")
def pool_distractors(spark, sf_dir):
    """Per prompt: tools drawn, their categories, draws from its own category, and draws that the pool does not hold."""
    tools = pool.pool_state(_tools(spark, sf_dir))
    prompts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_index"), F.concat(F.lit("Brand#"), F.col("o_orderkey") % 60).alias("category"))
    drawn = pool.distractors(prompts, tools, 3, 7).join(prompts.select("prompt_index", F.col("category").alias("mine")), "prompt_index")
    drawn = drawn.join(tools.select("category", "seq", F.lit(True).alias("there")), ["category", "seq"], "left")
    return drawn.groupBy("prompt_index").agg(F.count("*").alias("picks"), F.count_distinct("category").alias("categories"), F.count_if(F.col("category") == F.col("mine")).alias("own"), F.count_if(F.col("there").isNull()).alias("strangers"))


@query("SELECT p_brand AS task, p_partkey AS attempt, p_retailprice AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def proposal_best(spark, sf_dir):
    return rows.best_proposal(table(spark, sf_dir, "part").select(F.col("p_brand").alias("task"), F.col("p_partkey").alias("attempt"), F.col("p_retailprice").alias("accuracy")), "task")


@query("SELECT o_orderkey AS prompt_index, o_custkey AS category, 'covered' AS route FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT o_orderkey, o_custkey, 'build' FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))")
def pool_routes(spark, sf_dir):
    prompts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_index"), F.col("o_custkey").alias("category"), F.when(F.col("o_orderpriority").startswith("1"), F.lit("USE")).otherwise("build").alias("task_type"))
    have = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("category"))
    yes, no = rows.route(prompts, have)
    return yes.select("prompt_index", "category", F.lit("covered").alias("route")).unionByName(no.select("prompt_index", "category", F.lit("build").alias("route")))


@query("SELECT c_custkey, round(coalesce(s, 0), 2) AS score FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey")
def judge_left_join(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("score"))
    return rows.with_scores(table(spark, sf_dir, "customer").select("c_custkey"), scores, "c_custkey").select("c_custkey", F.round("score", 2).alias("score"))


# ---- texts, tokens, tools and puzzles as rows hold them ---------------------------------------------------------
@query(r"""
SELECT p_partkey, 'Q: ' || p_name AS asked, 'Question 1: ' || p_name || chr(10) || 'Answer: ' || p_brand || chr(10) || chr(10) || 'Question 2: ' || p_type || chr(10) || 'Answer: ' || p_size || chr(10) || chr(10) AS shots,
  md5('Questions:' || chr(10) || '- ' || p_name || chr(10) || '- ' || left(repeat(p_type, 60), 300) || chr(10) || '- ' || p_brand || chr(10) || chr(10) || 'Code:' || chr(10)
    || CASE WHEN length(p_name) * p_size * 20 > 6000 THEN left(repeat(p_name, p_size * 20), 6000) || chr(10) || '# ... truncated' ELSE repeat(p_name, p_size * 20) END || chr(10) || chr(10) || 'Schema:' || chr(10) || p_brand) AS judged,
  '[system] ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || chr(10) || chr(10) || '[user] ' || p_name AS logged, CASE WHEN p_size % 3 = 0 THEN '<tool>' || p_type ELSE chr(10) || chr(10) || 'Tool result: ' || p_type END AS added,
  left(p_name, 5) AS head, right(p_name, 5) AS tail FROM part""")
def prompt_texts(spark, sf_dir):
    """Prompts made from rows: prefix, few-shot examples, the judge's prompt with its limits, a log of messages, what a tool's message
    adds to a rendered chat, clips."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("int")
    shots = F.array(F.struct(F.col("p_name").alias("question"), F.col("p_brand").alias("answer")), F.struct(F.col("p_type").alias("question"), F.col("p_size").cast("string").alias("answer")))
    messages = F.array(F.struct(F.lit("system").alias("role"), F.when(size % 2 == 0, F.col("p_type")).alias("content")), F.struct(F.lit("user").alias("role"), F.col("p_name").alias("content")))
    judged = text.judge_prompt(F.array("p_name", F.repeat("p_type", F.lit(60)), "p_brand", F.lit("a fourth")), F.repeat("p_name", size * 20), "p_brand")
    after = F.when(size % 3 == 0, F.concat("p_name", F.lit("<tool>"), "p_type")).otherwise(F.concat(F.lit("other "), "p_name"))
    return p.select("p_partkey", text.user_question("p_name", "Q: ").alias("asked"), text.few_shot_block(shots).alias("shots"), F.md5(judged.cast("binary")).alias("judged"), text.format_messages(messages).alias("logged"), text.template_delta("p_name", after, "p_type").alias("added"), text.clip("p_name", 5).alias("head"), text.clip("p_name", 5, end=True).alias("tail"))


@query("""
WITH r AS (SELECT p_partkey, range(p_size % 4) AS ids, range(p_size % 3 + 1) AS new, range(p_size % 2 + 1) AS tool, p_size FROM part),
j AS (SELECT *, list_concat(ids, new, tool) AS every FROM r)
SELECT p_partkey, array_to_string(every, ',') AS ids, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(new, lambda x: 1), list_transform(tool, lambda x: 0)), ',') AS mask,
  round(CASE WHEN p_size % 5 = 0 THEN 0 ELSE len(ids) * -0.5 END + CASE WHEN p_size % 7 = 0 THEN 0 ELSE len(new) * -0.25 END, 6)::DOUBLE AS logprob, len(every) AS n, round(-0.125 * (p_size % 6), 6)::DOUBLE AS sampled FROM j""")
def token_arrays(spark, sf_dir):
    """Tokens of a rollout: the model's with mask 1 and their log probabilities (0 where there are none yet), the tools' with mask 0."""
    size = F.col("p_size").cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    p = table(spark, sf_dir, "part").select("p_partkey", size.alias("s"), upto(size % 4).alias("ids"), upto(size % 3 + 1).alias("new"), upto(size % 2 + 1).alias("tool"))
    all_of = lambda xs, v: F.transform(xs, lambda x: F.lit(v))
    p = p.withColumn("a", jsonx.append_model_tokens(F.col("ids"), all_of("ids", 1), F.when(F.col("s") % 5 != 0, all_of("ids", -0.5)), F.col("new"), F.when(F.col("s") % 7 != 0, all_of("new", -0.25))))
    p = p.withColumn("b", jsonx.append_tool_tokens(F.col("a.ids"), F.col("a.mask"), F.col("a.logprobs"), F.col("tool")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    tokens = F.transform(upto(F.col("s") % 6), lambda x: F.create_map(F.concat(F.lit("t"), x), F.lit(-0.125), F.lit("other"), F.lit(-9.0)))
    return p.select("p_partkey", F.array_join("b.ids", ",").alias("ids"), F.array_join("b.mask", ",").alias("mask"), F.round(total("b.logprobs"), 6).alias("logprob"), F.size("b.ids").cast("long").alias("n"), F.round(total(jsonx.sampled_logprobs(F.array_append(tokens, F.create_map().cast("map<string,double>")))), 6).alias("sampled"))


@query("""
WITH w AS (SELECT p_partkey, p_size, 'f_' || string_split(p_name, ' ')[1] AS f, 'x_' || string_split(p_name, ' ')[2] AS x, p_size % 6 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 5 THEN '' WHEN k = 4 THEN f || ',helper' ELSE 'helper,' || f END AS functions, CASE WHEN k = 5 THEN NULL WHEN k = 1 THEN 'self,' || x || ',y' ELSE x || ',y' END AS params, f AS tools, CASE WHEN k = 3 THEN x || ',z' WHEN k = 2 THEN x ELSE x || ',y' END AS wanted,
  CASE k WHEN 5 THEN 'syntax_error' WHEN 2 THEN 'parameter_mismatch' WHEN 3 THEN 'parameter_mismatch' END AS reason, k NOT IN (3, 5) AS covered, CASE WHEN k = 5 THEN 0 ELSE 1 END AS loadable,
  CASE WHEN p_size % 4 = 0 THEN 1 ELSE 2 END AS calls, p_size % 3 <> 0 AS listed FROM w""")
def tool_facts(spark, sf_dir):
    """Code and schemas made from rows: names and parameters of functions, agreement of code and schema, what may be loaded, calls
    that are allowed, lists of words."""
    w = F.split("p_name", " ")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") % 6).alias("k"), F.concat(F.lit("f_"), F.get(w, F.lit(0))).alias("f"), F.concat(F.lit("x_"), F.get(w, F.lit(1))).alias("x"), w.alias("w"))
    own = F.concat(F.when(F.col("k") == 4, F.lit("async def ")).otherwise("def "), "f", F.lit("("), F.when(F.col("k") == 1, "self, ").otherwise(""), "x", F.lit(", y):\n    return y\n"))
    code = F.when(F.col("k") == 5, F.lit("def broken(:")).when(F.col("k") == 4, F.concat(own, F.lit("def helper(a):\n    return a\n"))).otherwise(F.concat(F.lit("def helper(a):\n    return a\n"), own))
    second = F.when(F.col("k") == 3, F.lit(', "z": {}')).when(F.col("k") == 2, F.lit("")).otherwise(F.lit(', "y": {}'))
    parameters = F.concat(F.lit('{"type": "object", "properties": {"'), "x", F.lit('": {}'), second, F.lit("}}"))
    schema = F.concat(F.lit('[{"name": "'), "f", F.lit('", "description": "", "parameters": '), parameters, F.lit("}]"))
    p = p.withColumn("facts", pycode.py_facts(code)).withColumn("defs", jsonx.tool_definitions(schema))
    calls = F.array(F.struct(F.col("f").alias("name")), F.struct(F.lit("helper").alias("name")), F.struct(F.lit("strange").alias("name")))
    allowed = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("f", F.lit("helper")))
    fence = "`" * 3
    listed = jsonx.word_list_equal(F.concat(F.lit(f"so {fence}json\n"), F.to_json(F.when(F.col("p_size") % 3 == 0, F.reverse(F.array_append("w", F.lit("more")))).otherwise(F.col("w"))), F.lit(f"\n{fence}")), F.array_join("w", " "))
    return p.select(
        "p_partkey", F.array_join(pycode.function_names("facts", with_async=True), ",").alias("functions"), F.array_join(pycode.params_of("facts", F.col("f")), ",").alias("params"), F.array_join(jsonx.tool_names("defs"), ",").alias("tools"), F.array_join(jsonx.param_names("defs"), ",").alias("wanted"),
        pycode.alignment("facts", "defs").alias("reason"), pycode.schema_params_covered("facts", "defs").alias("covered"), F.size(pycode.loadable("defs", "facts")).alias("loadable"), F.size(jsonx.valid_tool_calls(calls, allowed, F.col("f"))).alias("calls"), listed.alias("listed"),
    )


@query("""
WITH d AS (SELECT p_partkey, p_size, p_partkey % 9 + 1 AS a, (p_partkey // 9) % 9 + 1 AS b, p_name FROM part), t AS (SELECT *, a + b AS s FROM d),
v AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS off, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS extra FROM t)
SELECT p_partkey, extra = 0 AND CASE WHEN s < 10 THEN a <> b AND s + off <> a AND s + off <> b AND s + off < 10 AND off = 0 ELSE a <> b AND s // 10 NOT IN (a, b) AND s % 10 NOT IN (a, b) AND s // 10 <> s % 10 AND off = 0 END AS solved,
  p_size % 3 <> 1 AS knights, p_size % 4 <> 2 AS same, p_size % 2 = 0 AND p_name <> '' AS kept FROM v""")
def puzzle_checks(spark, sf_dir):
    """Answers to puzzles made from rows, right and wrong: word sums of two digits, knights and knaves, exact ones; rows set apart."""
    p = table(spark, sf_dir, "part").withColumns({"a": F.col("p_partkey") % 9 + 1, "b": F.floor(F.col("p_partkey") / 9) % 9 + 1})
    p = p.withColumn("s", F.col("a") + F.col("b")).withColumn("two", F.col("s") >= 10)
    question = F.concat(F.lit("Solve this cryptarithm:\n\n  A\n+ B\n----\n "), F.when(F.col("two"), "CD").otherwise("C"), F.lit("\n\nEach letter is a digit."))
    off = F.when(F.col("p_size") % 5 == 0, 1).otherwise(0)
    first, second = F.when(F.col("two"), F.floor(F.col("s") / 10)).otherwise(F.col("s") + off), F.col("s") % 10 + off
    given = F.concat(F.lit("A="), "a", F.lit(", B="), "b", F.lit(", C="), first.cast("string"), F.when(F.col("two"), F.concat(F.lit(", D="), second.cast("string"))).otherwise(""), F.when(F.col("p_size") % 7 == 0, ",X=0").otherwise(""))
    names = F.split("p_name", " ")
    role = lambda i, k: F.concat(F.get(names, F.lit(i)), F.lit(f" is a {k}"))
    truth = F.concat(role(0, "knight"), F.lit(", "), role(1, "knave"))
    said = F.when(F.col("p_size") % 3 == 0, F.concat(role(1, "KNAVE"), F.lit(" and "), role(0, "knight"))).when(F.col("p_size") % 3 == 1, F.concat(role(0, "knave"), F.lit(", "), role(1, "knave"))).otherwise(truth)
    rows_ = p.select("p_partkey", verify.cryptarithm_solved(question, given).alias("solved"), verify.knights_match(said, truth).alias("knights"), verify.exact("p_name", F.when(F.col("p_size") % 4 != 2, F.col("p_name"))).alias("same"), (F.col("p_size") % 2 == 0).alias("fine"))
    good, bad = rows.quarantine(rows_, F.when(F.col("fine"), F.lit(True)))
    return rows.assert_all(good, F.col("fine"), "set apart wrongly").select("p_partkey", "solved", "knights", "same", F.lit(True).alias("kept")).unionByName(bad.select("p_partkey", "solved", "knights", "same", F.lit(False).alias("kept")))


@query("""
WITH c AS (SELECT p_partkey, p_size, p_name, p_brand, unnest(range(p_size % 4)) AS "at" FROM part)
SELECT p_partkey, CAST("at" AS INTEGER) AS "at", 'call' AS kind, p_name || "at" AS name, '{"x":' || (p_size + "at") || '}' AS body, p_brand AS answer FROM c
UNION ALL SELECT p_partkey, CAST(i AS INTEGER), 'code', NULL, 'x = ' || (p_size + i), p_brand FROM part, range(2) r(i) WHERE i < 1 + p_size % 2""")
def sql_functions_of_texts(spark, sf_dir):
    """Plain SQL over completions: calls and code blocks as rows, by table functions, beside the boxed answer."""
    from rillflow.functions import sql_functions

    sql_functions.register(spark)
    fence, size = "`" * 3, F.col("p_size").cast("int")
    several = lambda n, one: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), one), "\n")
    calls = several(size % 4, lambda i: F.concat(F.lit('<tool_call>{"name": "'), "p_name", i, F.lit('", "arguments": {"x":'), size + i, F.lit("}}</tool_call>\n<tool_call>{bad}</tool_call>")))
    code = several(1 + size % 2, lambda i: F.concat(F.lit(f"{fence}python\nx = "), size + i, F.lit(f"\n{fence}\n{fence}json\n1\n{fence}")))
    said = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<think>\\boxed{0}</think>"), calls, F.lit("\n"), code, F.lit("\n\\boxed{none} \\boxed{"), "p_brand", F.lit("}")).alias("t"))
    return spark.sql(
        """SELECT c.p_partkey, f.at, 'call' AS kind, f.name, f.arguments AS body, rf_answer_box_first(c.t) AS answer FROM {said} c, LATERAL rf_tool_calls(c.t) f
        UNION ALL SELECT c.p_partkey, f.at, 'code', NULL, f.body, rf_answer_boxed(c.t) FROM {said} c, LATERAL rf_code_blocks(c.t, 'python') f""",
        said=said,
    )


# ---- logic, ladders and deadlines ------------------------------------------------------------------------------
@query(r"""
WITH RECURSIVE said AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+'), lambda w: regexp_full_match(w, '[a-z]{4}')) AS ws FROM documents),
words AS (SELECT DISTINCT unnest(ws) AS word FROM said),
keys AS (SELECT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS pattern FROM words, range(1, 5) r(i)),
edges AS (SELECT DISTINCT a.word AS a, b.word AS b FROM keys a JOIN keys b USING (pattern) WHERE a.word <> b.word),
puzzles AS (SELECT DISTINCT list_min(ws) AS start, list_max(ws) AS target FROM said WHERE len(ws) > 0),
walk(start, word, steps, ladder) USING KEY (start, word) AS (
  SELECT DISTINCT start, start, 0, start FROM puzzles
  UNION SELECT w.start, e.b, w.steps + 1, min(w.ladder || ',' || e.b) FROM walk w JOIN edges e ON e.a = w.word
    WHERE w.steps < 5 AND NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.start = w.start AND r.word = e.b) GROUP BY w.start, e.b, w.steps)
SELECT p.start, p.target, w.steps, w.ladder FROM puzzles p LEFT JOIN walk w ON w.start = p.start AND w.word = p.target""")
def word_ladders(spark, sf_dir):
    """Shortest ladders of at most five steps from the least to the greatest word of four small letters of every document, over all of
    their words."""
    found = F.filter(F.regexp_extract_all("text", F.lit(r"[A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{4}$"))
    said = table(spark, sf_dir, "documents").select(found.alias("ws"))
    puzzles = said.where("size(ws) > 0").select(F.array_min("ws").alias("start"), F.array_max("ws").alias("target"))
    ladders = ladder.shortest_ladders(puzzles, said.select(F.explode("ws").alias("word")), 5)
    return ladders.select("start", "target", "steps", F.array_join("ladder", ",").alias("ladder"))


_OPS = ("AND", "OR", "IMPLIES", "IFF")


def _sql_op(op: str, a: str, b: str) -> str:
    return f"(CASE {op} WHEN 0 THEN {a} AND {b} WHEN 1 THEN {a} OR {b} WHEN 2 THEN NOT ({a}) OR {b} ELSE ({a}) = ({b}) END)"


_MIXED = f"CASE WHEN o1 <= o2 AND NOT (o1 = 2 AND o2 = 2) THEN {_sql_op('o2', _sql_op('o1', 'p', 'q'), 'NOT r')} ELSE {_sql_op('o1', 'p', _sql_op('o2', 'q', 'NOT r'))} END"
_GROUPED = f"NOT {_sql_op('o3', 'r', _sql_op('o1', 's', 'q'))}"
_GOAL = _sql_op("o3", "p", _sql_op("o2", "NOT s", "r"))


@query(f"""
WITH w AS (SELECT range AS w, range & 1 = 1 AS p, range & 2 = 2 AS q, range & 4 = 4 AS r, range & 8 = 8 AS s FROM range(16)),
o AS (SELECT p_partkey, p_size, p_partkey % 4 AS o1, (p_partkey // 4) % 4 AS o2, (p_partkey // 16) % 4 AS o3 FROM part),
v AS (SELECT p_partkey, p_size, w, {_MIXED} AS mixed, {_GROUPED} AS grouped, {_GOAL} AS goal FROM o, w)
SELECT p_partkey, CAST(sum(CASE WHEN w < 8 AND mixed THEN 1 << w ELSE 0 END) AS BIGINT) AS mixed, CAST(sum(CASE WHEN mixed AND w < 8 THEN 1 ELSE 0 END) AS BIGINT) AS models,
  CAST(sum(CASE WHEN grouped AND w & 1 = 0 THEN 1 << (w >> 1) ELSE 0 END) AS BIGINT) AS grouped, bool_and(NOT (mixed AND grouped) OR goal) AS entailed, bool_or(goal AND w = p_size % 16) AS here FROM v GROUP BY p_partkey""")
def logic_tables(spark, sf_dir):
    """Formulas whose connectives depend on the row, without and with parentheses: truth tables, models, entailment, truth in a world."""
    op = lambda n: F.element_at(F.array(*map(F.lit, _OPS)), (F.floor(F.col("p_partkey") / n) % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", op(1).alias("o1"), op(4).alias("o2"), op(16).alias("o3"))
    mixed, grouped, goal = F.format_string("P %s Q %s NOT R", "o1", "o2"), F.format_string("not (R %s (S %s Q))", "o3", "o1"), F.format_string("P %s (~S %s R)", "o3", "o2")
    rows = p.select("p_partkey", "p_size", mixed.alias("a"), grouped.alias("b"), goal.alias("c"))
    bit = lambda i: F.getbit("p_size", F.lit(i)) == 1
    world = F.create_map(F.lit("P"), bit(0), F.lit("R"), bit(2), F.lit("S"), bit(3))
    tables = rows.select("p_partkey", logic.truth_table("a").alias("mixed"), logic.truth_table("b").alias("grouped"), logic.entails(F.array("a", "b"), "c").alias("entailed"), logic.evaluate("c", world).alias("here"))
    return tables.withColumn("models", logic.models("mixed"))


_CLAIM = "CASE k{0} WHEN 0 THEN NOT x{1} WHEN 1 THEN x{1} WHEN 2 THEN x{1} AND NOT x{2} WHEN 3 THEN NOT x{0} OR NOT x{1} WHEN 4 THEN NOT x{1} OR x{2} ELSE x{1} = x{2} END"


@query(f"""
WITH w AS (SELECT range & 1 = 1 AS x0, range & 2 = 2 AS x1, range & 4 = 4 AS x2 FROM range(8)),
k AS (SELECT c_custkey, c_custkey % 6 AS k0, (c_custkey // 6) % 6 AS k1, (c_custkey // 36) % 6 AS k2 FROM customer),
f AS (SELECT c_custkey, x0, x1, x2, ({_CLAIM.format(0, 1, 2)}) = x0 AND ({_CLAIM.format(1, 2, 0)}) = x1 AND ({_CLAIM.format(2, 0, 1)}) = x2 AS fits FROM k, w)
SELECT c_custkey, count(*) FILTER (WHERE fits) AS worlds, CASE WHEN count(*) FILTER (WHERE fits) = 1 THEN max(CASE WHEN fits THEN 'Ann is a ' || CASE WHEN x0 THEN 'knight' ELSE 'knave' END || ', Bob is a ' || CASE WHEN x1 THEN 'knight' ELSE 'knave' END || ', Cid is a ' || CASE WHEN x2 THEN 'knight' ELSE 'knave' END END) END AS solution
FROM f GROUP BY c_custkey""")
def knights_solved(spark, sf_dir):
    """Three people's statements, as nested tuples that depend on the row: the worlds that fit, and the answer where one does."""
    kind = lambda i: (F.floor(F.col("c_custkey") / 6**i) % 6 + 1).cast("int")
    forms = ("('lying', {1})", "('telling-truth', {1})", "('and', ('telling-truth', {1}), ('lying', {2}))", "('or', ('lying', {0}), ('lying', {1}))", "('->', ('telling-truth', {1}), ('telling-truth', {2}))", "('<=>', ('telling-truth', {1}), ('not', ('lying', {2})))")
    said = [F.element_at(F.array(*[F.lit(f.format(i, (i + 1) % 3, (i + 2) % 3)) for f in forms]), kind(i)) for i in range(3)]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("("), F.concat_ws(", ", *said), F.lit(")")).alias("said"))
    rows = rows.select("c_custkey", logic.statement_masks("said").alias("masks"))
    people = F.array(*map(F.lit, ("Ann", "Bob", "Cid")))
    return rows.select("c_custkey", F.bit_count(logic.knights_worlds("masks")).cast("long").alias("worlds"), logic.knights_solution("masks", people).alias("solution"))


@query("""
WITH s AS (SELECT event_id, ts, value, greatest(30 * 5 * (event_id % 16) + 60, 40) AS deadline FROM events), r AS (SELECT event_id - 7 AS event_id, ts AS scored_at, value AS score FROM events)
SELECT s.event_id, CAST(s.deadline AS BIGINT) AS deadline, CASE WHEN r.scored_at BETWEEN s.ts AND least(s.ts + INTERVAL 1 HOUR, s.ts + to_seconds(s.deadline)) THEN r.score ELSE 0 END AS score,
  coalesce(r.scored_at BETWEEN s.ts AND least(s.ts + INTERVAL 1 HOUR, s.ts + to_seconds(s.deadline)), false) AS in_time FROM s LEFT JOIN r USING (event_id)""")
def deadline_scores(spark, sf_dir):
    """Every event is a state, scored by the event seven later; scores past the deadline of its number of questions leave 0."""
    from rillflow.streaming import deadlines

    events = table(spark, sf_dir, "events")
    due = deadlines.build_deadline(F.lit(30), F.lit(5), F.col("event_id") % 16)
    states = events.select("event_id", F.col("ts").alias("asked_at"), due.cast("long").alias("deadline"))
    scores = events.select((F.col("event_id") - 7).alias("event_id"), F.col("ts").alias("scored_at"), F.col("value").alias("score"))
    return deadlines.scores_in_time(states, scores, "event_id").drop("asked_at")


# ---- dates and numbers -----------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, strftime(o_orderdate, '%A') AS weekday, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') + 1 AS days_inclusive,
  (o_orderdate::DATE + (o_orderkey % 200)::INT)::DATE AS later, (o_orderdate::DATE - (o_orderkey % 200)::INT)::DATE AS earlier, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap FROM orders""")
def calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    end, k = F.lit("2000-01-01").cast("date"), (F.col("o_orderkey") % 200).cast("int")
    return o.select("o_orderkey", numbers.day_of_week("d").alias("weekday"), numbers.days_between("d", end).cast("long").alias("days"), numbers.days_between("d", end, True).cast("long").alias("days_inclusive"), numbers.add_days("d", k).alias("later"), numbers.subtract_days("d", k).alias("earlier"), numbers.is_leap_year(F.year("d")).alias("leap"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS matched FROM orders")
def calendar_match(spark, sf_dir):
    day = F.date_format("o_orderdate", "EEEE")
    said = F.when(F.col("o_orderkey") % 4 == 0, day).when(F.col("o_orderkey") % 4 == 1, F.upper(day)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("about "), F.col("o_orderkey"), F.lit(" days"))).otherwise(F.lit("none"))
    truth = F.when(F.col("o_orderkey") % 4 == 2, F.col("o_orderkey").cast("string")).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", verify.calendar_match(said, truth).alias("matched"))


@query("SELECT DISTINCT l_partkey, l_suppkey, gcd(l_partkey, l_suppkey) AS g, lcm(l_partkey, l_suppkey) AS l, CAST(bit_count(l_partkey) AS INTEGER) AS bits FROM lineitem")
def gcd_lcm_bits(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select("l_partkey", "l_suppkey", numbers.gcd("l_partkey", "l_suppkey").alias("g"), numbers.lcm("l_partkey", "l_suppkey").alias("l"), numbers.count_bits("l_partkey").alias("bits"))


@query("""SELECT p_partkey, p_size + p_partkey - 7 AS chain, CASE p_partkey % 4 WHEN 0 THEN p_size * 5 WHEN 1 THEN p_size * 32 WHEN 2 THEN p_size // 4 ELSE xor(p_size, p_partkey) END AS bits,
  (p_partkey - p_size) / 3::DOUBLE AS root, (3 * p_size) || ',' || (p_size * p_partkey + 6) || ',' || (2 * p_partkey) AS product, (p_size + 3.0::DOUBLE * p_partkey) AS value, p_size + 1.0::DOUBLE * p_partkey AS area, p_partkey % 3 <> 1 AS ladder, p_partkey % 2 = 1 OR p_size > 20 AS implied FROM part""")
def solvers(spark, sf_dir):
    """Answers of task generators as columns: sums, bits, roots, products, values and integrals of polynomials, ladders, logic."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("s"))
    sign, other = F.element_at(F.array(*map(F.lit, ("*", "<<", ">>", "^"))), (F.col("k") % 4 + 1).cast("int")), F.element_at(F.array(F.lit(5), F.lit(5), F.lit(2), F.col("k")), (F.col("k") % 4 + 1).cast("int"))
    line, first = F.array("s", F.col("k")), F.array(F.col("s"), F.lit(2).cast("long"))
    words = F.when(F.col("k") % 3 == 0, F.array(F.lit("cold"), F.lit("cord"), F.lit("card"))).when(F.col("k") % 3 == 1, F.array(F.lit("cold"), F.lit("card"))).otherwise(F.array(F.lit("cold")))
    anti = numbers.poly_integral(line)
    return p.select(
        F.col("k").alias("p_partkey"), numbers.chain_sum(F.concat(F.lit("Calculate "), "s", F.lit(" + "), "k", F.lit(" - 7."))).alias("chain"), numbers.bitwise("s", sign, other).alias("bits"), numbers.linear_root(F.lit(3), F.col("s"), F.col("k")).alias("root"),
        F.array_join(numbers.poly_product(first, F.array(F.lit(3).cast("long"), F.col("k"))).cast("array<string>"), ",").alias("product"), numbers.poly_value(line, F.lit(3)).alias("value"),
        (numbers.poly_value(anti, F.lit(2)) - numbers.poly_value(anti, F.lit(0))).alias("area2"), numbers.ladder_holds(words).alias("ladder"), numbers.implies(F.col("k") % 2 == 0, F.col("s") > 20).alias("implied"),
    ).withColumn("area", F.col("area2") / 2).drop("area2")


@query("SELECT p_partkey, lower(to_base(p_partkey, 16)) AS hex, to_base(p_partkey, 2) AS bin, lower(to_base(p_partkey, 7)) AS seven, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'DEFGHIJKLMNOPQRSTUVWXYZABCdefghijklmnopqrstuvwxyzabc') AS caesar, reverse(p_name) AS backward FROM part")
def base_caesar_backward(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.convert_base(k, 10, 16).alias("hex"), numbers.convert_base(k, 10, 2).alias("bin"), numbers.convert_base(k, 10, 7).alias("seven"), numbers.caesar("p_name", 3).alias("caesar"), numbers.spell_backward("p_name").alias("backward"))


@query("""WITH RECURSIVE f AS (SELECT DISTINCT p_partkey AS n, p_partkey AS rest, 2::BIGINT AS d, []::BIGINT[] AS fs FROM part WHERE p_partkey >= 2
  UNION ALL SELECT n, CASE WHEN rest % d = 0 THEN rest // d ELSE rest END, CASE WHEN rest % d = 0 THEN d ELSE d + 1 END, CASE WHEN rest % d = 0 THEN list_append(fs, d) ELSE fs END FROM f WHERE d * d <= rest)
SELECT n AS p_partkey, array_to_string(CASE WHEN arg_min(rest, rest * 1000000 - len(fs)) > 1 THEN list_append(arg_max(fs, len(fs)), min(rest)) ELSE arg_max(fs, len(fs)) END, ' × ') AS factors FROM f GROUP BY n""")
def prime_factors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey").distinct().where("p_partkey >= 2")
    return p.select("p_partkey", F.array_join(numbers.prime_factors("p_partkey"), " × ").alias("factors"))


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS other FROM part)
SELECT p_partkey, [instr(p_name, x) for x in string_split(p_name, '')] = [instr(reverse(p_name), x) for x in string_split(reverse(p_name), '')] AS isomorphic, [instr(p_name, x) for x in string_split(p_name, '')] = [instr(other, x) for x in string_split(other, '')] AS shifted FROM p""")
def isomorphic(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.isomorphic("p_name", F.reverse("p_name")).alias("isomorphic"), numbers.isomorphic("p_name", numbers.caesar(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")), 5)).alias("shifted"))


@query("""WITH n AS (SELECT DISTINCT p_size % 6 + 1 AS disks FROM part), m AS (SELECT disks, unnest(range(1, (1 << disks)::BIGINT)) AS m FROM n),
r AS (SELECT disks, m, (m & (m - 1)) % 3 AS a, ((m | (m - 1)) + 1) % 3 AS b, CASE WHEN disks % 2 = 1 THEN ['A', 'B', 'C'] ELSE ['A', 'C', 'B'] END AS rods FROM m)
SELECT CAST(disks AS INTEGER) AS disks, string_agg(rods[a + 1] || rods[b + 1], ' ' ORDER BY m) AS moves, disks % 2 = 0 AS valid FROM r GROUP BY disks""")
def hanoi(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_size") % 6 + 1).cast("int").alias("disks")).distinct().withColumn("m", numbers.hanoi_moves("disks"))
    return d.select("disks", F.array_join(F.transform("m", lambda x: F.concat(x["from"], x["to"])), " ").alias("moves"), verify.hanoi_valid(F.expr("slice(m, 1, size(m) - disks % 2)"), "disks").alias("valid"))  # an odd number of disks lacks its last move


# ---- code, schemas, tools, tasks, whole rollouts ---------------------------------------------------------------
#: Source texts by p_partkey % 5, where {k} is the key: parses, names of functions, parameters of the first.
_SOURCES = [
    ("def f{k}(a, b):\\n    return a +\\n", "false", "''", "''"),
    ("def f{k}(a, b):\\n    return g(a)\\ndef g(x):\\n    return x\\n", "true", "'f' || p_partkey || ',g'", "'a,b'"),
    ("class C{k}:\\n    def __init__(self, p):\\n        self.p = p\\n", "true", "'__init__'", "'self,p'"),
    ("async def f{k}(z):\\n    return z\\n", "true", "''", "''"),
    ("x = {k}\\nif x:\\n    def late{k}(q, *rest, w=1):\\n        return w\\n", "true", "'late' || p_partkey", "'q'"),
]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("SELECT p_partkey, " + ", ".join(f"{_case('p_partkey', [x[i] for x in _SOURCES])} AS {name}" for i, name in ((1, "ok"), (2, "names"), (3, "params"))) + " FROM part")
def ast_facts(spark, sf_dir):
    code = F.expr(_case("p_partkey", [f"replace('{x[0]}', '{{k}}', CAST(p_partkey AS STRING))" for x in _SOURCES]))
    p = table(spark, sf_dir, "part").select("p_partkey", pycode.py_facts(code).alias("facts"))
    return p.select("p_partkey", F.col("facts")["ok"].alias("ok"), F.array_join(pycode.function_names("facts"), ",").alias("names"), F.array_join(pycode.first_params("facts"), ",").alias("params"))


def _tool(function: object, **more: object) -> str:
    return json.dumps([{"function": function, **more}])


def _function(**change: object) -> dict:
    own = {"name": "f", "description": "", "parameters": {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}}
    return {k: v for k, v in {**own, **change}.items() if v != "-"}


def _parameters(properties: object, **more: object) -> dict:
    return _function(parameters={"type": "object", "properties": properties, **more})


#: Tool schemas: the text, the reason it is refused for, and the errors and warnings of its first function's parameters.
_SCHEMAS: list[tuple[str, str | None, int, int]] = [
    (_tool(_function()), None, 0, 0), (_tool(_function(), type="function"), None, 0, 0), ("[{", "invalid_json", 1, 0), ("[]", "not_a_nonempty_list", 1, 0), ("[1]", "tool_not_object", 1, 0),
    (_tool(_function()).replace("function", "other"), "function_not_object", 1, 0), (_tool(_function(name=" ")), "missing_name", 0, 0), (_tool(_function(description="-")), "missing_description", 0, 0), (_tool(_function(description=1)), "description_not_string", 0, 0),
    (_tool(_function(parameters=3)), "parameters_not_object", 1, 0), (_tool(_function(parameters={"type": "array", "uniqueItems": True, "minItems": 1})), "parameters_type_not_object", 1, 1), (_tool(_function(parameters={"type": "object"})), "properties_not_object", 0, 0),
    (_tool(_parameters({"a": True})), "property_not_object", 0, 0), (_tool(_parameters({"a": {}})), "property_without_type", 0, 0), (_tool(_parameters({"a": {"type": ["string", "text"]}})), "property_type_unknown", 0, 0), (_tool(_parameters({"a": {"type": ["string", "null"]}})), None, 0, 0),
    (_tool(_parameters({}, required="a")), "required_not_list", 0, 0), (_tool(_parameters({}, required=[1])), "required_not_string", 0, 0), (_tool(_parameters({}, required=["b"])), "required_not_in_properties", 0, 0),
    (_tool(_parameters({"a": {"type": "array", "items": [{"type": "string"}]}})), None, 1, 0), (_tool(_parameters({"a": {"type": "array", "items": None, "maxItems": 2, "contains": {}}})), None, 1, 1), (_tool(_parameters({"a": {"type": "string", "contentEncoding": "base64"}, "b": {"type": "object", "not": {}, "dependentSchemas": {}}})), None, 1, 2),
    (_tool(_parameters({"a": {"type": "object", "anyOf": [{"$ref": "#/$defs/x"}, {"$ref": "#/$defs/x"}]}}, **{"$defs": {"x": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/x"}}}})), None, 2, 0),
]


@query("SELECT p_partkey, " + _case("p_partkey", ["'ok'" if r is None else f"'{r}'" for _, r, _, _ in _SCHEMAS]) + " AS problem, CAST(" + _case("p_partkey", [str(e) for _, _, e, _ in _SCHEMAS]) + " AS INTEGER) AS errors, CAST(" + _case("p_partkey", [str(w) for *_, w in _SCHEMAS]) + " AS INTEGER) AS warnings FROM part")
def schema_checks(spark, sf_dir):
    """What is wrong with tool schemas of every kind of fault, and what a grammar could not hold of their parameters."""
    schema = F.element_at(F.array(*[F.lit(x[0]) for x in _SCHEMAS]), (F.col("p_partkey") % len(_SCHEMAS) + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", schema.alias("schema")).withColumn("tools", jsonx.tool_definitions("schema"))
    p = p.withColumn("c", jsonx.schema_compat(F.try_element_at("tools", F.lit(1))["parameters"])).withColumn("checked", jsonx.tool_schema_check("schema"))
    return p.select("p_partkey", F.coalesce(F.col("checked")["reason"], F.lit("ok")).alias("problem"), F.size(F.col("c")["errors"]).alias("errors"), F.size(F.col("c")["warnings"]).alias("warnings"))


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 < 2 THEN 'Error' ELSE 'Success' END AS status,
  CASE n_nationkey % 5 WHEN 0 THEN 'Error: ' WHEN 1 THEN 'Error: arguments must be a JSON object' WHEN 2 THEN '(no output)' ELSE CAST(2 * n_nationkey AS VARCHAR) END AS tool_result,
  CASE WHEN n_nationkey % 5 < 2 THEN -0.2::DOUBLE ELSE 0.3::DOUBLE END AS reward_delta FROM nation""")
def tool_execution(spark, sf_dir):
    """Tools that answer, fail, say nothing, or get no object of arguments; of a failure's message only its beginning."""
    kind = F.col("n_nationkey") % 5
    code = F.when(kind == 0, F.lit("def twice(x):\n    raise ValueError(x)")).when(kind == 2, F.lit("def twice(x):\n    return ''")).otherwise(F.lit("def twice(x):\n    return 2 * x"))
    args = F.when(kind == 1, F.lit("[1]")).otherwise(F.concat(F.lit('{"x": '), "n_nationkey", F.lit("}")))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), code.alias("code"), F.lit("twice").alias("function"), args.alias("args"), F.lit(10).alias("timeout"))
    said = F.when(F.col("id") % 5 == 0, F.left("tool_result", F.lit(7))).otherwise(F.col("tool_result"))
    return execute.execute_jobs(n).select("id", "status", said.alias("tool_result"), "reward_delta")


def _task_query(task: str):
    def run(spark, sf_dir):
        return task_source.dataset(spark, task)

    return run


for _task in task_source.BANDS:
    QUERIES[f"task_{_task}"] = _task_query(_task)


@query()
def task_verified(spark, sf_dir):
    """Share of generated rows that their verifier confirms, by task."""
    parts = [task_source.generate(spark, t).groupBy("task").agg(F.count("*").alias("n"), F.count_if("verified").alias("verified")) for t in task_source.BANDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _replayed(spark: SparkSession, n: DataFrame, use_index: Column, build_index: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """plans.rollout of two batches, answered by replay, with a use prompt and a build for each k of n; no index names two prompts."""
    from rillflow.sources.replay import batch_folder

    batch = F.concat(F.lit("b"), F.col("k") % 2)
    fence = "`" * 3
    tests = F.array(*[F.struct(F.lit(f"Thrice {i}").alias("question"), F.lit(str(3 * i)).alias("answer")) for i in (1, 2)])
    use = F.to_json(F.struct(F.concat(F.lit("double-train-"), "k").alias("id"), F.lit("use").alias("task_type"), F.concat(F.lit("Twice "), "k").alias("target_question"), (2 * F.col("k")).cast("string").alias("target_answer")))
    build = F.to_json(F.struct(F.concat(F.lit("triple-train-"), "k").alias("id"), F.lit("build").alias("task_type"), tests.alias("tool_test_set")))
    marked = lambda said, meta: F.concat(said, F.lit(" <tool_rl_metadata>"), meta, F.lit("</tool_rl_metadata>"))
    uses = n.select(batch.alias("batch_id"), use_index.alias("prompt_index"), marked(F.lit("Go"), use).alias("prompt"))
    builds = n.select(batch.alias("batch_id"), build_index.alias("prompt_index"), marked(F.concat(F.lit("Build "), "k"), build).alias("prompt"), "k")
    tool = lambda name: json.dumps([{"type": "function", "function": {"name": name, "description": "", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}}])
    tools = spark.range(1).select(F.lit("double").alias("category"), F.lit(1).cast("long").alias("seq"), F.lit(0.5).alias("quality"), F.lit("def twice(x):\n    return 2 * x").alias("code"), jsonx.tool_definitions(F.lit(tool("twice"))).alias("tools"))

    def answered(rows: DataFrame, asked: Column, name: str, x: Column, result: Column, answer: Column) -> DataFrame:
        call = F.concat(F.lit(f'<tool_call>{{"name": "{name}", "arguments": {{"x": '), x, F.lit("}}</tool_call>"))
        told = F.concat(asked, F.lit("\n"), call, F.lit("\n\nTool result: "), result)
        first = rows.select(asked.alias("prompt"), F.lit(0).alias("turn"), call.alias("reply"))
        return first.unionByName(rows.select(told.alias("prompt"), F.lit(1).alias("turn"), F.concat(F.lit("\\boxed{"), answer, F.lit("}")).alias("reply")))

    factor = F.when(F.col("k") % 4 == 1, 4).otherwise(3)
    body = F.concat(F.lit(f"{fence}python\ndef thrice(x):\n    return "), factor, F.lit(f" * x\n{fence}\n{fence}json\n"), F.when(F.col("k") % 4 == 2, F.lit(tool("other"))).otherwise(F.lit(tool("thrice"))), F.lit(f"\n{fence}"))
    asked = F.concat(F.lit("Thrice "), "i")
    trials = spark.range(1, 3).select(F.col("id").alias("i"), F.explode(F.array(F.lit(3), F.lit(4))).alias("by"))
    replies = answered(n, F.concat(F.lit("Twice "), "k"), "twice", F.col("k"), 2 * F.col("k"), F.when(F.col("k") % 5 == 0, F.lit(-1)).otherwise(2 * F.col("k")))
    replies = replies.unionByName(builds.select(text.strip_metadata("prompt").alias("prompt"), F.lit(0).alias("turn"), body.alias("reply")))
    replies = replies.unionByName(answered(trials, asked, "thrice", F.col("i"), F.col("by") * F.col("i"), F.col("by") * F.col("i"))).distinct()
    return rollout.rollout(uses.unionByName(builds.drop("k")), tools, execute.ReplayClient(replies), batch_folder(spark))


@query("""
WITH u AS (SELECT n_nationkey AS k FROM nation)
SELECT 'b' || (k % 2) AS batch_id, CAST(k AS BIGINT) AS prompt_index, 'use' AS kind, CAST(CASE WHEN k % 5 = 0 THEN -1 ELSE 2 * k END AS VARCHAR) AS answer, CAST(k % 5 <> 0 AS INTEGER) AS correct,
  NULL::VARCHAR AS reason, NULL::DOUBLE AS score, 0.2::DOUBLE AS env_reward FROM u
UNION ALL SELECT 'b' || (k % 2), 1000 + k, 'build', NULL, NULL, CASE WHEN k % 4 = 2 THEN 'schema_function_mismatch' END, CASE k % 4 WHEN 1 THEN 0.0 WHEN 2 THEN NULL ELSE 2.0 END, CASE k % 4 WHEN 1 THEN 1.5 WHEN 2 THEN 0.0 ELSE 2.5 END FROM u""")
def rollout_batch(spark, sf_dir):
    """Two batches answered by replay: use prompts with one tool call and an answer, and builds (right, wrong, or not fitting
    their schema) that are run on two test questions."""
    used, scored, _ = _replayed(spark, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")), F.col("k"), 1000 + F.col("k"))
    left = used.select("batch_id", "prompt_index", F.lit("use").alias("kind"), "answer", "correct", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("score"), F.round("env_reward", 6).alias("env_reward"))
    right = scored.select("batch_id", "prompt_index", F.lit("build").alias("kind"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("int").alias("correct"), F.col("step1_failure_reason").alias("reason"), "score", F.round("env_reward", 6).alias("env_reward"))
    return left.unionByName(right)


@query("""
WITH k AS (SELECT s_suppkey AS k FROM supplier),
rows AS (
  SELECT 'b' || (k % 2) AS batch_id, 'use' AS kind, 'double' AS category, 1.0::DOUBLE AS turns, 0.2::DOUBLE AS env, CASE WHEN k % 5 = 0 THEN 0.0 ELSE 2 * 0.88 END AS won, k % 5 <> 0 AS correct, NULL AS reason, 0.0 AS calls, 0.0 AS fine, 0.0 AS score FROM k
  UNION ALL SELECT 'b' || (k % 2), 'build', 'triple', 0.0, CASE k % 4 WHEN 1 THEN 1.5 WHEN 2 THEN 0.0 ELSE 2.5 END, 0.0, false, CASE WHEN k % 4 = 2 THEN 'schema_function_mismatch' END, CASE WHEN k % 4 = 2 THEN 0.0 ELSE 2.0 END, CASE WHEN k % 4 = 2 THEN 0.0 ELSE 2.0 END, CASE WHEN k % 4 IN (1, 2) THEN 0.0 ELSE 1.0 END FROM k),
m AS (
  SELECT batch_id, 'num_turns_mean' AS name, avg(turns) AS value FROM rows GROUP BY 1 UNION ALL SELECT batch_id, 'num_turns_min', min(turns) FROM rows GROUP BY 1 UNION ALL SELECT batch_id, 'num_turns_max', max(turns) FROM rows GROUP BY 1
  UNION ALL SELECT batch_id, 'rollout/' || kind || '/env_reward', avg(env) FROM rows GROUP BY batch_id, kind
  UNION ALL SELECT batch_id, 'rollout/' || kind || '/step1_failed_rate', avg(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) FROM rows GROUP BY batch_id, kind
  UNION ALL SELECT batch_id, 'rollout/' || kind || '/step1_fail_' || g || '_rate', avg(CASE WHEN reason = g THEN 1 ELSE 0 END) FROM rows, unnest(['missing_python_or_schema', 'schema_missing_function_name', 'schema_function_mismatch', 'schema_param_mismatch', 'invalid_tool_schema', 'xgrammar_incompatible_schema']) t(g) GROUP BY batch_id, kind, g
  UNION ALL SELECT batch_id, 'rollout/' || kind || '/' || c, avg(CASE WHEN kind = 'use' OR (reason IS NOT NULL AND c = 'schema_param_reward') THEN 0.0 WHEN c = 'build_format_reward' THEN CASE WHEN reason IS NULL THEN 1.5 ELSE 0 END WHEN reason IS NOT NULL AND c = 'schema_fn_reward' THEN 0.0 ELSE 0.5 END)
    FROM rows, unnest(['build_format_reward', 'step1_format_reward', 'schema_fn_reward', 'schema_param_reward']) t(c) GROUP BY batch_id, kind, c
  UNION ALL SELECT batch_id, 'rollout/build/build_eval_reward', avg(score) FROM rows WHERE kind = 'build' GROUP BY 1 UNION ALL SELECT DISTINCT batch_id, 'rollout/build/judge_reward', 0.0 FROM rows
  UNION ALL SELECT batch_id, 'rollout/build/tool_call_count', avg(calls) FROM rows WHERE kind = 'build' GROUP BY 1 UNION ALL SELECT batch_id, 'rollout/build/tool_success_call_count', avg(fine) FROM rows WHERE kind = 'build' GROUP BY 1
  UNION ALL SELECT DISTINCT batch_id, 'rollout/build/tool_error_call_count', 0.0 FROM rows UNION ALL SELECT batch_id, 'rollout/build/tool_success_call_rate', avg(CASE WHEN calls > 0 THEN fine / calls ELSE 0 END) FROM rows WHERE kind = 'build' GROUP BY 1
  UNION ALL SELECT DISTINCT batch_id, name, value FROM rows, (VALUES ('rollout/use/tool_exec_raw', 0.3), ('rollout/use/tool_exec_norm', 0.2), ('rollout/use/tool_exec_scaled', 0.2), ('rollout/use/efficiency_multiplier', 0.88), ('rollout/use/no_answer_penalty', 0.0), ('rollout/use/pool_coverage_rate', 1.0)) v(name, value)
  UNION ALL SELECT batch_id, 'rollout/use/final_answer_reward', avg(won) FROM rows WHERE kind = 'use' GROUP BY 1 UNION ALL SELECT batch_id, 'rollout/use/final_answer_correct_rate', avg(CASE WHEN correct THEN 1 ELSE 0 END) FROM rows WHERE kind = 'use' GROUP BY 1
  UNION ALL SELECT batch_id, 'rollout/by_task/' || category || '/env_reward', avg(env) FROM rows GROUP BY batch_id, category
  UNION ALL SELECT DISTINCT batch_id, 'rollout/pool/total_tools', 1.0 + (SELECT least(count(*) FILTER (WHERE k % 4 IN (0, 3)), 10) FROM k) FROM rows)
SELECT batch_id, name, round(CAST(value AS DOUBLE), 6) AS value FROM m""")
def rollout_metric_table(spark, sf_dir):
    """Every metric of two batches, from the rows that a rollout returns, with a use prompt and a build for each supplier."""
    used, scored, after = _replayed(spark, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")), 2 * F.col("k"), 2 * F.col("k") + 1)
    return metrics.rollout_metrics(used, scored, after).select("batch_id", "name", F.round("value", 6).alias("value"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations GROUP BY conv_id), k AS (SELECT *, conv_id % 8 AS k FROM c)
SELECT CAST(conv_id AS VARCHAR) AS rollout_id, CASE WHEN k IN (0, 1, 5, 6) THEN 2.0 WHEN k = 2 AND size % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS correctness_reward, CASE k WHEN 5 THEN 1.0 WHEN 6 THEN 0.3 ELSE 0.0 END::DOUBLE AS tool_usage_reward,
  CASE WHEN k = 4 THEN 0.0 ELSE 0.5 END::DOUBLE AS format_reward, CASE WHEN k = 3 THEN -least(2.0, 0.5 * (n - 1)) ELSE 0.0 END::DOUBLE AS final_answer_spam_penalty, CASE WHEN k = 6 THEN -1.0 ELSE 0.0 END::DOUBLE AS tool_python_syntax_penalty,
  CASE WHEN k = 7 THEN -0.5 ELSE 0.0 END::DOUBLE AS tool_json_schema_penalty, CASE WHEN k = 5 THEN CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS step1, CASE WHEN k = 5 THEN 1.0 WHEN k = 7 THEN 0.5 ELSE 0.0 END::DOUBLE AS step2 FROM k""")
def reward_stage_table(spark, sf_dir):
    """All rewards of a completion for each conversation: its turns, then an answer of its length, said rightly, boxed, in words for the
    judge, again and again, not at all, through tools, with broken code, or about another question."""
    from rillflow.operators import execute, reward_stage

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    k, size = F.col("conv_id") % 8, F.col("size").cast("string")
    answers = (F.concat(F.lit("FINAL_ANSWER: "), size), F.concat(F.lit("so \\boxed{"), size, F.lit("}")), F.concat(F.lit("FINAL_ANSWER: as many as "), F.when(F.col("size") % 3 == 0, "are there").otherwise("I like")), F.repeat(F.lit("FINAL_ANSWER: none\n"), F.col("n").cast("int")), F.lit("I do not know"), F.concat(F.lit("FINAL_ANSWER: "), size), F.concat(F.lit("FINAL_ANSWER: "), size), F.concat(F.lit("FINAL_ANSWER: "), size))
    last = F.element_at(F.array(*answers), (k + 1).cast("int"))
    call = "array<struct<name: string, arguments: string>>"
    code = F.to_json(F.struct(F.when(F.col("n") % 2 == 0, "x = 1").otherwise("raise ValueError(1)").alias("code")))
    calls = F.when(k == 5, F.array(F.struct(F.lit("create_tool").alias("name"), code.alias("arguments")), F.struct(F.lit("call_tool").alias("name"), F.lit('{"schema": "{}"}').alias("arguments"))))
    calls = calls.when(k == 6, F.array(F.struct(F.lit("create_tool").alias("name"), F.lit('{"code": "x = ("}').alias("arguments")))).when(k == 7, F.array(F.struct(F.lit("call_tool").alias("name"), F.lit('{"question": "How old is the captain?", "arguments": 3}').alias("arguments"))))
    message = lambda role, content, own: F.struct(role.alias("role"), content.alias("content"), F.lit(None).cast("string").alias("name"), own.cast(call).alias("tool_calls"))
    said = F.transform("turns", lambda t: message(F.lit("user"), t["text"], F.lit(None)))
    completions = turns.select(F.col("conv_id").cast("string").alias("rollout_id"), F.lit("How many letters are in all of these turns?").alias("question"), size.alias("answer"), F.array_append(said, message(F.lit("assistant"), last, calls)).alias("messages"))
    judge = execute.FunctionClient(lambda texts: ["yes" if "are there" in t else "no" for t in texts])
    kept = ("correctness_reward", "tool_usage_reward", "format_reward", "final_answer_spam_penalty", "tool_python_syntax_penalty", "tool_json_schema_penalty", "step1", "step2")
    return reward_stage.reward_table(completions, judge).select("rollout_id", *kept)


@query("""SELECT n_nationkey AS key, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 2 END AS rounds, CASE WHEN n_nationkey % 4 IN (1, 2) THEN 1 ELSE 0 END::BIGINT AS made, CASE WHEN n_nationkey % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS fine,
  CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 2 ELSE 5 END AS messages, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey % 3 = 0 WHEN 1 THEN true ELSE false END AS correct, CASE WHEN n_nationkey % 4 = 3 THEN 'ValueError: no model' END AS error FROM nation""")
def dialogue_rounds(spark, sf_dir):
    """Conversations that answer at once, call a tool, call one that is not there, or lose the model."""
    from rillflow.operators import dialogue
    from rillflow.sources.replay import batch_folder

    def model(messages, offered, choice):
        k = int(messages[1]["content"])
        if k % 4 == 3:
            raise ValueError("no model")
        if messages[-1]["role"] == "tool":
            return {"content": "FINAL_ANSWER: " + messages[-1]["content"]}
        if k % 4 == 0:
            return {"content": f"FINAL_ANSWER: {2 * k if k % 3 == 0 else 'none'}"}
        return {"tool_calls": [{"id": "1", "name": "twice" if k % 4 == 1 else "thrice", "arguments": f'{{"x": {k}}}'}]}

    schema = json.dumps([{"name": "twice", "description": "", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}}}])
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("string").alias("question"), (2 * F.col("n_nationkey")).cast("string").alias("target"), F.lit("def twice(x):\n    return 2 * x").alias("code"), jsonx.tool_definitions(F.lit(schema)).alias("tools"))
    log = dialogue.evaluate_dataset(n, dialogue.FunctionChat(model), batch_folder(spark), "gcd", max_rounds=3)
    return log.select("key", F.col("total_rounds").alias("rounds"), F.col("tool_calls_made").alias("made"), F.col("tool_calls_successful").alias("fine"), F.col("conversation_length").alias("messages"), "correct", "error")


@query("""SELECT 'twice' AS task, 1 AS attempt, count(*) AS hit, count(*) AS total, 1.0::DOUBLE AS accuracy FROM nation UNION ALL SELECT 'square', 0, count(*), count(*), 1.0::DOUBLE FROM nation""")
def tool_making(spark, sf_dir):
    """Two proposals for each of two tasks, run on a question per nation; the better one of each, the first of equals."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    tests = k.select(F.lit("twice").alias("task"), F.col("k").cast("string").alias("question"), (2 * F.col("k")).cast("string").alias("answer"))
    tests = tests.unionByName(k.select(F.lit("square").alias("task"), F.col("k").cast("string").alias("question"), (F.col("k") * F.col("k")).cast("string").alias("answer")))
    code = "def f(question):\n    return {0}"
    proposals = spark.createDataFrame([(t, a, code.format(e), "f") for t, a, e in (("twice", 0, "int(question) + 2"), ("twice", 1, "2 * int(question)"), ("square", 0, "int(question) ** 2"), ("square", 1, "int(question) * int(question)"))], "task string, attempt int, code string, function string")
    return evaluate.tool_making(proposals, tests).select("task", "attempt", "hit", "total", F.round("accuracy", 6).alias("accuracy"))
