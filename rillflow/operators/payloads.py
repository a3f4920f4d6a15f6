"""Tool payloads of completions: arguments of structured calls, then tagged blocks of the last text; penalties and scores on them.

A completion is (rollout_id, messages) with messages array<struct<role, content, name, tool_calls array<struct<name, arguments>>>>.
A payload is a JSON object: the arguments of a call, or what stands between the tags. Arguments that are no object are no
payload; text that does not parse is one that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import jsonx, pycode, text, verify
from rillflow.operators.rewards import capped_penalty, step2_score

#: Fields of a payload that may hold a schema, in order.
SCHEMA_KEYS = ("schema", "json_schema", "tool_schema")
CREATE, CALL = "create_tool", "call_tool"


def tool_payloads(completions: DataFrame) -> DataFrame:
    """(rollout_id, pos, source, name, payload, invalid_json): one row per payload, in order; name is a structured call's."""
    m = completions.select("rollout_id", F.posexplode("messages").alias("turn", "m"))
    calls = m.select("rollout_id", "turn", F.posexplode("m.tool_calls").alias("at", "c"))
    calls = calls.select("rollout_id", F.struct(F.lit(0).alias("kind"), "turn", "at").alias("pos"), F.lit("call").alias("source"), F.col("c")["name"].alias("name"), F.col("c")["arguments"].alias("payload"))
    said = completions.select("rollout_id", F.posexplode(F.regexp_extract_all(text.unwrap_completion("messages"), F.lit(text.TOOL_CALL), F.lit(1))).alias("at", "payload"))
    blocks = said.select("rollout_id", F.struct(F.lit(1).alias("kind"), F.lit(0).alias("turn"), "at").alias("pos"), F.lit("block").alias("source"), F.lit(None).cast("string").alias("name"), "payload")
    rows = calls.unionByName(blocks).where("payload IS NOT NULL").withColumn("invalid_json", ~jsonx.is_json("payload"))
    return rows.where(F.col("invalid_json") | F.regexp_like("payload", F.lit(r"^\s*\{")))


def field_kind(payload: Column | str, key: str) -> Column:
    """What stands in a field of a JSON object: object, string, other, or null where it is missing or null."""
    p = F.col(payload) if isinstance(payload, str) else payload
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(p), f"$.{key}", "variant"))
    return F.when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind != "VOID", "other")


def _field_penalty(key: str, amount: float) -> Column:
    """For a field that is neither an object nor a string of JSON."""
    kind = field_kind("payload", key)
    valid = F.try_parse_json(F.get_json_object("payload", f"$.{key}")).isNotNull()
    return F.when((kind == "other") | ((kind == "string") & ~valid), amount).otherwise(0.0)


def tool_names(completions: DataFrame) -> DataFrame:
    """(rollout_id, names): names of structured calls and of tool messages, in order, each once."""
    said = F.flatten(F.transform("messages", lambda m: F.concat(F.transform(F.coalesce(m["tool_calls"], F.array()), lambda c: c["name"]), F.when(m["role"] == "tool", F.array(m["name"])).otherwise(F.array()))))
    return completions.select("rollout_id", F.array_distinct(F.filter(said, lambda n: n.isNotNull() & (n != ""))).alias("names"))


def penalties(completions: DataFrame, code: float = 1.0, bad_json: float = 0.5, schema: float = 0.5, cap: float = 2.0) -> DataFrame:
    """(rollout_id, python_penalty, json_penalty, both_penalty), each at most cap; 0 without payloads or fences."""
    each = tool_payloads(completions)
    each = each.withColumn("own_code", F.when(~F.col("invalid_json") & (field_kind("payload", "code") == "string"), F.get_json_object("payload", "$.code"))).withColumn("code_ok", pycode.py_facts("own_code")["ok"])
    py = F.when(F.col("own_code").isNotNull() & ~F.col("code_ok"), code).otherwise(0.0)
    bad = F.when(F.col("invalid_json"), bad_json).otherwise(_field_penalty("arguments", bad_json) + sum((_field_penalty(k, schema) for k in SCHEMA_KEYS), F.lit(0.0)))
    per = each.groupBy("rollout_id").agg(F.sum(py).alias("p"), F.sum(bad).alias("j"))
    fences = completions.withColumn("said", text.unwrap_completion("messages"))
    fences = fences.select("rollout_id", F.explode(F.concat(F.transform(text.code_blocks("said", "python"), lambda x: F.struct(F.lit("p").alias("k"), x.alias("body"))), F.transform(text.code_blocks("said", "json"), lambda x: F.struct(F.lit("j").alias("k"), x.alias("body"))))).alias("f"))
    fences = fences.select("rollout_id", F.col("f")["k"].alias("k"), F.col("f")["body"].alias("body")).withColumn("py_ok", pycode.py_facts("body")["ok"]).withColumn("js_ok", jsonx.is_json("body"))
    fence = fences.groupBy("rollout_id").agg((F.count_if((F.col("k") == "p") & ~F.col("py_ok")) * code).alias("fp"), (F.count_if((F.col("k") == "j") & ~F.col("js_ok")) * schema).alias("fj"))
    both = completions.select("rollout_id").join(per, "rollout_id", "left").join(fence, "rollout_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, j = zero("p") + zero("fp"), zero("j") + zero("fj")
    return both.select("rollout_id", capped_penalty(p, cap).alias("python_penalty"), capped_penalty(j, cap).alias("json_penalty"), capped_penalty(p + j, cap).alias("both_penalty"))


def created_code(completions: DataFrame) -> DataFrame:
    """(rollout_id, code): the code that a completion ends with, of its fenced blocks or else of its calls that create a tool; null
    without any, and where such a call's arguments do not parse."""
    made = tool_payloads(completions).where((F.col("source") == "call") & (F.col("name") == CREATE))
    own = F.when(~F.col("invalid_json"), F.get_json_object("payload", "$.code"))
    made = made.groupBy("rollout_id").agg(F.bool_or("invalid_json").alias("broken"), F.max_by(own, F.when(own != "", F.col("pos"))).alias("called"))
    fence = F.try_element_at(text.code_blocks(text.unwrap_completion("messages"), "python"), F.lit(-1)).alias("fenced")
    rows = completions.select("rollout_id", fence).join(made, "rollout_id", "left")
    return rows.select("rollout_id", F.when(~F.coalesce("broken", F.lit(False)), F.coalesce("fenced", "called")).alias("code"))


def step2_scores(completions: DataFrame) -> DataFrame:
    """(rollout_id, score) of a completion's last call of a tool, or else its last fenced JSON object: that it parses, and that the
    first schema field it has holds a schema. Anything among these that does not parse gives 0."""
    calls = tool_payloads(completions).where((F.col("source") == "call") & (F.col("name") == CALL))
    calls = calls.groupBy("rollout_id").agg(F.bool_or("invalid_json").alias("broken"), F.max_by("payload", "pos").alias("payload"))
    fenced = completions.select("rollout_id", F.posexplode(text.code_blocks(text.unwrap_completion("messages"), "json")).alias("at", "body")).withColumn("ok", jsonx.is_json("body"))
    fenced = fenced.groupBy("rollout_id").agg((~F.bool_and("ok")).alias("fence_broken"), F.max_by("body", F.when(F.regexp_like("body", F.lit(r"^\s*\{")), F.col("at"))).alias("fence"))
    rows = completions.select("rollout_id").join(calls, "rollout_id", "left").join(fenced, "rollout_id", "left")
    rows = rows.withColumn("broken", F.coalesce("broken", "fence_broken", F.lit(False))).withColumn("payload", F.coalesce("payload", "fence"))
    kinds, fine = [field_kind("payload", k) for k in SCHEMA_KEYS], F.lit(False)
    for key, kind in reversed(list(zip(SCHEMA_KEYS, kinds, strict=True))):
        valid = (kind == "object") | ((kind == "string") & F.try_parse_json(F.get_json_object("payload", f"$.{key}")).isNotNull())
        fine = F.when(kind.isNotNull(), valid).otherwise(fine)
    return rows.select("rollout_id", step2_score(~F.col("broken") & F.col("payload").isNotNull(), F.coalesce(fine, F.lit(False))).alias("score"))


def shifted(completions: DataFrame, question: str = "question") -> DataFrame:
    """(rollout_id, shifted): whether a completion's question-like arguments all miss its expected question."""
    args = tool_payloads(completions).where("NOT invalid_json").groupBy("rollout_id").agg(F.flatten(F.collect_list(jsonx.question_like_args("payload"))).alias("args"))
    rows = completions.select("rollout_id", F.col(question).alias("q")).join(args, "rollout_id", "left")
    return rows.select("rollout_id", F.coalesce(verify.context_shifted("args", "q"), F.lit(False)).alias("shifted"))
