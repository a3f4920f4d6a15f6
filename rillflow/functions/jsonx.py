"""JSON scalars: tool schemas, arguments, judge scores. Built-in expressions; schema walks are Arrow UDFs.

Arguments are maps, whose entries keep their order; variants sort their keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.text import _col, after_think, blank_to_null

TOOLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("parameters", T.StringType())]))
DIMENSIONS = ("code_correctness", "code_clarity", "schema_quality", "schema_code_alignment", "overall_quality")
QUESTION_TOKENS = "question|problem|query|prompt|input|text"


def normalized_tools(raw: object, legacy: bool = False) -> list[dict]:
    """Tool definitions from a parsed schema of any accepted shape, each wrapped as {type, function}.

    legacy wraps every element again, as the older form does.
    """
    if isinstance(raw, dict):
        raw = raw["functions"] if "functions" in raw else raw["tools"] if "tools" in raw else raw
    found = [raw] if isinstance(raw, dict) else raw if isinstance(raw, list) else []
    tools = [x for x in found if isinstance(x, dict)]
    return [x if "function" in x and not legacy else {"type": "function", "function": x} for x in tools]


@F.pandas_udf(TOOLS)
def tool_definitions(schema: pd.Series) -> pd.Series:
    """array<struct<name, description, parameters>> of a schema text; empty where it does not parse."""

    def one(text: str | None) -> list[dict]:
        try:
            tools = normalized_tools(json.loads(text or ""))
        except ValueError:
            return []
        functions = [t["function"] for t in tools if isinstance(t.get("function"), dict)]
        return [{"name": f["name"] if isinstance(f.get("name"), str) else None, "description": f["description"] if isinstance(f.get("description"), str) else None, "parameters": json.dumps(f["parameters"]) if "parameters" in f else None} for f in functions]

    return schema.map(one)


def tool_names(tools: Column | str) -> Column:
    return F.filter(F.transform(_col(tools), lambda t: t["name"]), lambda n: n.isNotNull() & (n != ""))


def param_names(tools: Column | str) -> Column:
    """Of the first tool: the required parameters if any, else all properties, in order."""
    p = F.try_element_at(_col(tools), F.lit(1))["parameters"]
    required = F.from_json(F.get_json_object(p, "$.required"), "array<string>")
    every = F.json_object_keys(F.get_json_object(p, "$.properties"))
    return F.coalesce(F.when(F.size(required) > 0, required), every, F.array().cast("array<string>"))


def coerce_args(raw: Column | str) -> Column:
    """map<string,string> of a JSON object; empty for anything else. Values are JSON texts, strings unquoted."""
    return F.coalesce(F.from_json(_col(raw), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def remap_args(args: Column | str, expected: Column | str) -> Column:
    """Renames arguments to the expected parameters: one value to the first, equal counts by position, else unchanged."""
    a, e = _col(args), _col(expected)
    known = F.forall(F.map_keys(a), lambda k: F.array_contains(e, k))
    keep = (F.coalesce(F.size(e), F.lit(0)) <= 0) | (F.size(a) == 0) | known
    return F.when(keep, a).when(F.size(a) == 1, F.map_from_arrays(F.slice(e, 1, 1), F.map_values(a))).when(F.size(a) == F.size(e), F.map_from_arrays(e, F.map_values(a))).otherwise(a)


def judge_scores(reply: Column | str) -> Column:
    """struct of the five scores, each between 0 and 5; null if any is missing, no number or out of range."""
    t = after_think(_col(reply))
    fence = "`" * 3
    body = F.coalesce(blank_to_null(F.regexp_extract(t, rf"(?s){fence}json\s*(.*?)\s*{fence}", 1)), blank_to_null(F.regexp_extract(t, r"(?s)(\{.*\})", 1)), t)
    parsed = F.try_parse_json(body)
    each = [F.try_variant_get(parsed, f"$.{d}", "double") for d in DIMENSIONS]
    fine = each[0].between(0, 5)
    for x in each[1:]:
        fine = fine & x.between(0, 5)
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(*[x.alias(d) for x, d in zip(each, DIMENSIONS, strict=True)]))


def overall_quality(scores: Column | str) -> Column:
    """Mean of the four parts present (the overall one is left out), divided by 5; 0 for null."""
    s = _col(scores)
    parts = F.filter(F.array(*[s[d].cast("double") for d in DIMENSIONS[:4]]), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts) * F.lit(5.0)), F.lit(0.0))


def question_like_args(payload: Column | str) -> Column:
    """Values of arguments whose key contains a question-like word, and of top-level keys that are one."""
    p = _col(payload)
    inner = F.map_values(F.map_filter(coerce_args(F.get_json_object(p, "$.arguments")), lambda k, v: F.regexp_like(F.lower(k), F.lit(QUESTION_TOKENS))))
    outer = F.map_values(F.map_filter(coerce_args(p), lambda k, v: F.regexp_like(F.lower(k), F.lit(f"^({QUESTION_TOKENS})$"))))
    return F.concat(inner, outer)


def word_list_equal(text: Column | str, target: Column | str) -> Column:
    """The last json fence as a list of words equals the target split at spaces."""
    fence = "`" * 3
    last = F.try_element_at(F.regexp_extract_all(_col(text), F.lit(rf"(?s){fence}json\n(.*?)\n{fence}"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.from_json(last, "array<string>") == F.split(_col(target), " "), F.lit(False))


def valid_tool_calls(calls: Column | str, allowed: Column | str, fallback: Column | str) -> Column:
    """Calls whose name is allowed; with no allowed names, those that bear the fallback name."""
    a, f = _col(allowed), _col(fallback)
    return F.filter(_col(calls), lambda c: F.when(F.size(a) > 0, F.array_contains(a, c["name"])).otherwise(c["name"] == f))


def sampled_logprobs(tokens: Column | str) -> Column:
    """The first value of each token's map, or 0."""
    return F.transform(_col(tokens), lambda m: F.coalesce(F.try_element_at(F.map_values(m), F.lit(1)), F.lit(0.0)))


def append_model_tokens(ids: Column, mask: Column, logprobs: Column, new: Column, new_logprobs: Column) -> Column:
    """struct(ids, mask, logprobs) with mask 1 for the new tokens; missing logprobs count as 0."""
    given = F.coalesce(new_logprobs, F.array_repeat(F.lit(0.0), F.size(new)))
    return F.struct(F.concat(ids, new).alias("ids"), F.concat(mask, F.array_repeat(F.lit(1), F.size(new))).alias("mask"), F.concat(F.coalesce(logprobs, F.array_repeat(F.lit(0.0), F.size(ids))), given).alias("logprobs"))


def append_tool_tokens(ids: Column, mask: Column, logprobs: Column, new: Column) -> Column:
    zeros = F.array_repeat(F.lit(0.0), F.size(new))
    return F.struct(F.concat(ids, new).alias("ids"), F.concat(mask, F.array_repeat(F.lit(0), F.size(new))).alias("mask"), F.concat(F.coalesce(logprobs, F.array_repeat(F.lit(0.0), F.size(ids))), zeros).alias("logprobs"))


CHECK = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType())])


#: The types that a property may have.
JSON_TYPES = frozenset(("string", "number", "integer", "boolean", "array", "object", "null"))


def parameter_problems(parameters: object) -> Iterator[str]:
    """What is wrong with the parameters of a function, from the outside in."""
    if not isinstance(parameters, dict):
        yield "parameters_not_object"
        return
    if parameters.get("type") != "object":
        yield "parameters_type_not_object"
    known = parameters.get("properties")
    if not isinstance(known, dict):
        yield "properties_not_object"
        return
    for schema in known.values():
        kinds = schema.get("type") if isinstance(schema, dict) else None
        if not isinstance(schema, dict):
            yield "property_not_object"
        elif kinds is None:
            yield "property_without_type"
        elif not all(isinstance(k, str) and k in JSON_TYPES for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield "property_type_unknown"
    required = parameters.get("required")
    if required is not None and not isinstance(required, list):
        yield "required_not_list"
    elif required is not None:
        for name in required:
            if not isinstance(name, str):
                yield "required_not_string"
            elif name not in known:
                yield "required_not_in_properties"


def tool_problems(tool: object) -> Iterator[str]:
    function = tool.get("function") if isinstance(tool, dict) else None
    if not isinstance(function, dict):
        yield "function_not_object" if isinstance(tool, dict) else "tool_not_object"
        return
    if not isinstance(function.get("name"), str) or not function["name"].strip():
        yield "missing_name"
    if not isinstance(function.get("description"), str):
        yield "description_not_string" if "description" in function else "missing_description"
    yield from parameter_problems(function.get("parameters"))


def tools_problem(text: str | None) -> str | None:
    """Why a tools text is no valid list of function tools, the first problem of the first tool that has any; null if it is."""
    try:
        tools = json.loads(text or "")
    except ValueError:
        return "invalid_json"
    if not isinstance(tools, list) or not tools:
        return "not_a_nonempty_list"
    return next((problem for tool in tools for problem in tool_problems(tool)), None)


@F.pandas_udf(CHECK)
def tool_schema_check(tools: pd.Series) -> pd.DataFrame:
    reasons = tools.map(tools_problem)
    return pd.DataFrame({"ok": reasons.isna(), "reason": reasons})


COMPAT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("warnings", T.ArrayType(T.StringType()))])
#: Fixed values, in published order: what a grammar compiler cannot hold (errors) or ignores (warnings), by the kind of node.
ARRAY_ERRORS = ("uniqueItems", "contains", "minContains", "maxContains")
ARRAY_WARNINGS = ("minItems", "maxItems")
OBJECT_ERRORS = ("dependentRequired", "dependentSchemas")
STRING_WARNINGS = ("contentEncoding", "contentMediaType", "contentSchema")
#: Nodes that are visited at most; a schema whose references unfold to more is refused.
MOST_NODES = 20_000


def node_children(node: dict, path: str) -> Iterator[tuple[object, str]]:
    """The schemas within a node and their paths."""
    kind = node.get("type")
    if kind == "array" or "items" in node or "prefixItems" in node:
        yield from ((node.get(k), f"{path}/{k}") for k in ("items", "unevaluatedItems"))
        yield from listed(node, path, "prefixItems")
    if kind == "object" or "properties" in node:
        for group, quote in (("properties", ""), ("patternProperties", '"')):
            if isinstance(node.get(group), dict):
                yield from ((x, f"{path}/{group}/{quote}{k}{quote}") for k, x in node[group].items())
        yield node.get("additionalProperties"), f"{path}/additionalProperties"
    for group in ("anyOf", "oneOf", "allOf"):
        yield from listed(node, path, group)


def listed(node: dict, path: str, group: str) -> Iterator[tuple[object, str]]:
    if isinstance(node.get(group), list):
        yield from ((x, f"{path}/{group}[{i}]") for i, x in enumerate(node[group]))


def node_findings(node: dict) -> tuple[list[str], list[str]]:
    """Errors and warnings of one node, without those within."""
    errors, warnings, kind, items = [], [], node.get("type"), node.get("items")
    if kind == "array" or "items" in node or "prefixItems" in node:
        if items is not None and not isinstance(items, (dict, bool)):
            errors.append("items must be a schema")
        errors += [k for k in ARRAY_ERRORS if k in node]
        warnings += [k for k in ARRAY_WARNINGS if k in node]
    if kind == "object" or "properties" in node:
        errors += [k for k in OBJECT_ERRORS if k in node]
    if kind == "string":
        warnings += [k for k in STRING_WARNINGS if k in node]
    return errors, warnings + [k for k in ("if", "not") if isinstance(node.get(k), dict)]


def compat_findings(schema: object) -> tuple[list[str], list[str]]:
    """Errors and warnings of a JSON schema, sorted; nodes are visited from a work list, a reference once on each way down."""
    if not isinstance(schema, dict):
        return ["#: a schema must be an object"], []
    errors: set[str] = set()
    warnings: set[str] = set()
    defs = schema.get("$defs", schema.get("definitions"))
    todo: list[tuple[object, str, frozenset]] = [(schema, "#", frozenset())]
    visited = 0
    while todo:
        node, path, seen = todo.pop()
        if not isinstance(node, dict):
            continue
        visited += 1
        if visited > MOST_NODES:
            return ["#: references unfold to too many schemas"], []
        if "$ref" in node:
            ref = node["$ref"]
            name = ref.rpartition("/")[2] if isinstance(ref, str) and ref.startswith(("#/$defs/", "#/definitions/")) else None
            if isinstance(defs, dict) and name in defs and ref not in seen:
                todo.append((defs[name], f"{path}/$ref({name})", seen | {ref}))
            continue
        own_errors, own_warnings = node_findings(node)
        errors.update(f"{path}: {x}" for x in own_errors)
        warnings.update(f"{path}: {x}" for x in own_warnings)
        todo += [(x, at, seen) for x, at in node_children(node, path)]
    return sorted(errors), sorted(warnings)


@F.pandas_udf(COMPAT)
def schema_compat(schema: pd.Series) -> pd.DataFrame:
    def one(text: str | None) -> tuple[bool, list[str], list[str]]:
        try:
            errors, warnings = compat_findings(json.loads(text or ""))
        except ValueError:
            errors, warnings = ["#: invalid JSON"], []
        return not errors, errors, warnings

    rows = [one(x) for x in schema]
    return pd.DataFrame({"ok": [r[0] for r in rows], "errors": [r[1] for r in rows], "warnings": [r[2] for r in rows]})


@F.pandas_udf(T.BooleanType())
def is_json(text: pd.Series) -> pd.Series:
    """Strict: trailing text makes it invalid."""

    def one(x: str | None) -> bool:
        try:
            json.loads(x or "")
        except ValueError:
            return False
        return True

    return text.map(one)
