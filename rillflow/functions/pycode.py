"""Facts about Python source, by one Arrow UDF; everything built on them is array algebra."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.jsonx import param_names
from rillflow.functions.text import _col

FUNCTION = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("params", T.ArrayType(T.StringType()))])
FACTS = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("functions", T.ArrayType(FUNCTION))])


def source_facts(code: str | None) -> tuple[bool, str | None, list[dict]]:
    """Whether it parses, the error, and definitions in breadth-first order: function, async, or class (with the parameters of
    its __init__ or else __call__)."""
    if not code:
        return False, "missing_python_code", []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return False, f"code_load_error: {type(e).__name__}", []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append({"name": node.name, "kind": "function" if isinstance(node, ast.FunctionDef) else "async", "params": [a.arg for a in node.args.args]})
        elif isinstance(node, ast.ClassDef):
            own = {m.name: m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
            method = own.get("__init__") or own.get("__call__")
            found.append({"name": node.name, "kind": "class", "params": [a.arg for a in method.args.args] if method else []})
    return True, None, found


@F.pandas_udf(FACTS)
def py_facts(code: pd.Series) -> pd.DataFrame:
    rows = [source_facts(x) for x in code]
    return pd.DataFrame({"ok": [r[0] for r in rows], "error": [r[1] for r in rows], "functions": [r[2] for r in rows]})


def function_names(facts: Column | str, with_async: bool = False) -> Column:
    kinds = ["function", "async"] if with_async else ["function"]
    return F.transform(F.filter(_col(facts)["functions"], lambda f: f["kind"].isin(kinds)), lambda f: f["name"])


def first_params(facts: Column | str) -> Column:
    own = F.filter(_col(facts)["functions"], lambda f: f["kind"] == "function")
    return F.coalesce(F.try_element_at(own, F.lit(1))["params"], F.array().cast("array<string>"))


def params_of(facts: Column | str, name: Column) -> Column:
    """Parameters of the last definition of that name, null without one."""
    return F.try_element_at(F.filter(_col(facts)["functions"], lambda f: f["kind"].isin("function", "async") & (f["name"] == name)), F.lit(-1))["params"]


def loadable(tools: Column | str, facts: Column | str) -> Column:
    """Definitions whose function exists in the code."""
    names = function_names(facts, with_async=True)
    return F.filter(_col(tools), lambda t: F.array_contains(names, t["name"]))


def alignment(facts: Column | str, tools: Column | str) -> Column:
    """Why code and the first tool do not agree, or null: equal sets of parameters, without self."""
    f, t = _col(facts), F.try_element_at(_col(tools), F.lit(1))
    own = F.try_element_at(F.filter(f["functions"], lambda x: x["name"] == t["name"]), F.lit(1))
    params = F.filter(own["params"], lambda p: p != "self")
    same = F.array_sort(F.array_distinct(params)) == F.array_sort(F.array_distinct(param_names(tools)))
    return F.when(~f["ok"], F.lit("syntax_error")).when(t["name"].isNull(), F.lit("missing_name")).when(own.isNull(), F.lit("function_not_found")).when(~same, F.lit("parameter_mismatch"))


def schema_params_covered(facts: Column | str, tools: Column | str) -> Column:
    """Every tool's properties are parameters of its function; a tool without properties passes."""
    f = _col(facts)

    def fine(t: Column) -> Column:
        wanted = F.coalesce(F.json_object_keys(F.get_json_object(t["parameters"], "$.properties")), F.array().cast("array<string>"))
        own = F.coalesce(params_of(f, t["name"]), F.array().cast("array<string>"))
        return (F.size(wanted) == 0) | (F.size(F.array_except(wanted, own)) == 0)

    return F.forall(_col(tools), fine)
