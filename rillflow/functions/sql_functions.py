"""The parsers of completions for users of SQL: scalar and table functions of a session, written in SQL.

    register(spark)
    spark.sql("SELECT c.id, b.at, b.body FROM completions c, LATERAL rf_code_blocks(c.text, 'python') b")

They are plain expressions, so the optimizer sees through them, nothing runs in Python, and a table function is a join with
what a row holds. Each says the same as its function of rillflow.functions; the catalogue holds both against each other.

Defined results: a null text gives null, or no rows; a call whose JSON does not parse is no call.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rillflow.functions.text import ANSWER_MARK, BOXED_ONE_LEVEL, META, THINK_END, TOOL_CALL

_FENCE = "`" * 3


def _literal(pattern: str) -> str:
    """A raw string of SQL: its backslashes are the pattern's."""
    if '"' in pattern:
        raise ValueError("a pattern must not hold double quotes")
    return f'r"{pattern}"'


def _last(pattern: str, text: str) -> str:
    return f"try_element_at(regexp_extract_all({text}, {_literal(pattern)}, 1), -1)"


def _trimmed(value: str) -> str:
    return f"regexp_replace({value}, {_literal('(?U)^' + chr(92) + 's+|' + chr(92) + 's+$')}, '')"


#: All before the first block, and the block.
FIRST_META = META.replace("(?s)", "(?s)^(.*?)", 1)
_THOUGHT = f"substring_index(t, '{THINK_END}', -1)"
_MARKED = rf"{ANSWER_MARK}:[ \t]*([^\n]*)"
#: name and parameters -> what it returns, and its SQL.
SCALARS = {
    "rf_strip_metadata(t STRING)": ("STRING", f"CASE WHEN regexp_like(t, {_literal(META)}) THEN {_trimmed(f'regexp_replace(t, {_literal(FIRST_META)}, {_literal(chr(36) + chr(49))})')} ELSE t END"),
    "rf_metadata(t STRING)": ("STRING", f"nullif(regexp_extract(t, {_literal(META)}, 1), '')"),
    "rf_answer_boxed(t STRING)": ("STRING", _trimmed(_last(BOXED_ONE_LEVEL, "t"))),
    "rf_answer_box_first(t STRING)": ("STRING", "coalesce(" + ", ".join(f"nullif({_trimmed(_last(p, _THOUGHT))}, '')" for p in (r"\\box\{([^{}]*)\}", BOXED_ONE_LEVEL, _MARKED)) + ")"),
    "rf_task_category(id STRING)": ("STRING", "CASE WHEN id IS NULL OR id = '' THEN 'unknown' ELSE substring_index(id, '-train-', 1) END"),
    "rf_exec_norm(raw DOUBLE, turns INT)": ("DOUBLE", "least(raw / (0.3D * turns), 1D)"),
    "rf_efficiency(turns DOUBLE, most INT)": ("DOUBLE", "CASE WHEN turns / most <= 0.5D THEN 1 - 0.6D * turns / most ELSE 0.7D * pow(1 - 2 * (least(turns / most, 1D) - 0.5D), 2) END"),
}
TABLES = {
    "rf_code_blocks(t STRING, lang STRING)": ("at INT, body STRING", f"SELECT p.at, p.body FROM (SELECT posexplode(regexp_extract_all(t, concat('(?s){_FENCE}', lang, {_literal(chr(92) + 'n(.*?)' + chr(92) + 'n' + _FENCE)}), 1)) AS (at, body)) p"),
    "rf_tool_calls(t STRING)": ("at INT, name STRING, arguments STRING", f"SELECT p.at, get_json_object(p.body, '$.name'), get_json_object(p.body, '$.arguments') FROM (SELECT posexplode(filter(regexp_extract_all(t, {_literal(TOOL_CALL)}, 1), x -> try_parse_json(x) IS NOT NULL)) AS (at, body)) p"),
    "rf_test_questions(t STRING)": ("at INT, question STRING, answer STRING", f"SELECT p.at, p.q.question, p.q.answer FROM (SELECT posexplode(from_json(regexp_extract(t, {_literal(META)}, 1), 'tool_test_set array<struct<question: string, answer: string>>').tool_test_set) AS (at, q)) p"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, in place of others of their names; their names."""
    for kind, functions in (("{}", SCALARS), ("TABLE ({})", TABLES)):
        for signature, (returns, body) in functions.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind.format(returns)} RETURN {body}")
    return [s.partition("(")[0] for s in (*SCALARS, *TABLES)]
