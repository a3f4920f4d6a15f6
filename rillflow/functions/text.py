"""Text scalars over model completions: every function maps Columns to a Column of built-in expressions.

The four final-answer extractors have different precedence and stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags and marks of the completion format.
META_TAG = "tool_rl_metadata"
META = rf"(?s)<{META_TAG}>\s*(.*?)\s*</{META_TAG}>"
TOOL_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
THINK_END = "</think>"
TOOL_RESPONSE_END = "</tool_response>"
ANSWER_MARK = "FINAL_ANSWER"
ANSWER_TAG = r"(?i)FINAL[_\s]*ANSWER\s*:"
BOXED_ONE_LEVEL = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
MAIN_GUARD = r"^if\s+__name__\s*==\s*['\"]__main__['\"]\s*:"

UNICODE_SPACE = r"(?U)\s+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_space(text: Column | str) -> Column:
    """Trims all Unicode white space."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def meta_json(prompt: Column | str) -> Column:
    """The first metadata block's body, or null."""
    t = _col(prompt)
    return F.when(F.regexp_like(t, F.lit(META)), F.regexp_extract(t, META, 1))


def strip_metadata(prompt: Column | str) -> Column:
    """The prompt without its first metadata block, trimmed; unchanged where there is none."""
    t = _col(prompt)
    block = F.regexp_extract(t, rf"(?s)(<{META_TAG}>\s*.*?\s*</{META_TAG}>)", 1)
    at = F.position(block, t)
    return F.when(block == "", t).otherwise(strip_space(F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(block), F.length(t)))))


def code_blocks(text: Column | str, language: str) -> Column:
    """Bodies of the fences opened with this language; a body starts and ends at a line feed."""
    fence = "`" * 3
    return F.regexp_extract_all(_col(text), F.lit(rf"(?s){fence}{language}\n(.*?)\n{fence}"), F.lit(1))


def fence_languages(text: Column | str) -> Column:
    """Lower-cased languages of opening fences, with their bodies' fences paired off."""
    fence = "`" * 3
    found = F.regexp_extract_all(_col(text), F.lit(rf"(?s){fence}([^\n`]*)\n.*?{fence}"), F.lit(1))
    return F.transform(found, lambda x: F.lower(F.trim(x)))


def one_python_one_json(text: Column | str) -> Column:
    langs = fence_languages(text)
    only = lambda name: F.size(F.filter(langs, lambda x: x == name)) == 1
    return (F.size(langs) == 2) & only("python") & only("json")


def chatml_messages(text: Column | str) -> Column:
    """array<struct<role, content>>, or null where the text holds no message."""
    t, p = _col(text), r"(?s)<\|im_start\|>([a-z]+)\n(.*?)<\|im_end\|>"
    got = F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("r"), F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("c")), lambda x: F.struct(x["r"].alias("role"), strip_space(x["c"]).alias("content")))
    return F.when(F.size(got) > 0, got)


def chatml_render(messages: Column | str, generate: bool = True) -> Column:
    parts = F.transform(_col(messages), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(parts, ""), F.lit("<|im_start|>assistant\n" if generate else ""))


def tool_call_blocks(text: Column | str) -> Column:
    """JSON texts of the tool-call blocks that parse."""
    return F.filter(F.regexp_extract_all(_col(text), F.lit(TOOL_CALL), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())


def answer_boxed(text: Column | str) -> Column:
    """A: the last \\boxed{} with at most one further level of braces."""
    return strip_space(F.try_element_at(F.regexp_extract_all(_col(text), F.lit(BOXED_ONE_LEVEL), F.lit(1)), F.lit(-1)))


def after_think(text: Column) -> Column:
    return F.substring_index(text, THINK_END, -1)


def answer_box_first(text: Column | str) -> Column:
    """B: after the thoughts, the last \\box{}, else the last \\boxed{}, else the last marked line, if not empty."""
    t = after_think(_col(text))
    last = lambda p: blank_to_null(strip_space(F.try_element_at(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.lit(-1))))
    return F.coalesce(last(r"\\box\{([^{}]*)\}"), last(BOXED_ONE_LEVEL), last(rf"{ANSWER_MARK}:[ \t]*([^\n]*)"))


def balanced_boxed(text: Column | str) -> Column:
    """The body of the last \\boxed{ whose braces balance, at any depth, by a fold over characters; null if none closes."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.when(acc["end"] >= 0, acc["depth"]).when(ch == "{", acc["depth"] + 1).when(ch == "}", acc["depth"] - 1).otherwise(acc["depth"])
        end = F.when((acc["end"] < 0) & (depth == 0), acc["at"]).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), end.alias("end"))

    def body(tail: Column) -> Column:
        end = F.aggregate(F.split(tail, ""), start, step)["end"]
        return F.when(end >= 0, F.substring(tail, F.lit(1), end))

    tails = lambda parts: F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: body(F.array_join(F.slice(parts, i, F.size(parts)), "\\boxed{")))
    found = F.transform(F.array(F.split(_col(text), r"\\boxed\{", -1)), lambda parts: F.when(F.size(parts) > 1, F.try_element_at(F.filter(tails(parts), lambda x: x.isNotNull()), F.lit(-1))))
    return F.get(found, F.lit(0))


def answer_rewards(text: Column | str) -> Column:
    """C: after the thoughts, the last marked line if it is not empty, else the last balanced \\boxed{}, else an <answer> element."""
    t = after_think(_col(text))
    marked = blank_to_null(strip_space(F.try_element_at(F.regexp_extract_all(t, F.lit(rf"{ANSWER_TAG}\s*([^\n\r]*)"), F.lit(1)), F.lit(-1))))
    tagged = F.when(F.regexp_like(t, F.lit(r"(?s)<answer>.*?</answer>")), strip_space(F.regexp_extract(t, r"(?s)<answer>(.*?)</answer>", 1)))
    return F.coalesce(marked, strip_space(balanced_boxed(t)), tagged)


def answer_offline(text: Column | str, keep_star: bool = False) -> Column:
    """D: the first line after the last mark, without colons (and asterisks), trimmed; the whole text without a mark."""
    tail = F.substring_index(_col(text), ANSWER_MARK, -1)
    return strip_space(F.substring_index(strip_space(F.translate(tail, ":" if keep_star else ":*", "")), "\n", 1))


def normalize_answer(answer: Column | str) -> Column:
    """Without asterisks, surrounding quotes and blanks, closing full stops; white space collapsed. Null is ''."""
    t = F.btrim(F.translate(F.coalesce(_col(answer).cast("string"), F.lit("")), "*", ""), F.lit("\"'` \t\n"))
    return F.trim(F.regexp_replace(F.rtrim(t, F.lit(".")), UNICODE_SPACE, " "))


def normalize_question(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+", " "))


def unwrap_completion(messages: Column | str) -> Column:
    """Text of the last assistant message; else of the last message, after its last tool response."""
    m = _col(messages)
    own = F.try_element_at(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(-1))["content"]
    return F.coalesce(own, F.substring_index(F.try_element_at(m, F.lit(-1))["content"], TOOL_RESPONSE_END, -1), F.lit(""))


def remove_main_guard(code: Column | str) -> Column:
    """Without `if __name__ == "__main__":` blocks: the line and all deeper or blank lines after it, by leading blanks."""
    c = _col(code)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(-1).alias("inside"), F.lit(False).alias("cut"))

    def step(acc: Column, line: Column) -> Column:
        indent = F.length(line) - F.length(F.ltrim(line))
        guard = F.regexp_like(F.ltrim(line), F.lit(MAIN_GUARD))
        within = (acc["inside"] >= 0) & ((F.trim(line) == "") | (indent > acc["inside"]))
        inside = F.when(within, acc["inside"]).when(guard, indent).otherwise(F.lit(-1))
        return F.struct(F.when(within | guard, acc["kept"]).otherwise(F.array_append(acc["kept"], line)).alias("kept"), inside.alias("inside"), (acc["cut"] | guard).alias("cut"))

    got = F.aggregate(F.split(c, "\n", -1), start, step)
    return F.when(got["cut"], F.array_join(got["kept"], "\n")).otherwise(c)


def safe_preview(text: Column | str, limit: int = 240) -> Column:
    return F.left(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\n"), F.lit("\\n")), F.lit(limit))


def format_messages(messages: Column | str) -> Column:
    return F.array_join(F.transform(_col(messages), lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), F.coalesce(m["content"], F.lit("")))), "\n\n")


def user_question(question: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _col(question))


def few_shot_block(examples: Column | str) -> Column:
    """Question and answer of each array element, numbered from 1."""
    return F.array_join(F.transform(_col(examples), lambda e, i: F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(": "), e["question"], F.lit("\nAnswer: "), e["answer"], F.lit("\n\n"))), "")


def judge_prompt(questions: Column | str, code: Column | str, schema: Column | str) -> Column:
    """At most three questions of 300 characters, and code of 6,000."""
    c = _col(code)
    cut = F.when(F.length(c) > 6000, F.concat(F.left(c, F.lit(6000)), F.lit("\n# ... truncated"))).otherwise(c)
    asked = F.array_join(F.transform(F.slice(_col(questions), 1, 3), lambda q: F.concat(F.lit("- "), F.left(q, F.lit(300)))), "\n")
    return F.concat(F.lit("Questions:\n"), asked, F.lit("\n\nCode:\n"), cut, F.lit("\n\nSchema:\n"), _col(schema))


def template_delta(before: Column | str, after: Column | str, result: Column | str) -> Column:
    """What the tool message added to the rendered chat; a plain line where the rendering did not extend the former one."""
    a, b = _col(after), _col(before)
    return F.when(F.startswith(a, b), F.substring(a, F.length(b) + 1, F.length(a))).otherwise(F.concat(F.lit("\n\nTool result: "), _col(result)))


def answer_tag_count(text: Column | str) -> Column:
    t = _col(text)
    return F.greatest(F.regexp_count(t, F.lit(ANSWER_TAG)), F.regexp_count(t, F.lit(r"\\boxed\{")))


def clip(text: Column | str, size: int, end: bool = False) -> Column:
    return (F.right if end else F.left)(_col(text), F.lit(size))


def task_category(task_id: Column | str) -> Column:
    """The id before '-train-'; the whole id without it; 'unknown' for a null or empty id, '' where the id starts with the mark."""
    t = _col(task_id)
    return F.when(t.isNull() | (t == ""), F.lit("unknown")).otherwise(F.substring_index(t, "-train-", 1))


def task_type(value: Column | str) -> Column:
    return F.lower(F.coalesce(blank_to_null(_col(value)), F.lit("use")))
