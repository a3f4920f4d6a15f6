"""Equality predicates and puzzle verifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.text import after_think, _col, normalize_answer, normalize_question

INT_TEXT = r"^[+-]?(0[xX](_?[0-9a-fA-F])+|0[oO](_?[0-7])+|0[bB](_?[01])+|0(_?0)*|[1-9](_?[0-9])*)$"
FLOAT_TEXT = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def int_key(text: Column) -> Column:
    """A text that is equal for equal integers in any base prefix; null where the text is no integer.

    Integers below 2^63 become decimal; larger ones keep base and digits, so they are equal within one base.
    """
    t = F.lower(F.replace(text, F.lit("_"), F.lit("")))
    sign = F.when(F.startswith(t, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(t, "^[+-]", "")
    base = F.when(F.startswith(body, F.lit("0x")), 16).when(F.startswith(body, F.lit("0o")), 8).when(F.startswith(body, F.lit("0b")), 2).otherwise(10)
    digits = F.regexp_replace(F.when(base == 10, body).otherwise(F.substring(body, 3, 1 << 30)), "^0+(?=.)", "")
    bits = F.when(base == 16, 15).when(base == 8, 20).when(base == 2, 62).otherwise(18)
    small = F.when(base == 16, F.conv(digits, 16, 10)).when(base == 8, F.conv(digits, 8, 10)).when(base == 2, F.conv(digits, 2, 10)).otherwise(digits)
    value = F.when(F.length(digits) <= bits, small).otherwise(F.concat(base.cast("string"), F.lit(":"), digits))
    return F.when(F.regexp_like(text, F.lit(INT_TEXT)), F.when(value == "0", value).otherwise(F.concat(sign, value)))


def number(text: Column) -> Column:
    """The text as a double after dropping commas and dollar signs; null where it is none (NaN and infinities included)."""
    t = F.translate(text, ",$", "")
    return F.when(F.regexp_like(t, F.lit(FLOAT_TEXT)), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def contains_word(text: Column, word: Column) -> Column:
    """Whether word occurs in text with no letter or digit next to it; both lower-case. Split, not a pattern per row."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    edge = lambda left, right: ~F.regexp_like(left, F.lit("[a-z0-9]$")) & ~F.regexp_like(right, F.lit("^[a-z0-9]"))
    return F.exists(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: edge(F.element_at(parts, i), F.element_at(parts, i + 1))) & (F.size(parts) > 1)


def answers_match(predicted: Column | str, truth: Column | str) -> Column:
    """Ordered cascade: equal, equal but for case, equal integers, close numbers, short truth as a word of the prediction."""
    p, g = normalize_answer(predicted), normalize_answer(truth)
    a, b = number(p), number(g)
    close = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) < 1e-6
    word = (F.length(g) <= 10) & b.isNull() & F.contains(F.lower(p), F.lower(g))
    yes = (p == g) | (F.lower(p) == F.lower(g)) | F.coalesce(int_key(p) == int_key(g), F.lit(False)) | F.coalesce(close, F.lit(False)) | F.when(word, contains_word(F.lower(p), F.lower(g))).otherwise(False)
    return F.when((p == "") | (g == ""), F.lit(False)).otherwise(yes)


def exact(predicted: Column | str, truth: Column | str) -> Column:
    return F.coalesce(_col(predicted) == _col(truth), F.lit(False))


def calendar_match(predicted: Column | str, truth: Column | str) -> Column:
    """Equal, equal but for case, or the first run of digits is the truth as an integer."""
    p, g = _col(predicted), _col(truth)
    digits = F.regexp_extract(p, r"(\d+)", 1).try_cast("long")
    return F.coalesce((p == g) | (F.lower(p) == F.lower(g)) | (digits == g.try_cast("long")), F.lit(False))


def letters_value(word: Column, mapping: Column) -> Column:
    """The number that a word spells under a map from letters to digits; null where a letter has none."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, ch: acc * 10 + F.try_element_at(mapping, ch))


def cryptarithm_holds(words: Column | str, result: Column | str, mapping: Column | str, leading_zero: bool = False) -> Column:
    """Exactly the puzzle's letters, distinct digits, no leading zero unless allowed, and words that add up to the result."""
    w, r, m = _col(words), _col(result), _col(mapping)
    letters = F.array_sort(F.array_distinct(F.filter(F.split(F.concat(F.array_join(w, ""), r), ""), lambda c: c != "")))
    digits = F.map_values(m)
    every = F.array_append(w, r)
    sum_ = F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + letters_value(x, m))
    fine = (F.array_sort(F.map_keys(m)) == letters) & F.forall(digits, lambda d: d.between(0, 9)) & (F.size(F.array_distinct(digits)) == F.size(digits)) & (sum_ == letters_value(r, m))
    if not leading_zero:
        fine = fine & F.forall(every, lambda x: (F.length(x) == 1) | (F.try_element_at(m, F.substring(x, 1, 1)) != 0))
    return F.coalesce(fine, F.lit(False))


def parse_assignments(text: Column | str) -> Column:
    """map<string,int> of `A=1, B=2`; null where a digit is no integer."""
    pairs = F.transform(F.split(F.regexp_replace(F.upper(_col(text)), r"\s+", ""), ","), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).try_cast("int").alias("v")))
    fine = F.forall(pairs, lambda x: x["v"].isNotNull() & F.regexp_like(x["k"], F.lit("^[A-Z]$"))) & (F.size(F.array_distinct(F.transform(pairs, lambda x: x["k"]))) == F.size(pairs))
    return F.when(fine, F.map_from_entries(pairs))


def parse_letter_dict(text: Column | str) -> Column:
    """map<string,int> of the first {...} literal, with either kind of quotes."""
    body = F.regexp_extract(_col(text), r"(\{[^{}]*\})", 1)
    return F.from_json(F.replace(body, F.lit("'"), F.lit('"')), "map<string,int>")


def same_map(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b)), F.lit(False))


def cryptarithm_parse(puzzle: Column | str) -> tuple[Column, Column]:
    """Words and result of the first `AA + BB = CC` in a question."""
    sum_ = F.regexp_extract(_col(puzzle), r"([A-Z]+(?:\s*\+\s*[A-Z]+)+\s*=\s*[A-Z]+)", 1)
    flat = F.regexp_replace(sum_, r"\s+", "")
    return F.split(F.substring_index(flat, "=", 1), "\\+"), F.substring_index(flat, "=", -1)


def cryptarithm_block(question: Column | str) -> Column:
    """struct(words, result, leading_zero) of a word sum set out in lines: words, dashes, the result; null without one."""
    q = _col(question)
    body = r"(?s)cryptarithm:\s*\n\n(.*?)\n\nEach letter"
    lines = F.filter(F.transform(F.split(F.regexp_extract(q, body, 1), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def read(rows: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda x: F.regexp_like(x, F.lit("^-+$"))), True).cast("int")
        after = F.filter(F.slice(rows, at + 1, F.size(rows)), lambda x: ~F.regexp_like(x, F.lit("^-+$")))
        words = F.transform(F.slice(rows, F.lit(1), at - 1), lambda x: F.regexp_replace(x, r"^\+\s*", ""))
        found = (at > 1) & (F.size(after) > 0)
        return F.when(found, F.struct(words.alias("words"), F.get(after, F.lit(0)).alias("result"), F.contains(q, F.lit("Leading letters may be zero")).alias("leading_zero")))

    return F.get(F.transform(F.array(lines), lambda rows: F.when(F.array_contains(F.transform(rows, lambda x: F.regexp_like(x, F.lit("^-+$"))), True), read(rows))), F.lit(0))


def letter_digits(text: Column | str) -> Column:
    """map<string,int> of the parts `A=1` of a text cut at commas; parts without = are left out, of a letter's the last counts;
    null where a digit is no integer, or none is given."""
    parts = F.filter(F.split(_col(text), ","), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).try_cast("int").alias("v")))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda later: later["k"] == p["k"]))
    return F.get(F.transform(F.array(pairs), lambda ps: F.when((F.size(ps) > 0) & F.forall(ps, lambda p: p["v"].isNotNull()), F.map_from_entries(last(ps)))), F.lit(0))


def cryptarithm_solved(question: Column | str, predicted: Column | str) -> Column:
    """Whether an answer solves the word sum of its question; false where the question has none."""
    sum_ = cryptarithm_block(question)
    given = letter_digits(predicted)
    strict, loose = (cryptarithm_holds(sum_["words"], sum_["result"], given, zero) for zero in (False, True))
    return F.coalesce(sum_.isNotNull() & given.isNotNull() & F.when(sum_["leading_zero"], loose).otherwise(strict), F.lit(False))


def knights_roles(text: Column | str) -> Column:
    """Sorted distinct 'name:role' of the statements `X is a knight/knave`."""
    p = r"(?i)\b([a-z]+)\s+is\s+an?\s+([a-z]+)"
    t = _col(text)
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("r"))
    return F.array_sort(F.array_distinct(F.transform(both, lambda x: F.lower(F.concat(x["n"], F.lit(":"), x["r"])))))


def knights_match(predicted: Column | str, truth: Column | str) -> Column:
    p, g = knights_roles(predicted), knights_roles(truth)
    return F.coalesce((F.size(p) > 0) & (p == g), F.lit(False))


def parse_moves(text: Column | str) -> Column:
    """array<struct<from,to>> of every pair of quoted rods in the text."""
    p = r"\(\s*['\"]([A-C])['\"]\s*,\s*['\"]([A-C])['\"]\s*\)"
    t = _col(text)
    return F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("f"), F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("t")), lambda x: F.struct(x["f"].alias("from"), x["t"].alias("to")))


def hanoi_valid(moves: Column | str, disks: Column | str, source: str = "A", target: str = "C") -> Column:
    """Simulates moves: never from an empty rod, never a larger disk on a smaller one, all disks on the target at the end."""
    rods = ["A", "B", "C"]
    full = F.reverse(F.sequence(F.lit(1), _col(disks).cast("int")))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(True).alias("ok"), *[(full if r == source else none).alias(r) for r in rods])

    def step(acc: Column, move: Column) -> Column:
        pick = lambda which: F.coalesce(*[F.when(which == r, acc[r]) for r in rods])
        frm, to = pick(move["from"]), pick(move["to"])
        disk, top = F.try_element_at(frm, F.lit(-1)), F.try_element_at(to, F.lit(-1))
        ok = acc["ok"] & (move["from"] != move["to"]) & disk.isNotNull() & (top.isNull() | (top > disk))
        after = lambda r: F.when(~ok, acc[r]).when(move["from"] == r, F.slice(acc[r], F.lit(1), F.greatest(F.size(acc[r]) - 1, F.lit(0)))).when(move["to"] == r, F.array_append(acc[r], disk)).otherwise(acc[r])
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), *[after(r).alias(r) for r in rods])

    end = F.aggregate(_col(moves), start, step)
    return end["ok"] & (F.size(end[target]) == _col(disks))


def disks_of_solution(moves: Column | str, compat: bool = False) -> Column:
    """Disks of an optimal solution of n moves: log2(n + 1). compat: n // 2 + 1, which is wrong from three disks on."""
    n = F.size(_col(moves))
    return (F.floor(n / 2) + 1 if compat else F.round(F.log2(n + 1.0))).cast("int")


def hanoi_match(predicted: Column | str, truth: Column | str, compat: bool = False) -> Column:
    p, g = parse_moves(predicted), parse_moves(truth)
    return (p == g) | hanoi_valid(p, disks_of_solution(g, compat))


def context_shifted(arguments: Column | str, question: Column | str) -> Column:
    """Whether question-like arguments (array of texts) exist and none matches the expected question."""
    q = normalize_question(question)
    said = F.transform(_col(arguments), lambda a: normalize_question(a))
    near = lambda a: (a != "") & ((a == q) | ((F.length(a) >= 20) & (F.contains(a, q) | F.contains(q, a))))
    return (F.size(said) > 0) & (q != "") & ~F.exists(said, near)


def yes_no(reply: Column | str) -> Column:
    """A judge's reply as a boolean: true only if it begins with yes, after what it thought."""
    return F.coalesce(F.startswith(F.lower(F.regexp_replace(after_think(_col(reply)), r"^\s+", "")), F.lit("yes")), F.lit(False))
