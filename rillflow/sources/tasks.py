"""Seeded reasoning-task datasets: bands of generated rows, verified, tagged, deduplicated per split.

A row's content depends on task, split, band and row number alone, so any executor can make any row and reruns agree.
Rows are made in Arrow batches from spark.range; a generator returns question, answer and metadata, and a verifier of
its own recomputes the answer from the metadata. Rows that fail are set apart, not raised.
"""

from __future__ import annotations

import ast
import itertools
import json
import math
import random
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- Fixed values: bands of every task as (split, size, seed, parameters, difficulty) ------------------------------
T, V, R = "test", "validate", "train"


BANDS: dict[str, list[tuple]] = {
    "ab": [
        (T, 70, 42, {"length": 8}, 2),
        (T, 70, 42, {"length": 12}, 3),
        (T, 70, 42, {"length": 16}, 4),
        (V, 120, 42, {"length": 10}, 2),
        (R, 500, 42, {"length": 8}, 2),
        (R, 500, 42, {"length": 12}, 3),
    ],
    "base_conversion": [
        (T, 70, 42, {"min_base": 2, "max_base": 10, "min_value": 1, "max_value": 500}, 2),
        (T, 70, 42, {"min_base": 2, "max_base": 16, "min_value": 500, "max_value": 2000}, 3),
        (T, 70, 42, {"min_base": 2, "max_base": 16, "min_value": 2000, "max_value": 5000}, 4),
        (V, 120, 42, {"min_base": 2, "max_base": 12, "min_value": 1, "max_value": 1000}, 2),
        (R, 500, 42, {"min_base": 2, "max_base": 10, "min_value": 1, "max_value": 500}, 2),
        (R, 500, 42, {"min_base": 2, "max_base": 16, "min_value": 500, "max_value": 2000}, 3),
    ],
    "bitwise_arithmetic": [
        (T, 70, 42, {"difficulty": 2}, 2),
        (T, 70, 42, {"difficulty": 3}, 3),
        (T, 70, 42, {"difficulty": 4}, 4),
        (T, 70, 42, {"difficulty": 5}, 5),
        (V, 120, 42, {"difficulty": 2}, 2),
        (R, 500, 42, {"difficulty": 2}, 2),
        (R, 500, 42, {"difficulty": 3}, 3),
    ],
    "caesar_cipher": [
        (T, 70, 42, {"min_words": 3, "max_words": 10, "min_rotation": 1, "max_rotation": 10}, 2),
        (T, 70, 42, {"min_words": 8, "max_words": 15, "min_rotation": 8, "max_rotation": 18}, 3),
        (T, 70, 42, {"min_words": 12, "max_words": 20, "min_rotation": 15, "max_rotation": 25}, 4),
        (V, 120, 42, {"min_words": 3, "max_words": 12, "min_rotation": 1, "max_rotation": 15}, 2),
        (R, 500, 42, {"min_words": 3, "max_words": 10, "min_rotation": 1, "max_rotation": 10}, 2),
        (R, 500, 42, {"min_words": 8, "max_words": 15, "min_rotation": 8, "max_rotation": 18}, 3),
    ],
    "calendar_arithmetic": [
        (T, 70, 42, {}, 2),
        (T, 70, 42, {}, 3),
        (T, 70, 42, {}, 4),
        (V, 120, 42, {}, 2),
        (R, 500, 42, {}, 2),
    ],
    "chain_sum": [
        (T, 70, 42, {"min_terms": 2, "max_terms": 4, "min_digits": 1, "max_digits": 2}, 2),
        (T, 70, 42, {"min_terms": 3, "max_terms": 5, "min_digits": 2, "max_digits": 4}, 3),
        (T, 70, 42, {"min_terms": 4, "max_terms": 6, "min_digits": 3, "max_digits": 5}, 4),
        (V, 120, 42, {"min_terms": 2, "max_terms": 4, "min_digits": 1, "max_digits": 3}, 2),
        (R, 500, 42, {"min_terms": 2, "max_terms": 4, "min_digits": 1, "max_digits": 2}, 2),
        (R, 500, 42, {"min_terms": 3, "max_terms": 5, "min_digits": 2, "max_digits": 4}, 3),
    ],
    "count_bits": [
        (T, 70, 42, {"min_n": 1, "max_n": 1000000}, 2),
        (T, 70, 42, {"min_n": 1000000, "max_n": 10000000}, 3),
        (T, 70, 42, {"min_n": 10000000, "max_n": 100000000}, 4),
        (V, 120, 42, {"min_n": 1, "max_n": 5000000}, 2),
        (R, 500, 42, {"min_n": 1, "max_n": 1000000}, 2),
        (R, 500, 42, {"min_n": 1000000, "max_n": 10000000}, 3),
    ],
    "countdown": [
        (T, 70, 42, {"min_numbers": 4, "max_numbers": 4, "min_target": 10, "max_target": 100}, 2),
        (T, 70, 43, {"min_numbers": 5, "max_numbers": 5, "min_target": 10, "max_target": 150}, 3),
        (T, 70, 44, {"min_numbers": 6, "max_numbers": 6, "min_target": 10, "max_target": 200}, 4),
        (V, 120, 45, {"min_numbers": 4, "max_numbers": 5, "min_target": 10, "max_target": 100}, 2),
        (R, 250, 46, {"min_numbers": 4, "max_numbers": 4, "min_target": 10, "max_target": 100}, 2),
        (R, 250, 47, {"min_numbers": 5, "max_numbers": 5, "min_target": 10, "max_target": 150}, 3),
    ],
    "cryptarithm": [
        (T, 70, 42, {"letters": (1, 6)}, 2),
        (T, 70, 42, {"letters": (7, 8)}, 3),
        (T, 70, 42, {"letters": (9, 10)}, 4),
        (V, 120, 42, {"letters": (1, 10)}, 2),
        (R, 500, 42, {"letters": (1, 10), "first": 6}, 2),
    ],
    "gcd": [
        (T, 70, 42, {"min_numbers": 2, "max_numbers": 2, "min_value": 1, "max_value": 500}, 2),
        (T, 70, 42, {"min_numbers": 2, "max_numbers": 3, "min_value": 500, "max_value": 2000}, 3),
        (T, 70, 42, {"min_numbers": 3, "max_numbers": 4, "min_value": 1000, "max_value": 5000}, 4),
        (V, 120, 42, {"min_numbers": 2, "max_numbers": 2, "min_value": 1, "max_value": 1000}, 2),
        (R, 500, 42, {"min_numbers": 2, "max_numbers": 2, "min_value": 1, "max_value": 500}, 2),
        (R, 500, 42, {"min_numbers": 2, "max_numbers": 3, "min_value": 500, "max_value": 2000}, 3),
    ],
    "isomorphic_string": [
        (T, 70, 42, {"min_string_length": 10, "max_string_length": 19}, 2),
        (T, 140, 42, {"min_string_length": 20, "max_string_length": 30}, 3),
        (T, 140, 42, {"min_string_length": 31, "max_string_length": 40}, 5),
        (V, 120, 42, {"min_string_length": 3, "max_string_length": 12}, 2),
        (R, 500, 42, {"min_string_length": 3, "max_string_length": 12}, 2),
        (R, 500, 42, {"min_string_length": 10, "max_string_length": 19}, 3),
    ],
    "knights_knaves": [
        (T, 70, 42, {"n_people": 2, "depth_constraint": 2, "width_constraint": 3}, 2),
        (T, 70, 42, {"n_people": 3, "depth_constraint": 3, "width_constraint": 4}, 3),
        (T, 70, 42, {"n_people": 4, "depth_constraint": 4, "width_constraint": 5}, 4),
        (V, 120, 42, {"n_people": 2, "depth_constraint": 2, "width_constraint": 3}, 2),
        (R, 500, 42, {"n_people": 2, "depth_constraint": 2, "width_constraint": 3}, 2),
        (R, 500, 42, {"n_people": 3, "depth_constraint": 3, "width_constraint": 4}, 3),
    ],
    "lcm": [
        (T, 70, 42, {"min_numbers": 2, "max_numbers": 2, "min_value": 1, "max_value": 50}, 2),
        (T, 70, 42, {"min_numbers": 2, "max_numbers": 3, "min_value": 50, "max_value": 200}, 3),
        (T, 70, 42, {"min_numbers": 3, "max_numbers": 4, "min_value": 100, "max_value": 500}, 4),
        (V, 120, 42, {"min_numbers": 2, "max_numbers": 2, "min_value": 1, "max_value": 100}, 2),
        (R, 500, 42, {"min_numbers": 2, "max_numbers": 2, "min_value": 1, "max_value": 50}, 2),
        (R, 500, 42, {"min_numbers": 2, "max_numbers": 3, "min_value": 50, "max_value": 200}, 3),
    ],
    "polynomial_equations": [
        (T, 70, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 10, "min_degree": 1, "max_degree": 2}, 2),
        (T, 70, 42, {"min_terms": 3, "max_terms": 4, "min_value": 1, "max_value": 20, "min_degree": 2, "max_degree": 3}, 3),
        (T, 70, 42, {"min_terms": 4, "max_terms": 5, "min_value": 1, "max_value": 30, "min_degree": 2, "max_degree": 4}, 4),
        (T, 70, 42, {"min_terms": 5, "max_terms": 6, "min_value": 1, "max_value": 50, "min_degree": 3, "max_degree": 5}, 5),
        (V, 120, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 10, "min_degree": 1, "max_degree": 2}, 2),
        (R, 500, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 10, "min_degree": 1, "max_degree": 2}, 2),
        (R, 500, 42, {"min_terms": 3, "max_terms": 4, "min_value": 1, "max_value": 20, "min_degree": 2, "max_degree": 3}, 3),
    ],
    "polynomial_multiplication": [
        (T, 70, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 5, "min_degree": 1, "max_degree": 2}, 2),
        (T, 70, 42, {"min_terms": 3, "max_terms": 4, "min_value": 1, "max_value": 8, "min_degree": 2, "max_degree": 3}, 3),
        (T, 70, 42, {"min_terms": 4, "max_terms": 5, "min_value": 1, "max_value": 10, "min_degree": 2, "max_degree": 4}, 4),
        (T, 70, 42, {"min_terms": 5, "max_terms": 6, "min_value": 1, "max_value": 12, "min_degree": 3, "max_degree": 5}, 5),
        (V, 120, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 5, "min_degree": 1, "max_degree": 2}, 2),
        (R, 500, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 5, "min_degree": 1, "max_degree": 2}, 2),
        (R, 500, 42, {"min_terms": 3, "max_terms": 4, "min_value": 1, "max_value": 8, "min_degree": 2, "max_degree": 3}, 3),
    ],
    "prime_factorization": [
        (T, 70, 42, {"min_value": 2, "max_value": 500}, 2),
        (T, 70, 42, {"min_value": 500, "max_value": 2000}, 3),
        (T, 70, 42, {"min_value": 2000, "max_value": 5000}, 4),
        (V, 120, 42, {"min_value": 2, "max_value": 1000}, 2),
        (R, 500, 42, {"min_value": 2, "max_value": 500}, 2),
        (R, 500, 42, {"min_value": 500, "max_value": 2000}, 3),
    ],
    "propositional_logic": [
        (T, 150, 42, {"min_vars": 2, "max_vars": 2, "min_statements": 2, "max_statements": 3, "min_complexity": 1, "max_complexity": 2}, 2),
        (T, 150, 42, {"min_vars": 3, "max_vars": 3, "min_statements": 3, "max_statements": 4, "min_complexity": 2, "max_complexity": 3}, 3),
        (T, 150, 42, {"min_vars": 4, "max_vars": 4, "min_statements": 4, "max_statements": 5, "min_complexity": 3, "max_complexity": 4}, 4),
        (V, 250, 42, {"min_vars": 2, "max_vars": 2, "min_statements": 2, "max_statements": 3, "min_complexity": 1, "max_complexity": 2}, 2),
        (R, 1000, 42, {"min_vars": 2, "max_vars": 2, "min_statements": 2, "max_statements": 3, "min_complexity": 1, "max_complexity": 2}, 2),
        (R, 1000, 42, {"min_vars": 3, "max_vars": 3, "min_statements": 3, "max_statements": 4, "min_complexity": 2, "max_complexity": 3}, 3),
    ],
    "simple_equations": [
        (T, 70, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 10, "min_degree": 1, "max_degree": 1}, 2),
        (T, 70, 42, {"min_terms": 3, "max_terms": 4, "min_value": 1, "max_value": 20, "min_degree": 1, "max_degree": 1}, 3),
        (T, 70, 42, {"min_terms": 4, "max_terms": 5, "min_value": 1, "max_value": 30, "min_degree": 1, "max_degree": 1}, 4),
        (T, 70, 42, {"min_terms": 5, "max_terms": 6, "min_value": 1, "max_value": 50, "min_degree": 1, "max_degree": 1}, 5),
        (V, 120, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 10, "min_degree": 1, "max_degree": 1}, 2),
        (R, 500, 42, {"min_terms": 2, "max_terms": 3, "min_value": 1, "max_value": 10, "min_degree": 1, "max_degree": 1}, 2),
        (R, 500, 42, {"min_terms": 3, "max_terms": 4, "min_value": 1, "max_value": 20, "min_degree": 1, "max_degree": 1}, 3),
    ],
    "simple_integration": [
        (T, 70, 42, {"min_terms": 2, "max_terms": 3, "min_degree": 1, "max_degree": 2, "min_bounds": 1, "max_bounds": 5}, 2),
        (T, 70, 42, {"min_terms": 3, "max_terms": 4, "min_degree": 2, "max_degree": 3, "min_bounds": 1, "max_bounds": 8}, 3),
        (T, 70, 42, {"min_terms": 4, "max_terms": 5, "min_degree": 2, "max_degree": 4, "min_bounds": 1, "max_bounds": 10}, 4),
        (T, 70, 42, {"min_terms": 5, "max_terms": 6, "min_degree": 3, "max_degree": 5, "min_bounds": 1, "max_bounds": 12}, 5),
        (V, 120, 42, {"min_terms": 2, "max_terms": 3, "min_degree": 1, "max_degree": 2, "min_bounds": 1, "max_bounds": 5}, 2),
        (R, 500, 42, {"min_terms": 2, "max_terms": 3, "min_degree": 1, "max_degree": 2, "min_bounds": 1, "max_bounds": 5}, 2),
        (R, 500, 42, {"min_terms": 3, "max_terms": 4, "min_degree": 2, "max_degree": 3, "min_bounds": 1, "max_bounds": 8}, 3),
    ],
    "spell_backward": [
        (T, 70, 42, {"min_word_len": 3, "max_word_len": 6}, 2),
        (T, 70, 42, {"min_word_len": 6, "max_word_len": 9}, 3),
        (T, 70, 42, {"min_word_len": 9, "max_word_len": 12}, 4),
        (V, 120, 42, {"min_word_len": 3, "max_word_len": 10}, 2),
        (R, 500, 42, {"min_word_len": 3, "max_word_len": 6}, 2),
        (R, 500, 42, {"min_word_len": 6, "max_word_len": 9}, 3),
    ],
    "syllogism": [
        (T, 70, 42, {"invalid_ratio": 0.3}, 2),
        (T, 70, 42, {"invalid_ratio": 0.4, "inversion_probability": 0.3}, 3),
        (T, 70, 42, {"invalid_ratio": 0.5, "inversion_probability": 0.5}, 4),
        (V, 120, 42, {"invalid_ratio": 0.3}, 2),
        (R, 500, 42, {"invalid_ratio": 0.3}, 2),
        (R, 500, 42, {"invalid_ratio": 0.4, "inversion_probability": 0.3}, 3),
    ],
    "tower_of_hanoi": [
        (T, 70, 42, {"disks": (3, 3)}, 2),
        (T, 70, 42, {"disks": (4, 4)}, 3),
        (T, 70, 42, {"disks": (5, 5)}, 4),
        (V, 120, 42, {"disks": (3, 4)}, 2),
        (R, 250, 42, {"disks": (3, 3)}, 2),
        (R, 250, 42, {"disks": (4, 4)}, 3),
    ],
    "word_ladder": [
        (T, 70, 42, {"min_word_length": 4, "max_word_length": 4}, 2),
        (T, 70, 42, {"min_word_length": 4, "max_word_length": 5}, 3),
        (T, 70, 42, {"min_word_length": 5, "max_word_length": 5}, 4),
        (T, 70, 43, {"min_word_length": 5, "max_word_length": 5}, 5),
        (V, 120, 42, {"min_word_length": 4, "max_word_length": 4}, 2),
        (R, 500, 42, {"min_word_length": 4, "max_word_length": 4}, 2),
        (R, 500, 42, {"min_word_length": 4, "max_word_length": 5}, 3),
    ],
}
#: Rows of a split whose generator makes more than are wanted: kept per band, counted over the bands so far.
CAPS = {"propositional_logic": 70}
# -------------------------------------------------------------------------------------------------------------------

WORDS = "stone river candle orchard window marble thunder paper garden silver harbor ladder ocean pillow rocket saddle timber velvet walnut yellow anchor basket copper dragon engine falcon guitar hammer island jacket".split()
NAMES = "Ada Ben Cleo Dan Eve Finn Gil Hana".split()
SUBJECTS = "robots poets sailors bakers clouds tigers engines violins".split()
LADDERS = {4: "cold cord card ward warm worm word wood mood moon noon soon", 5: "stone store score scare stare state slate plate place plane plank blank"}

Row = tuple[str, str, dict]


def _ab(r: random.Random, p: dict) -> Row:
    s = "".join(r.choice("AB") for _ in range(p["length"]))
    period = r.randint(2, 4)
    s = (s[:period] * p["length"])[: p["length"]]
    return f"The symbols {' '.join(s)} repeat with period {period}. Which symbol comes next?", s[p["length"] % period], {"symbols": s, "period": period}


def _digits(n: int, base: int) -> str:
    return ("" if n < base else _digits(n // base, base)) + "0123456789abcdef"[n % base]


def _base(r: random.Random, p: dict) -> Row:
    n = r.randint(p["min_value"], p["max_value"])
    a, b = r.sample(range(p["min_base"], p["max_base"] + 1), 2)
    return f"Convert the base-{a} number {_digits(n, a)} to base {b}.", _digits(n, b), {"value": n, "from": a, "to": b}


def _bitwise(r: random.Random, p: dict) -> Row:
    expr = hex(r.randrange(1 << 16))
    for _ in range(p["difficulty"]):
        expr = f"({expr} {r.choice(['+', '-', '*', '>>', '<<'])} {hex(r.randrange(1 << 16))})" if r.random() < 0.6 else f"({expr} {r.choice(['>>', '<<'])} {hex(r.randint(0, 3))})"
    expr = " ".join(x if prev not in ("<<", ">>") else (hex(int(x.strip("()"), 16) % 4) + ")" * x.count(")")) for prev, x in zip(["", *expr.split()], expr.split(), strict=False))
    return f"Evaluate {expr} over signed integers of any size and answer in hexadecimal.", hex(_arith(expr)), {"problem": expr}


OPS: dict[type, Callable] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.LShift: lambda a, b: a << b, ast.RShift: lambda a, b: a >> b}


def _arith(expr: str) -> int:
    """An integer expression by its syntax tree; nothing is executed."""

    def value(n: ast.AST) -> int:
        if isinstance(n, ast.BinOp):
            return OPS[type(n.op)](value(n.left), value(n.right))
        if isinstance(n, ast.UnaryOp):
            return -value(n.operand)
        return n.value

    return value(ast.parse(expr, mode="eval").body)


def _caesar(r: random.Random, p: dict) -> Row:
    clear = " ".join(r.choice(WORDS) for _ in range(r.randint(p["min_words"], p["max_words"]))).upper()
    k = r.randint(p["min_rotation"], p["max_rotation"])
    turned = "".join(chr((ord(c) - 65 + k) % 26 + 65) if c != " " else c for c in clear)
    return f"Decrypt this Caesar cipher and give the clear text only: {turned}", clear, {"rotation": k, "cipher_text": turned}


def _calendar(r: random.Random, p: dict) -> Row:
    kind = r.randrange(5)
    day = date(r.randint(1900, 2100) if kind in (0, 4) else r.randint(2000, 2030), r.randint(1, 12), r.randint(1, 28))
    if kind == 0:
        return f"What day of the week is {day}?", day.strftime("%A"), {"kind": "weekday", "date": str(day)}
    if kind == 1:
        n, both = r.randint(30, 365), r.random() < 0.5
        return f"How many days are there from {day} to {day + timedelta(n)}{', counting both' if both else ''}?", str(n + both), {"kind": "between", "start": str(day), "end": str(day + timedelta(n)), "inclusive": both}
    if kind == 4:
        leap = day.year % 4 == 0 and (day.year % 100 != 0 or day.year % 400 == 0)
        return f"Is {day.year} a leap year? Answer Yes or No.", "Yes" if leap else "No", {"kind": "leap", "year": day.year}
    n = r.randint(1, 200) * (1 if kind == 2 else -1)
    return f"Which date is {abs(n)} days {'after' if n > 0 else 'before'} {day}? Answer as YYYY-MM-DD.", str(day + timedelta(n)), {"kind": "shift", "date": str(day), "days": n}


def _chain(r: random.Random, p: dict) -> Row:
    draw = lambda: r.randint(10 ** (k := r.randint(p["min_digits"], p["max_digits"]) - 1), 10 ** (k + 1) - 1)
    expr = str(draw()) + "".join(f" {r.choice('+-')} {draw()}" for _ in range(r.randint(p["min_terms"], p["max_terms"]) - 1))
    return f"Calculate {expr}.", str(_arith(expr)), {"expression": expr}


def _bits(r: random.Random, p: dict) -> Row:
    n = r.randint(p["min_n"], p["max_n"])
    return f"How many 1 bits are in the binary form of {n}?", str(n.bit_count()), {"number": n}


def _countdown(r: random.Random, p: dict) -> Row:
    while True:
        numbers = [r.randint(1, 50) for _ in range(r.randint(p["min_numbers"], p["max_numbers"]))]
        expr = str(numbers[0]) + "".join(f" {r.choice('+-*' if x < 10 else '+-')} {x}" for x in numbers[1:])
        if p["min_target"] <= _arith(expr) <= p["max_target"]:
            return f"Use each of {sorted(numbers)} once, with + - *, to reach {_arith(expr)}.", expr, {"numbers": sorted(numbers), "target": _arith(expr)}


#: The published word sums, in published order. One of them has no solution and is never drawn.
PUZZLES = (
    "SEND + MORE = MONEY", "TWO + TWO = FOUR", "EAT + THAT = APPLE", "HALF + HALF = WHOLE", "BASE + BALL = GAMES", "USA + USSR = PEACE", "EARTH + AIR = WATER", "COCA + COLA = OASIS",
    "FORTY + TEN + TEN = SIXTY", "ONE + ONE = TWO",
)


def solve_word_sum(puzzle: str) -> dict[str, int] | None:
    """First solution column by column from the right, without leading zeros; null if there is none."""
    left, _, result = puzzle.replace(" ", "").partition("=")
    words = left.split("+")
    heads = {w[0] for w in [*words, result] if len(w) > 1}
    columns = [([w[-1 - i] for w in words if i < len(w)], result[-1 - i]) for i in range(len(result))]

    def place(i: int, carry: int, known: dict[str, int]) -> dict[str, int] | None:
        if i == len(columns):
            return known if carry == 0 else None
        adds, total = columns[i]
        fresh = list(dict.fromkeys(c for c in [*adds, total] if c not in known))
        free = [d for d in range(10) if d not in known.values()]
        for digits in itertools.permutations(free, len(fresh)):
            trial = known | dict(zip(fresh, digits, strict=True))
            value = sum(trial[c] for c in adds) + carry
            if value % 10 == trial[total] and not any(trial.get(h) == 0 for h in heads):
                got = place(i + 1, value // 10, trial)
                if got:
                    return got
        return None

    return place(0, 0, {})


def _cryptarithm(r: random.Random, p: dict) -> Row:
    solved = {x: solve_word_sum(x) for x in PUZZLES[: p.get("first")]}
    fits = [x for x, digits in solved.items() if digits and p["letters"][0] <= len(digits) <= p["letters"][1]]
    puzzle = r.choice(fits)
    solution = solved[puzzle]
    return f"Solve this cryptarithm:\n\n{puzzle}\n\nEach letter stands for a different digit, and no number starts with 0.", str(dict(sorted(solution.items()))), {"puzzle": puzzle, "solution": solution}


def _numbers_task(fold: Callable, name: str) -> Callable:
    def make(r: random.Random, p: dict) -> Row:
        xs = [r.randint(p["min_value"], p["max_value"]) for _ in range(r.randint(p["min_numbers"], p["max_numbers"]))]
        return f"Find the {name} of {', '.join(map(str, xs))}. Give the number only.", str(reduce(fold, xs)), {"numbers": xs}

    return make


def _isomorphic(r: random.Random, p: dict) -> Row:
    n = r.randint(p["min_string_length"], p["max_string_length"])
    a = "".join(r.choice("abcdefgh") for _ in range(n))
    image = dict(zip("abcdefgh", r.sample("klmnopqrst", 8), strict=True))
    b = "".join(image[c] for c in a)
    if r.random() < 0.5:
        at = r.randrange(n)
        b = b[:at] + r.choice("klmnopqrst") + b[at + 1 :]
    same = [a.index(c) for c in a] == [b.index(c) for c in b]
    return f"Are the strings {a} and {b} isomorphic? Answer True or False.", str(same), {"words": [a, b]}


def _knights(r: random.Random, p: dict) -> Row:
    people = r.sample(NAMES, p["n_people"])
    while True:
        claims = [(who, r.choice([x for x in people if x != who]), r.choice(["knight", "knave"])) for who in people]
        worlds = [w for w in itertools.product((True, False), repeat=len(people)) if all((dict(zip(people, w, strict=True))[o] == (k == "knight")) == dict(zip(people, w, strict=True))[s] for s, o, k in claims)]
        if len(worlds) == 1:
            break
        people = r.sample(NAMES, p["n_people"])
        if len(worlds) > 1:
            # An inhabitant who says "I or the other is a knave" settles the symmetric cases.
            s = r.choice(people)
            o = r.choice([x for x in people if x != s])
            rest = [(x, o, "knave" if x == s else "knight") for x in people if x != o]
            claims = rest
            worlds = [w for w in itertools.product((True, False), repeat=len(people)) if _both(dict(zip(people, w, strict=True)), s, o) and all((dict(zip(people, w, strict=True))[b] == (k == "knight")) == dict(zip(people, w, strict=True))[a] for a, b, k in claims if a != s)]
            if len(worlds) == 1:
                w = dict(zip(people, worlds[0], strict=True))
                said = [f'{s} says: "At least one of {s} and {o} is a knave."', *(f'{a} says: "{b} is a {k}."' for a, b, k in claims if a != s)]
                return "Knights tell the truth and knaves lie. " + " ".join(said) + " Who is what?", ", ".join(f"{x} is a {'knight' if w[x] else 'knave'}" for x in people), {"people": people, "roles": [w[x] for x in people], "statements": str(said)}
    w = dict(zip(people, worlds[0], strict=True))
    said = [f'{a} says: "{b} is a {k}."' for a, b, k in claims]
    return "Knights tell the truth and knaves lie. " + " ".join(said) + " Who is what?", ", ".join(f"{x} is a {'knight' if w[x] else 'knave'}" for x in people), {"people": people, "roles": [w[x] for x in people], "statements": str(said)}


def _both(w: dict, s: str, o: str) -> bool:
    return (not w[s] or not w[o]) == w[s]


def _poly_text(c: dict[int, int], x: str = "x") -> str:
    terms = [f"{'-' if v < 0 else '+'} {'' if abs(v) == 1 and k else abs(v)}{'*' if abs(v) != 1 and k else ''}{'' if not k else x if k == 1 else f'{x}**{k}'}" for k, v in sorted(c.items(), reverse=True) if v]
    return (" ".join(terms) or "0").removeprefix("+ ")


def _poly_draw(r: random.Random, p: dict) -> dict[int, int]:
    degree = r.randint(p["min_degree"], p["max_degree"])
    return {k: r.choice([-1, 1]) * r.randint(p["min_value"], p["max_value"]) for k in {degree, *r.choices(range(degree + 1), k=r.randint(p["min_terms"], p["max_terms"]) - 1)}}


def _product(polys: list[dict]) -> dict[int, int]:
    out: dict[int, int] = {0: 1}
    for p in polys:
        out = reduce(lambda acc, kv: acc | {kv[0]: acc.get(kv[0], 0) + kv[1]}, ((a + b, x * y) for a, x in out.items() for b, y in p.items()), {})
    return out


def _poly_roots(r: random.Random, p: dict) -> Row:
    roots = sorted(r.randint(-p["max_value"], p["max_value"]) for _ in range(r.randint(p["min_degree"], p["max_degree"])))
    return f"Find the real roots of {_poly_text(_product([{1: 1, 0: -a} for a in roots]))} = 0, in ascending order.", ", ".join(map(str, sorted(set(roots)))), {"roots": roots}


def _poly_product(r: random.Random, p: dict) -> Row:
    polys = [_poly_draw(r, p) for _ in range(2 if p["max_degree"] < 4 else r.randint(2, 3))]
    return "Expand " + "".join(f"({_poly_text(q)})" for q in polys) + ".", _poly_text(_product(polys)), {"polynomials": [list(q.items()) for q in polys]}


def _primes(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        while n % d == 0:
            out.append(d)
            n //= d
        d += 1
    return out + [n] * (n > 1)


def _factors(r: random.Random, p: dict) -> Row:
    n = r.randint(p["min_value"], p["max_value"])
    return f"Write {n} as a product of primes, in ascending order, joined by ' × '.", " × ".join(map(str, _primes(n))), {"number": n}


def _logic(r: random.Random, p: dict) -> Row:
    names = "PQRS"[: r.randint(p["min_vars"], p["max_vars"])]
    world = {n: r.random() < 0.5 for n in names}

    def formula(depth: int) -> tuple[str, bool]:
        if depth == 0:
            n = r.choice(names)
            return n, world[n]
        a, x = formula(depth - 1)
        b, y = formula(r.randrange(depth))
        kind = r.randrange(4)
        return [(f"¬{a}", not x), (f"({a} ∧ {b})", x and y), (f"({a} ∨ {b})", x or y), (f"({a} → {b})", not x or y)][kind]

    text, truth = formula(r.randint(p["min_complexity"], p["max_complexity"]))
    given = ", ".join(f"{n} is {str(v).lower()}" for n, v in world.items())
    return f"Given that {given}, is {text} true? Answer True or False.", str(truth), {"world": world, "formula": text}


def _linear(r: random.Random, p: dict) -> Row:
    x, a, b = r.randint(-p["max_value"], p["max_value"]), r.randint(2, 1 + p["max_value"]), r.randint(1, p["max_value"])
    extra = [r.randint(1, p["max_value"]) for _ in range(r.randint(p["min_terms"], p["max_terms"]) - 2)]
    return f"Solve for x: {a}*x + {b}{''.join(f' + {e}' for e in extra)} = {a * x + b + sum(extra)}", str(x), {"a": a, "b": b + sum(extra), "total": a * x + b + sum(extra)}


def _integral(r: random.Random, p: dict) -> Row:
    degree = r.randint(p["min_degree"], p["max_degree"])
    anti = {k + 1: r.choice([-1, 1]) * r.randint(p["min_bounds"], p["max_bounds"]) for k in {degree, *r.choices(range(degree + 1), k=r.randint(p["min_terms"], p["max_terms"]) - 1)}}
    return f"Find the indefinite integral of {_poly_text({k - 1: v * k for k, v in anti.items()})} with respect to x.", _poly_text(anti) + " + C", {"antiderivative": list(anti.items())}


def _backward(r: random.Random, p: dict) -> Row:
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(p["min_word_len"], p["max_word_len"])))
    return f"Spell this word backward: {word}", word[::-1], {"word": word}


def _syllogism(r: random.Random, p: dict) -> Row:
    a, b, c = r.sample(SUBJECTS, 3)
    valid = r.random() >= p["invalid_ratio"]
    first, second = ("All", "All") if r.random() < 0.5 else ("No", "All")
    claim = f"{first} {c} are {a}" if valid else f"All {a} are {c}"
    premises = [f"{first} {b} are {a}", f"{second} {c} are {b}"]
    if r.random() < p.get("inversion_probability", 0):
        premises.reverse()
    return f"Premises: {'; '.join(premises)}. Does it follow that '{claim}'? Answer Yes or No.", "Yes" if valid else "No", {"premises": premises, "conclusion": claim, "valid": valid}


def _hanoi(r: random.Random, p: dict) -> Row:
    n = r.randint(*p["disks"])
    rods = "ABC" if n % 2 else "ACB"
    moves = [(rods[(m & (m - 1)) % 3], rods[((m | (m - 1)) + 1) % 3]) for m in range(1, 1 << n)]
    return f"Move {n} disks of the Tower of Hanoi from rod A to rod C with rod B to spare. Give the list of moves as (from, to) pairs.", str(moves), {"disks": n, "moves": len(moves)}


def _ladder(r: random.Random, p: dict) -> Row:
    chain = LADDERS[r.randint(p["min_word_length"], p["max_word_length"])].split()
    i = r.randrange(len(chain) - 2)
    part = chain[i : r.randint(i + 2, len(chain))]
    part = part if r.random() < 0.5 else part[::-1]
    return f"Change {part[0].upper()} to {part[-1].upper()} one letter at a time through {len(part) - 2} words. Give all words, joined by commas.", ",".join(part).upper(), {"start": part[0], "end": part[-1]}


GENERATORS: dict[str, Callable[[random.Random, dict], Row]] = {
    "ab": _ab, "base_conversion": _base, "bitwise_arithmetic": _bitwise, "caesar_cipher": _caesar, "calendar_arithmetic": _calendar, "chain_sum": _chain, "count_bits": _bits, "countdown": _countdown,
    "cryptarithm": _cryptarithm, "gcd": _numbers_task(math.gcd, "greatest common divisor"), "isomorphic_string": _isomorphic, "knights_knaves": _knights, "lcm": _numbers_task(math.lcm, "least common multiple"),
    "polynomial_equations": _poly_roots, "polynomial_multiplication": _poly_product, "prime_factorization": _factors, "propositional_logic": _logic, "simple_equations": _linear, "simple_integration": _integral,
    "spell_backward": _backward, "syllogism": _syllogism, "tower_of_hanoi": _hanoi, "word_ladder": _ladder,
}


def _word_sum_holds(puzzle: str, m: dict) -> bool:
    value = lambda w: int("".join(str(m[c]) for c in w.strip()))
    left, _, right = puzzle.partition("=")
    return bool(m) and len(set(m.values())) == len(m) and sum(map(value, left.split("+"))) == value(right)


#: Recomputes an answer from metadata alone; tasks without an entry are checked by construction.
VERIFIERS: dict[str, Callable[[str, dict], bool]] = {
    "base_conversion": lambda a, m: int(a, m["to"]) == m["value"],
    "bitwise_arithmetic": lambda a, m: int(a, 16) == _arith(m["problem"]),
    "chain_sum": lambda a, m: int(a) == _arith(m["expression"]),
    "count_bits": lambda a, m: int(a) == bin(m["number"]).count("1"),
    "countdown": lambda a, m: _arith(a) == m["target"] and sorted(int(x) for x in a.replace("+", " ").replace("-", " ").replace("*", " ").split()) == m["numbers"],
    "cryptarithm": lambda a, m: _word_sum_holds(m["puzzle"], m["solution"]),
    "gcd": lambda a, m: all(x % int(a) == 0 for x in m["numbers"]) and math.gcd(*(x // int(a) for x in m["numbers"])) == 1,
    "lcm": lambda a, m: all(int(a) % x == 0 for x in m["numbers"]) and math.gcd(*(int(a) // x for x in m["numbers"])) == 1,
    "prime_factorization": lambda a, m: math.prod(map(int, a.split(" × "))) == m["number"] and all(len(_primes(int(x))) == 1 for x in a.split(" × ")),
    "simple_equations": lambda a, m: m["a"] * int(a) + m["b"] == m["total"],
    "spell_backward": lambda a, m: a == "".join(reversed(m["word"])),
    "tower_of_hanoi": lambda a, m: len(ast.literal_eval(a)) == 2 ** m["disks"] - 1,
}

SCHEMA = "task string, split string, band int, ordinal long, question string, answer string, metadata string, difficulty int, verified boolean"


def generate(spark: SparkSession, task: str, scale: int = 1) -> DataFrame:
    """All bands of a task, before dedup; scale multiplies every band's size."""
    if task not in BANDS:
        raise ValueError(f"no task {task!r}; there are {', '.join(BANDS)}")
    bands = BANDS[task]
    starts = [0, *itertools.accumulate(b[1] * scale for b in bands)]

    def make(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                at = next(k for k in range(len(bands)) if i < starts[k + 1])
                split, _, seed, params, difficulty = bands[at]
                try:
                    # Bands with the same configuration and seed draw the same rows, whatever their split and size.
                    r = random.Random(f"{task}:{seed}:{json.dumps(params, sort_keys=True)}:{difficulty if not params else ''}:{i - starts[at]}")
                    question, answer, meta = GENERATORS[task](r, params)
                    fine = VERIFIERS.get(task, lambda a, m: a != "")(answer, meta)
                except (ValueError, KeyError, ArithmeticError):
                    question, answer, meta, fine = None, None, {}, False
                out.append((task, split, at, int(i), question, answer, json.dumps(meta), difficulty, bool(fine)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.range(starts[-1]).mapInPandas(make, SCHEMA)


def dataset(spark: SparkSession, task: str, scale: int = 1, without_overlap: bool = False) -> DataFrame:
    """Verified rows, the first of each question within its split; optionally without test questions that train has."""
    rows = generate(spark, task, scale).where("verified AND answer IS NOT NULL").drop("verified")
    if task in CAPS:
        # Test rows are capped cumulatively: a band may use what earlier bands left of their shares.
        nth = F.row_number().over(Window.partitionBy("split").orderBy("band", "ordinal"))
        share = F.when(F.col("split") == T, F.lit(CAPS[task] * scale) * (F.col("band") + 1))
        rows = rows.withColumn("_n", nth).where(share.isNull() | (F.col("_n") <= share)).drop("_n")
    first = Window.partitionBy("split", "question").orderBy("band", "ordinal")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "band")
    if without_overlap:
        train = rows.where(F.col("split") == R).select("question").distinct()
        rows = rows.where(F.col("split") != T).unionByName(rows.where(F.col("split") == T).join(train, "question", "left_anti").select(*rows.columns))
    return rows


def load_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of a split with the evaluation aliases; the train side of an evaluation is the `validate` split."""
    return df.where(F.col("split") == split).withColumns({"inputs": F.col("question"), "targets": F.col("answer")})


def write_datasets(spark: SparkSession, path: str, tasks: list[str] | None = None, force: bool = False) -> DataFrame:
    """Writes tasks partitioned by task and split; (task, status, error) with status ok, failed or skipped."""
    from pyspark.errors import PySparkException

    status = []
    for task in tasks or list(BANDS):
        target = f"{path}/task={task}"
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(target)
        if not force and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            status.append((task, "skipped", None))
            continue
        try:
            dataset(spark, task).drop("task").write.mode("overwrite").partitionBy("split").parquet(target)
            status.append((task, "ok", None))
        except (PySparkException, ValueError) as e:
            status.append((task, "failed", str(e)[:500]))
    return spark.createDataFrame(status, "task string, status string, error string")


def build_counts(status: DataFrame) -> DataFrame:
    """(status, n) of write_datasets' rows, with all three kinds."""
    kinds = status.sparkSession.createDataFrame([("ok",), ("failed",), ("skipped",)], "status string")
    return kinds.join(status.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, sum(b[1] for b in bs)) for t, bs in BANDS.items()], "task string, rows long")


def main(argv: list[str] | None = None) -> int:
    """--list, --all or --tasks A B, --out DIR, --force; 1 if any task failed."""
    import argparse

    parser = argparse.ArgumentParser(prog="rillflow.sources.tasks")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--all", action="store_true")
    parser.add_argument("--tasks", nargs="*", default=[])
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--out", default="datasets")
    args = parser.parse_args(argv)
    if args.list or not (args.all or args.tasks):
        print("\n".join(BANDS))
        return 0
    spark = SparkSession.builder.getOrCreate()
    status = write_datasets(spark, args.out, None if args.all else args.tasks, args.force)
    rows = status.collect()
    for r in rows:
        print(r["task"], r["status"], r["error"] or "")
    print(*(f"{r['status']}: {r['n']}" for r in build_counts(status).collect()), sep=", ")
    return int(any(r["status"] == "failed" for r in rows))


if __name__ == "__main__":
    raise SystemExit(main())
