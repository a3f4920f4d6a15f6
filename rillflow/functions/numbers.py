"""Date and number scalars behind the task generators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.text import _col


def is_leap_year(year: Column | str) -> Column:
    y = _col(year)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def day_of_week(date: Column | str) -> Column:
    return F.date_format(_col(date), "EEEE")


def days_between(start: Column | str, end: Column | str, inclusive: bool = False) -> Column:
    return F.datediff(_col(end), _col(start)) + (1 if inclusive else 0)


def add_days(date: Column | str, days: Column | int) -> Column:
    return F.date_add(_col(date), days)


def subtract_days(date: Column | str, days: Column | int) -> Column:
    return F.date_sub(_col(date), days)


@F.arrow_udf(T.LongType())
def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    none = np.array(a.is_null()) | np.array(b.is_null())
    return pa.array(np.gcd(a.fill_null(0).to_numpy(), b.fill_null(0).to_numpy()), pa.int64(), mask=none)


def gcd(a: Column | str, b: Column | str) -> Column:
    """Of two 64-bit integers, never negative; null for null. A batch at a time: Spark has no such function, and Euclid's
    steps, folded over an array in an expression, cost a hundred times as much."""
    return _gcd(_col(a).cast("long"), _col(b).cast("long"))


def lcm(a: Column | str, b: Column | str) -> Column:
    """Of two 64-bit integers; 0 if either is 0."""
    x, y = _col(a).cast("long"), _col(b).cast("long")
    g = gcd(x, y)
    return F.when((x == 0) | (y == 0), F.lit(0).cast("long")).otherwise((F.abs(x) / g).cast("long") * F.abs(y))


@F.arrow_udf(T.LongType())
def _gcd_all(values: pa.Array) -> pa.Array:
    return pa.array([math.gcd(*v) if v and None not in v else None for v in values.to_pylist()], pa.int64())


@F.arrow_udf(T.LongType())
def _lcm_all(values: pa.Array) -> pa.Array:
    return pa.array([math.lcm(*v) if v and None not in v else None for v in values.to_pylist()], pa.int64())


def fold_array(values: Column | str, kind: str) -> Column:
    """gcd or lcm of an array of integers; null where it is empty or holds null."""
    return (_gcd_all if kind == "gcd" else _lcm_all)(_col(values).cast("array<bigint>"))


def count_bits(n: Column | str) -> Column:
    return F.bit_count(_col(n))


def convert_base(digits: Column | str, base: int, to: int) -> Column:
    return F.lower(F.conv(_col(digits), base, to))


def caesar(text: Column | str, shift: int) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    k = shift % 26
    turned = upper[k:] + upper[:k]
    return F.translate(_col(text), upper + upper.lower(), turned + turned.lower())


def spell_backward(word: Column | str) -> Column:
    return F.reverse(_col(word))


def first_places(text: Column | str) -> Column:
    """For every character, where it first occurs: equal for isomorphic texts."""
    t = _col(text)
    return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(t, c))


def isomorphic(a: Column | str, b: Column | str) -> Column:
    return first_places(a) == first_places(b)


def prime_factors(n: Column | str) -> Column:
    """Ascending with repetition. Each candidate divisor up to the root is divided out as often as it goes."""
    v = _col(n).cast("long")
    start = F.struct(v.alias("rest"), F.array().cast("array<bigint>").alias("found"))

    def divide(acc: Column, d: Column) -> Column:
        times = F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.struct(acc["rest"].alias("rest"), F.lit(0).alias("k")), lambda s, _: F.when((s["rest"] % d) == 0, F.struct((s["rest"].cast("long") / d).cast("long").alias("rest"), (s["k"] + 1).alias("k"))).otherwise(s))
        return F.when(acc["rest"] % d == 0, F.struct(times["rest"].alias("rest"), F.concat(acc["found"], F.array_repeat(d, times["k"])).alias("found"))).otherwise(acc)

    roots = F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), F.ceil(F.sqrt(v)).cast("long")))
    got = F.aggregate(roots, start, divide)
    return F.when(v < 2, F.array().cast("array<bigint>")).when(got["rest"] > 1, F.array_append(got["found"], got["rest"])).otherwise(got["found"])


def hanoi_moves(disks: Column | str) -> Column:
    """The optimal moves A to C in closed form: move m goes from rod m & (m - 1) to rod (m | (m - 1)) + 1, modulo 3."""
    d = _col(disks).cast("int")
    count = F.pow(F.lit(2), d).cast("int") - 1
    rods = F.when(d % 2 == 1, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("A"), F.lit("C"), F.lit("B")))
    rod = lambda k: F.element_at(rods, (k % 3) + 1)
    return F.transform(F.sequence(F.lit(1), count), lambda m: F.struct(rod(m.bitwiseAND(m - 1)).alias("from"), rod(m.bitwiseOR(m - 1) + 1).alias("to")))


def chain_sum(text: Column | str) -> Column:
    """The value of numbers joined by + and -, whatever stands around them; 0 without a number."""
    terms = F.transform(F.regexp_extract_all(_col(text), F.lit(r"[+-]?\s*\d+"), F.lit(0)), lambda t: F.regexp_replace(t, r"\s", "").cast("long"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, t: acc + t)


def bitwise(a: Column | str, op: Column | str, b: Column | str) -> Column:
    """a op b for + - * << >> & | ^, over 64-bit integers; null for any other sign."""
    x, o, y = _col(a).cast("long"), _col(op), _col(b).cast("long")
    n = y.cast("int")
    out = F.when(o == "+", x + y).when(o == "-", x - y).when(o == "*", x * y).when(o == "<<", F.call_function("shiftleft", x, n)).when(o == ">>", F.call_function("shiftright", x, n))
    return out.when(o == "&", x.bitwiseAND(y)).when(o == "|", x.bitwiseOR(y)).when(o == "^", x.bitwiseXOR(y))


def linear_root(a: Column | str, b: Column | str, total: Column | str) -> Column:
    """x with a * x + b = total; null where a is 0."""
    return F.try_divide(_col(total) - _col(b), _col(a))


def poly_product(p: Column | str, q: Column | str) -> Column:
    """Coefficients of the product of two polynomials, both given from the constant term up."""
    a, b = _col(p), _col(q)
    term = lambda k: F.aggregate(F.sequence(F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)), F.lit(0).cast("long"), lambda acc, i: acc + F.get(a, i) * F.get(b, k - i))
    return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), term)


def poly_value(p: Column | str, x: Column | str) -> Column:
    """By Horner's rule."""
    return F.aggregate(F.reverse(_col(p)), F.lit(0.0), lambda acc, c: acc * _col(x).cast("double") + c)


def poly_integral(p: Column | str) -> Column:
    """Coefficients of the antiderivative whose constant is 0."""
    return F.concat(F.array(F.lit(0.0)), F.transform(_col(p), lambda c, i: c / (i + 1)))


def ladder_holds(words: Column | str) -> Column:
    """Whether each word of an array differs from the one before it in exactly one letter."""
    w = _col(words)
    near = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 1))
    return (F.size(w) < 2) | F.forall(near, lambda x: x)


def implies(a: Column | str, b: Column | str) -> Column:
    return ~_col(a) | _col(b)
