"""Propositional logic as columns: formulas to postfix, truth tables as bits of a 64-bit number, entailment, knights and knaves.

A formula has variables (letters, digits, _), parentheses and NOT, AND, OR, IMPLIES, IFF (or ¬ ∧ ∨ → ↔, ~ & | -> <->), which
bind in that order; IMPLIES groups to the right. With n <= MOST variables in order of their names, bit w of a table is the
formula's truth in world w, where variable i is bit i of w. So a connective is one operation on numbers for all worlds, and
a table costs as many as the formula has signs. All of it is folds of higher-order functions; no row leaves the JVM.

A formula that is malformed, names a variable that is not given, or has more than MOST gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.text import _col

MOST = 6
NOT, AND, OR, IMPLIES, IFF = "¬", "∧", "∨", "→", "↔"
#: How each sign may be written, and how firmly it binds.
SPELLINGS = ((IFF, r"<->|<=>|(?i:\bIFF\b)"), (IMPLIES, r"->|=>|(?i:\bIMPLIES\b)"), (AND, r"&|(?i:\bAND\b)"), (OR, r"\||(?i:\bOR\b)"), (NOT, r"~|!|(?i:\bNOT\b)"))
FIRMNESS = IFF + IMPLIES + OR + AND + NOT
TOKEN = "[()¬∧∨→↔]|[A-Za-z_][A-Za-z0-9_]*"
#: Variable i over the 64 worlds of six variables, and by number of variables the bits that are worlds.
_signed = lambda x: x - (1 << 64) if x >> 63 else x
VARIABLES = [_signed(sum(1 << w for w in range(64) if w >> i & 1)) for i in range(MOST)]
WORLDS = [_signed((1 << (1 << n)) - 1) for n in range(MOST + 1)]


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """result(value), for which value is computed once."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def tokens(formula: Column | str) -> Column:
    """Signs and names of a formula in order; null where other characters stand in it."""
    text = _col(formula)
    for sign, spelling in SPELLINGS:
        text = F.regexp_replace(text, spelling, sign)
    found = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    return _let(text, lambda t: _let(found(t), lambda f: F.when(F.array_join(f, "") == F.regexp_replace(t, r"\s+", ""), f)))


def _binds(sign: Column) -> Column:
    return F.instr(F.lit(FIRMNESS), sign)


def postfix(signs: Column | str) -> Column:
    """Tokens in postfix order; null where they are no formula. Signs that wait are kept on a stack, and leave it when one that
    binds less comes, or the parenthesis ends."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("ops"), F.lit(True).alias("wants"), F.lit(True).alias("ok"))

    def last(ops: Column, stays: object) -> Column:
        """Place (from 1) of the last sign of the stack that stays, or 0."""
        at = F.array_position(F.reverse(F.transform(ops, stays)), True)
        return F.when(at > 0, F.size(ops) - at + 1).otherwise(0).cast("int")

    def moved(acc: Column, kept: Column) -> Column:
        return F.concat(acc["out"], F.reverse(F.slice(acc["ops"], kept + 1, F.size(acc["ops"]))))

    def step(acc: Column, t: Column) -> Column:
        closes, sign, waits = t == ")", t.isin(AND, OR, IMPLIES, IFF), t.isin("(", NOT)
        stays = lambda o: (o == "(") | (~closes & ((_binds(o) < _binds(t)) | ((t == IMPLIES) & (o == IMPLIES))))

        def placed(kept: Column) -> Column:
            fits = F.when(closes, ~acc["wants"] & (kept > 0)).when(sign, ~acc["wants"]).otherwise(acc["wants"])
            out = F.when(waits, acc["out"]).when(closes | sign, moved(acc, kept)).otherwise(F.array_append(acc["out"], t))
            ops = F.when(waits, F.array_append(acc["ops"], t)).when(closes, F.slice(acc["ops"], F.lit(1), F.greatest(kept - 1, F.lit(0)))).when(sign, F.array_append(F.slice(acc["ops"], F.lit(1), kept), t)).otherwise(acc["ops"])
            return F.struct(out.alias("out"), ops.alias("ops"), (waits | sign).alias("wants"), (acc["ok"] & fits).alias("ok"))

        return _let(F.when(closes | sign, last(acc["ops"], stays)).otherwise(F.size(acc["ops"])), placed)

    done = lambda acc: F.when(acc["ok"] & ~acc["wants"] & ~F.array_contains(acc["ops"], "("), F.concat(acc["out"], F.reverse(acc["ops"])))
    return F.aggregate(_col(signs), start, step, done)


def names(signs: Column | str) -> Column:
    """The variables of tokens, sorted."""
    return F.array_sort(F.array_distinct(F.filter(_col(signs), lambda t: t.rlike("^[A-Za-z_]"))))


def _apply(sign: Column, a: Column, b: Column) -> Column:
    return F.when(sign == AND, a.bitwiseAND(b)).when(sign == OR, a.bitwiseOR(b)).when(sign == IMPLIES, F.bitwise_not(a).bitwiseOR(b)).when(sign == IFF, F.bitwise_not(a.bitwiseXOR(b)))


def worlds(variables: Column | str) -> Column:
    """The bits that are worlds of an array of variables; null for more than MOST."""
    return F.get(F.array(*[F.lit(w).cast("long") for w in WORLDS]), F.size(_col(variables)))


def table(order: Column | str, variables: Column | str) -> Column:
    """The truth table (long) of tokens in postfix order over the worlds of the variables, which may be more than its own."""
    masks = F.array(*[F.lit(v).cast("long") for v in VARIABLES])
    top = lambda s, k: F.try_element_at(s, F.lit(-k))

    def over(known: Column) -> Column:
        def step(stack: Column, t: Column) -> Column:
            binary = t.isin(AND, OR, IMPLIES, IFF)
            value = F.when(t == NOT, F.bitwise_not(top(stack, 1))).when(binary, _apply(t, top(stack, 2), top(stack, 1))).otherwise(F.get(masks, F.nullif(F.array_position(known, t), F.lit(0)).cast("int") - 1))
            rest = F.size(stack) - F.when(t == NOT, 1).when(binary, 2).otherwise(0)
            return F.array_append(F.slice(stack, F.lit(1), F.greatest(rest, F.lit(0))), value)

        return F.try_element_at(F.aggregate(_col(order), F.array().cast("array<bigint>"), step), F.lit(-1)).bitwiseAND(worlds(known))

    return _let(_col(variables), over)


def truth_table(formula: Column | str, variables: Column | str | None = None) -> Column:
    """A formula's table over its own variables, or the given ones."""
    return _let(tokens(formula), lambda signs: table(postfix(signs), names(signs) if variables is None else _col(variables)))


def models(bits: Column | str) -> Column:
    """In how many worlds a table holds."""
    return F.bit_count(_col(bits)).cast("long")


def world_of(assignment: Column | str, variables: Column | str) -> Column:
    """The number of the world of a map<string, boolean>; null where it lacks a variable."""
    given = _col(assignment)
    return F.aggregate(F.reverse(_col(variables)), F.lit(0), lambda acc, v: acc * 2 + F.try_element_at(given, v).cast("int"))


def evaluate(formula: Column | str, assignment: Column | str) -> Column:
    """A formula's truth under a map<string, boolean> of its variables."""
    return _let(tokens(formula), lambda signs: _let(names(signs), lambda own: F.getbit(table(postfix(signs), own), world_of(assignment, own)) == 1))


def entails(premises: Column | str, conclusion: Column | str) -> Column:
    """Whether an array of formulas makes another true in each world where all of them are."""
    read = F.transform(F.array_append(_col(premises), _col(conclusion)), lambda f: _let(tokens(f), lambda signs: F.struct(postfix(signs).alias("order"), names(signs).alias("names"))))

    def follows(formulas: Column) -> Column:
        variables = F.array_sort(F.array_distinct(F.flatten(F.transform(formulas, lambda f: f["names"]))))
        tables = _let(variables, lambda known: F.transform(formulas, lambda f: table(f["order"], known)))
        # All bits at first: those beyond the worlds go with the first table.
        return _let(tables, lambda t: F.aggregate(F.slice(t, F.lit(1), F.size(t) - 1), F.bitwise_not(F.try_element_at(t, F.lit(-1))), lambda acc, p: acc.bitwiseAND(p)).bitwiseAND(worlds(variables)) == 0)

    return _let(read, follows)


# ---- knights and knaves ------------------------------------------------------------------------------------------
#: Words of statements given as nested tuples, and the signs they stand for.
TUPLE_TOKEN = r"[()]|\d+|[a-z][a-z-]*|->|<=>"
TUPLE_SIGNS = {"and": AND, "or": OR, "->": IMPLIES, "<=>": IFF}


def statement_masks(text: Column | str) -> Column:
    """array<long>: the worlds in which each statement of a tuple of tuples holds, such as
    (('and', ('telling-truth', 0), ('lying', 1)), ('not', ('lying', 0))); and, or take any number of parts.

    Tokens are read from the end: a closing parenthesis leaves a mark, and a word joins what stands above the last mark.
    """
    masks = F.array(*[F.lit(v).cast("long") for v in VARIABLES])
    found = F.regexp_extract_all(F.regexp_replace(_col(text), "['\",]", " "), F.lit(TUPLE_TOKEN), F.lit(0))
    mark = F.lit(None).cast("bigint")

    def join(sign: Column, parts: Column) -> Column:
        """parts: first last."""
        first = F.try_element_at(parts, F.lit(-1))
        return F.aggregate(F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))), first, lambda acc, x: _apply(sign, acc, x))

    def step(stack: Column, t: Column) -> Column:
        at = F.array_position(F.reverse(F.transform(stack, lambda x: x.isNull())), True)  # 1 more than the parts above the mark
        above = F.when(at > 0, at - 1).otherwise(F.size(stack)).cast("int")
        parts, below = F.slice(stack, F.size(stack) - above + 1, above), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - above - 1, F.lit(0)))
        one = F.try_element_at(parts, F.lit(1))
        sign = F.lit(None).cast("string")
        for word, s in TUPLE_SIGNS.items():
            sign = F.when(t == word, s).otherwise(sign)
        value = F.when(t == "not", F.bitwise_not(one)).when(t == "telling-truth", F.get(masks, one.cast("int"))).when(t == "lying", F.bitwise_not(F.get(masks, one.cast("int")))).otherwise(join(sign, parts))
        return F.when(t == ")", F.array_append(stack, mark)).when(t == "(", stack).when(t.rlike("^[0-9]"), F.array_append(stack, t.try_cast("bigint"))).otherwise(F.array_append(below, value))

    ended = F.aggregate(F.reverse(found), F.array().cast("array<bigint>"), step)
    return F.reverse(F.filter(ended, lambda x: x.isNotNull()))


def knights_worlds(statements: Column | str) -> Column:
    """Bits of the worlds in which just the knights' statements hold; statements[i], a mask, is person i's. Null for more
    than MOST people."""
    said, masks = _col(statements), F.array(*[F.lit(v).cast("long") for v in VARIABLES])
    fits = F.zip_with(said, F.slice(masks, F.lit(1), F.least(F.size(said), F.lit(MOST))), lambda s, v: F.bitwise_not(s.bitwiseXOR(v)))
    return F.aggregate(fits, worlds(said), lambda acc, x: acc.bitwiseAND(x))


def knights_solution(statements: Column | str, people: Column | str) -> Column:
    """`A is a knight, B is a knave` of the one world that fits; null where none or several do. people: names in order."""
    fits, who = knights_worlds(statements), _col(people)
    world = F.bit_count(fits - 1)  # of one bit: its place
    said = F.transform(who, lambda p, i: F.concat(p, F.lit(" is a "), F.when(F.call_function("shiftright", world, i).bitwiseAND(F.lit(1)) == 1, "knight").otherwise("knave")))
    return F.when(F.bit_count(fits) == 1, F.array_join(said, ", "))


def statements_from_claims(text: Column | str, people: Column | str) -> Column:
    """Masks of claims in words, a sentence a person: `A says "B is a knave."`, `... "A and B are both knights."`, `... "At least one of
    A and B is a knave."`, and formulas of such parts with and, or, not. In order of people; null where one says nothing readable."""
    t, who = _col(text), _col(people)

    def one(person: Column) -> Column:
        said = F.call_function("regexp_extract", t, F.concat(F.lit(r"\b"), person, F.lit(r' says:? *"([^"]*)"')), F.lit(1))
        said = F.regexp_replace(said, r"(?i)at least one of (\w+) and (\w+) is a knave", "(not $1 or not $2)")
        said = F.regexp_replace(said, r"(?i)(\w+) and (\w+) are both knaves", "(not $1 and not $2)")
        said = F.regexp_replace(said, r"(?i)(\w+) and (\w+) are both knights", "($1 and $2)")
        said = F.regexp_replace(F.regexp_replace(said, r"(?i)(\w+) is a knight", "$1"), r"(?i)(\w+) is a knave", "(not $1)")
        signs = tokens(F.regexp_replace(said, r"[.!]", ""))
        return F.when(F.size(signs) > 0, table(postfix(signs), who))

    return F.transform(who, one)
