"""Formulas, entailment, knights and knaves, and word ladders against plain Python."""

import itertools
import random
from collections import deque

from pyspark.sql import functions as F

from rillflow.functions import logic
from rillflow.operators import ladder

WORDS = {"∧": "AND", "∨": "or", "→": "IMPLIES", "↔": "<->", "¬": "~"}
TRUTH = {"∧": lambda a, b: a and b, "∨": lambda a, b: a or b, "→": lambda a, b: not a or b, "↔": lambda a, b: a == b}
LEVEL = {"∧": 4, "∨": 3, "→": 2, "↔": 1}


def made(r, names, depth):
    """(tree, text): text has only the parentheses that it needs, or some more."""
    if depth == 0 or r.random() < 0.15:
        n = r.choice(names)
        return n, n, 9
    if r.random() < 0.25:
        tree, text, level = made(r, names, depth - 1)
        return ("¬", tree), r.choice(["¬", "~", "not "]) + (f"({text})" if level < 5 else text), 5
    sign = r.choice(list(TRUTH))
    (a, ta, la), (b, tb, lb) = made(r, names, depth - 1), made(r, names, depth - 1)
    own, right = LEVEL[sign], sign == "→"
    ta = f"({ta})" if la < own or (la == own and right) or r.random() < 0.2 else ta
    tb = f"({tb})" if lb < own or (lb == own and not right) or r.random() < 0.2 else tb
    return (sign, a, b), f"{ta} {r.choice([sign, WORDS[sign]])} {tb}", own


def holds(tree, world):
    if isinstance(tree, str):
        return world[tree]
    return not holds(tree[1], world) if tree[0] == "¬" else TRUTH[tree[0]](holds(tree[1], world), holds(tree[2], world))


def own_names(tree):
    return {tree} if isinstance(tree, str) else set().union(*map(own_names, tree[1:]))


def worlds(names):
    return [{n: bool(w >> i & 1) for i, n in enumerate(names)} for w in range(1 << len(names))]


def test_tables_and_entailment_equal_enumeration(spark):
    r = random.Random(2)
    rows = []
    for k in range(150):
        names = "P Q R S long_name x2".split()[: r.randint(1, 6)]
        three = [made(r, names, r.randint(0, 4)) for _ in range(3)]
        world = {n: r.random() < 0.5 for n in names}
        rows.append((k, *[t[1] for t in three], world, three))
    df = spark.createDataFrame([x[:5] for x in rows], "k int, a string, b string, c string, world map<string,boolean>")
    got = {x["k"]: x for x in df.select("k", logic.truth_table("a").alias("table"), logic.models(logic.truth_table("a")).alias("models"), logic.entails(F.array("a", "b"), "c").alias("follows"), logic.evaluate("c", "world").alias("here"), logic.names(logic.tokens("a")).alias("names")).collect()}
    follows = 0
    for k, a_text, _, _, world, (a, b, c) in rows:
        names = sorted(own_names(a[0]))
        bits = [holds(a[0], w) for w in worlds(names)]
        assert got[k]["names"] == names, a_text
        assert [got[k]["table"] >> i & 1 for i in range(len(bits))] == bits and got[k]["models"] == sum(bits), a_text
        every = worlds(sorted(own_names(a[0]) | own_names(b[0]) | own_names(c[0])))
        want = all(holds(c[0], w) for w in every if holds(a[0], w) and holds(b[0], w))
        assert got[k]["follows"] == want and got[k]["here"] == holds(c[0], world)
        follows += want
    assert 10 < follows < 140


def test_what_is_no_formula(spark):
    bad = ["", " ", "P AND", "AND P", "P Q", "(P", "P)", "()", "P ~ Q", "P # Q", "NOT", "P (Q)", "a b c", None, "A&B&C&D&E&F&G"]
    df = spark.createDataFrame([(t,) for t in bad], "f string")
    assert [r["t"] for r in df.select(logic.truth_table("f").alias("t")).collect()] == [None] * len(bad)
    one = spark.range(1).select(logic.evaluate(F.lit("P OR Q"), F.create_map(F.lit("P"), F.lit(True))).alias("e"), logic.truth_table(F.lit("P"), F.array(F.lit("Q"))).alias("t")).first()
    assert tuple(one) == (None, None)


def said(statement, world):
    kind, *parts = statement
    if kind in ("telling-truth", "lying"):
        return world[parts[0]] == (kind == "telling-truth")
    if kind == "not":
        return not said(parts[0], world)
    truths = [said(p, world) for p in parts]
    return all(truths) if kind == "and" else any(truths) if kind == "or" else (not truths[0] or truths[1]) if kind == "->" else truths[0] == truths[1]


def test_knights_equal_enumeration(spark):
    r = random.Random(6)

    def statement(n, depth):
        kind = r.choice(["telling-truth", "lying"] if depth == 0 else ["telling-truth", "lying", "not", "and", "or", "->", "<=>"])
        if kind in ("telling-truth", "lying"):
            return (kind, r.randrange(n))
        width = 1 if kind == "not" else r.randint(2, 4) if kind in ("and", "or") else 2
        return (kind, *[statement(n, depth - 1) for _ in range(width)])

    rows = []
    for k in range(200):
        n = r.randint(2, 6)
        rows.append((k, tuple(statement(n, r.randint(0, 3)) for _ in range(n)), [f"Person{i}" for i in range(n)]))
    df = spark.createDataFrame([(k, str(s), p) for k, s, p in rows], "k int, said string, people array<string>")
    masks = logic.statement_masks("said")
    got = {x["k"]: x for x in df.select("k", logic.knights_worlds(masks).alias("w"), logic.knights_solution(masks, "people").alias("s")).collect()}
    single = 0
    for k, statements, people in rows:
        fits = [w for w in itertools.product((False, True), repeat=len(people)) if all(said(s, w) == w[i] for i, s in enumerate(statements))]
        bits = {sum(v << i for i, v in enumerate(w)) for w in fits}
        assert {i for i in range(1 << len(people)) if got[k]["w"] >> i & 1} == bits, statements
        want = ", ".join(f"{p} is a {'knight' if v else 'knave'}" for p, v in zip(people, fits[0], strict=True)) if len(fits) == 1 else None
        assert got[k]["s"] == want
        single += len(fits) == 1
    assert single > 20


def test_claims_in_words(spark):
    rows = [
        ('You meet three people. Alice says "Bob is a knave." Bob says "Charlie is a knight." Charlie says "Alice and Bob are both knaves." Who is what?', "Alice is a knight, Bob is a knave, Charlie is a knave"),
        ('Alice says: "At least one of Alice and Bob is a knave." Bob says: "Charlie is a knight." Charlie says: "Alice is a knight and not Bob is a knight."', None),
        ('Alice says "Bob is a knave." Bob says nothing.', None),
    ]
    df = spark.createDataFrame(rows, "t string, want string").select("want", logic.knights_solution(logic.statements_from_claims("t", F.array(*map(F.lit, ("Alice", "Bob", "Charlie")))), F.array(*map(F.lit, ("Alice", "Bob", "Charlie")))).alias("got"))
    first, second, third = df.collect()
    assert first["got"] == first["want"] and third["got"] is None
    worlds_ = [w for w in itertools.product((0, 1), repeat=3) if (not (w[0] and w[1])) == bool(w[0]) and w[2] == w[1] and bool(w[0] and not w[1]) == bool(w[2])]
    assert (second["got"] is not None) == (len(worlds_) == 1)


def steps_to(words, start, target, most):
    """Breadth-first: (steps, least of the shortest ladders)."""
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if start == target:
        return (0, [start]) if start in words else (None, None)
    level, seen = deque([[start]]), {start}
    for step in range(1, most + 1):
        best = {}
        for way in level:
            for w in words:
                if w not in seen and near(way[-1], w) and (w not in best or way + [w] < best[w]):
                    best[w] = way + [w]
        if target in best:
            return step, best[target]
        seen |= set(best)
        level = deque(best.values())
    return None, None


def test_ladders_equal_search(spark, tmp_path):
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcé") for _ in range(n)) for n in (3, 4, 4) for _ in range(45)})
    puzzles = [(r.choice(words), r.choice(words)) for _ in range(40)] + [("zzzz", words[-1]), (words[0], words[0]), ("none", "none"), (words[0], "gone"), (None, words[0]), (words[0], None), ("", ""), (words[1], words[2])]
    puzzles += puzzles[:5]
    df, table = spark.createDataFrame(puzzles, "start string, target string"), spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "word string")
    got = {(x["start"], x["target"]): (x["steps"], x["ladder"]) for x in ladder.shortest_ladders(df, table, 6, folder=str(tmp_path)).collect()}
    assert set(got) == set(puzzles)
    for (a, b), found in got.items():
        assert found == (steps_to(words, a, b, 6) if a and b else (None, None)), (a, b)
    assert max(s or 0 for s, _ in got.values()) >= 4
    assert ladder.shortest_ladders(df.limit(0), table, 3, folder=str(tmp_path / "none")).collect() == []
