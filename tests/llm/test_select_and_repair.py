"""Importance resampling, url filters and conversation repair: against brute force, SQL and the cases each must stand."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.llm import conversations, registry, resampling, url_filter

DATA = "/root/testdata/sf0.001"
BIG = 2**53 + 1
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_resampling", "op12_urls", "op13_conversations"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    ran = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in ran.description]
    got = registry.QUERIES[name](spark, DATA)
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(ran.fetchall(), key=repr)


# ---- importance resampling ---------------------------------------------------------------------------------------
def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(rows, target, percent=5, least=20):
    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = float(s.total() + 10000), float(t.total() + 10000)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
    out = []
    for key, text in rows:
        words, buckets = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        out.append([key, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], places.get(id(r))) for r in out]


def test_resampling_equals_brute_force(spark):
    texts = [" ".join(f"w{(i * k) % 17}É{'X' if k % 3 else '-'}y{k % 5}" for k in range(i % 60)) for i in range(300)]
    texts += [None, "", " .,\n", "A" * 50_000, "b c " * 30_000, *["Same words here " * 8] * 100]
    rows = [(BIG + i if i % 50 == 0 else i, t) for i, t in enumerate(texts)] + [(None, "w1 w2 " * 15), (7, "w1 w2 " * 15), (7, "w1 w2 " * 15)]
    target = ["w1 w2 w3 same words", None, "here " * 40]
    df = spark.createDataFrame([(k, t, f"s{(k or 0) % 3}", 1, 2) for k, t in rows], "doc_id long, text string, source string, rank int, words int")
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert got.columns == ["doc_id", "source", "words", "n_features", "weight", "score", "rank"]
    same = lambda rows: sorted(((r[0] is None, r[0] or 0, *r[1:4], r[4] or 0) for r in rows))
    assert same(tuple(r) for r in got.drop("source", "words").collect()) == same(resampled(rows, target, 30))


def test_resampling_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).collect() == []
    (row,) = resampling.resample(docs, none).collect()
    assert (row["n_features"], row["rank"]) == (6, None) and row["weight"] < 0


def test_shares_follow_the_weights(spark):
    """Of two kinds of text, a thousand each, the one like the target is drawn far more often, but not alone."""
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "one two three four ") * 6 + f"id{i}") for i in range(2000)]
    target = spark.createDataFrame([("alpha beta one two",)] * 3, "text string")
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, percent=20)
    drawn = [r["doc_id"] % 2 for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 400
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").select("rank").collect()) == list(range(1, 401))


# ---- url filters -------------------------------------------------------------------------------------------------
def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    return raw.translate(ASCII_LOWER), re.match(r"[^?#]*", rest[len(raw) :])[0]


def judged(url, rules, vocabulary):
    host, path = cut(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)
    text = re.sub("%[0-9a-f]{2}", " ", (host + path).translate(ASCII_LOWER))
    hit = lambda w: re.search(f"(?<![a-z\x80-\U0010ffff]){re.escape(w)}(?![a-z\x80-\U0010ffff])", text)
    strict, soft = sum(map(bool, map(hit, vocabulary.strict))), sum(map(bool, map(hit, vocabulary.soft)))
    own = "block" if strict or soft >= vocabulary.soft_needed else "allow"
    return host, path, best and best.text, best.verdict if best else own, strict, soft


URLS = [
    None, "", "no scheme", "mailto:a@b.org", "http://", "http://?x", "http://a.org", "http://A.ORG/", "HTTPS://x.Example.org/es/1?q=/en/1", "http://example.org/en/1#top", "http://example.org/en/2", "http://notexample.org/es/",
    "ftp://x.com/fr/casino", "http://x.com/de/ok", "http://com/de/", "http://b.net/free-bets", "http://b.net/free/sussex/essex", "http://b.net/sex4u?free", "http://adult-x.net/", "http://b.net/a%2Fporn%2f", "http://b.net/xporn", "http://b.net/Pörn/éxxx",
    "http://b.net:80/xxx", "http://user@b.net/a", "http://a.b://c.net/xxx", "http://org/", "http://.org/x", "http://b.net/" + "free/" * 30_000, "http://" + "a." * 3000 + "org/x", "http://b.net/win#bet", "http://日本.net/自由free/bets",
]


def test_urls_equal_brute_force(spark):
    rows = [(BIG + i, u, "mine") for i, u in enumerate(URLS)] + [(None, "http://b.net/free-bets", None), (3, URLS[8], "x"), (3, URLS[8], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string").withColumn("j", F.lit(5)).withColumn("row", F.lit(6))
    got = url_filter.filter_urls(df)
    assert got.columns == ["page_id", "url", "j", "row", "host", "path", "rule", "verdict", "strict", "soft"]
    want = [(k, u, 5, 6, *judged(u, url_filter.RULES, url_filter.VOCABULARY)) for k, u, _ in rows]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert url_filter.filter_urls(df.limit(0)).collect() == []
    left = [r["url"] for r in url_filter.allowed(df).collect()]
    assert sorted(left, key=repr) == sorted((w[1] for w in want if w[7] == "allow"), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abxy./-é%2?#:S", max_size=14), max_size=40))
def test_matcher_equals_search(parts):
    vocabulary = url_filter.Vocabulary(("ab", "abx", "x-y"), ("a", "b", "bx", "é", "xy"), 2)
    rules = [url_filter.Rule.parse(v, r) for v, r in itertools.product(("allow", "block"), ("a/", "x.a/b", "a/b/x", "b.x.a/", "y/"))]
    matcher = url_filter.Matcher(rules, vocabulary)
    for part in parts:
        host, path, rule, _, strict, soft = judged("http://" + part, rules, vocabulary)
        hits = set(matcher.hits(re.sub("%[0-9a-f]{2}", " ", (host + path).translate(ASCII_LOWER))))
        assert (sum(s for _, s in hits), sum(not s for _, s in hits)) == (strict, soft)
        found = matcher.rule(host, path)
        assert (found and found.text) == rule


def test_rules_and_terms_are_checked():
    for bad in (("deny", "a/"), ("allow", "a"), ("allow", "/x")):
        with pytest.raises(ValueError):
            url_filter.Rule.parse(*bad)
    with pytest.raises(ValueError):
        url_filter.Vocabulary(("Porn",), ())
    assert list(url_filter.Matcher((), url_filter.Vocabulary((), ())).hits("porn")) == []


# ---- conversations -----------------------------------------------------------------------------------------------
SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All audits of at most two insertions in one place, by search: (cost, audit, lines)."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        if 5 * sum(inserts) > (best[0] if best else 2 * len(rows)):
            continue
        options = [("D",) if f in ("blank", "duplicate") else ("D", "K", "Ru", "Ra") for f in found]
        for edits in itertools.product(*options):
            cost = 5 * sum(inserts) + sum({"D": 2, "K": 0}.get(e, 1) for e in edits) + sum(5 for e, f in zip(edits, found, strict=True) if f == "truncated" and e != "D")
            if best and cost > best[0]:
                continue
            for roles in itertools.product("ua", repeat=sum(inserts)):
                left, initials, lines = list(roles), "", []
                audit = ""
                for k, n in enumerate(inserts):
                    for _ in range(n):
                        role = left.pop(0)
                        audit, initials = audit + "I", initials + role
                        lines.append({"u": "user:", "a": "assistant:"}[role])
                    if k < len(rows):
                        e, (_, role, text) = edits[k], rows[k]
                        audit += e[0]
                        if e != "D":
                            role = {"K": role, "Ru": "user", "Ra": "assistant"}[e]
                            initials += role[:1] or " "
                            lines.append(f"{role}:{text}")
                if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best


def repaired(rows):
    """rows: (turn, role, text) in order."""
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, lines = cheapest(rows, found)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, lines)


ROLES, SAYINGS = ["system", "user", "assistant", "tool", "", None, "User"], ["Fine.", "Other.", "cut off", " \t", "", None, "End! \n", "é?", "No"]


def in_order(rows):
    spaced = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(spaced, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_repair_equals_search(spark):
    import random

    r = random.Random(4)
    talks = {k: [(r.choice([None, *range(6)]), r.choice(ROLES if k % 3 else ROLES[:3]), r.choice(SAYINGS if k % 2 else SAYINGS[:2] + [f"Own {i}."])) for i in range(r.randint(1, 5))] for k in range(160)}
    talks[None] = [(1, "user", "Hi."), (2, "assistant", "Yes.")]
    talks[BIG] = [(1, "system", "Be."), (2, "user", "Hi."), (2, "user", "Hi."), (3, "assistant", "Yes.")]
    rows = [(k, *x, 1) for k, talk in talks.items() for x in talk]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int").withColumn("fault", F.lit("x"))
    got = {x["conv"]: tuple(x)[1:] for x in conversations.repair(conversations.turns_of(df)).collect()}
    assert set(got) == set(talks)
    for k, talk in talks.items():
        assert got[k] == repaired(in_order(talk)), talk


def test_a_long_conversation_and_none(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"Turn {i}.") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = conversations.repair(conversations.turns_of(df)).collect()
    assert (row["cost"], row["audit"]) == (4, "D" + "K" * 2998 + "D") and row["repaired"][0] == "user:Turn 1."
    assert conversations.repair(conversations.turns_of(df.limit(0))).collect() == []


def test_damage(spark):
    keys = {kind: next(k for k in range(1000) if zlib.crc32(f"{k}:5".encode()) % 20 == kind) for kind in range(5)}
    none = next(k for k in range(1000) if zlib.crc32(f"{k}: ".encode()) % 20 == 0)
    rows = [(k, 5, "assistant", "A. b!") for k in keys.values()] + [(none, None, "assistant", "A. b!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = conversations.damaged(conversations.turns_of(df))
    got = {k: sorted((r["role"], r["text"], r["gone"]) for r in turns.collect() if r["conv"] == k) for k in (*keys.values(), none)}
    assert got[keys[0]] == got[none] == [("assistant", "", True)]
    assert [got[keys[k]] for k in range(1, 5)] == [[("assistant", "", False)], [("assistant", "A b", False)], [("assistant", "A. b!", False)] * 2, [("user", "A. b!", False)]]
    back = {r["conv"]: r for r in conversations.repair(turns).collect()}
    assert tuple(back[none])[1:] == (0, 0, 0, 0, 0, 0, "", [])
