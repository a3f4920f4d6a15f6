"""URL filters: allow and block rules by host and path, and a weighted vocabulary searched by Aho-Corasick.

A url's host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; its path goes on to `?`,
`#` or the end. Both are cut by DataFrame functions. Host and path then pass through one automaton of all terms in Arrow
batches, in time in proportion to their length, however many terms there are. A hit counts where no letter stands before or
after it (ASCII letters and all other characters beyond ASCII are letters; an escape such as %2f is none). One hit of a
strict term, or SOFT_NEEDED distinct soft terms, reject a url; what stands behind `?` or `#` is not judged.

Rules go before the vocabulary. A rule is host/path; it fits its host and all its subdomains, if the url's path starts with the
rule's. The longest that fits decides; of equally long ones that with the longer host, and block before allow. Rules are
found by the host's suffixes in a table, so a url costs as many steps as its host has labels, plus the rules of these.

Rules and terms travel to the tasks inside the function: they are parameters of a filter, at most MAX_ENTRIES of each.
There is no shuffle, so no key is hot; a lost task is run again and gives the same.

Defined results: a null url and one without `://` have an empty host and path, fit no rule and are allowed; an empty host or
path fits only rules whose host is its suffix and whose path it starts with, so `http://a.org` fits no rule of `org/`; equal rows
are each judged; an empty table gives an empty result; other columns of the input stay as they are, unless they bear the
name of a result column.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import lower_ascii, spread, table

MAX_ENTRIES = 1_000_000
SOFT_NEEDED = 2
RESULT = ("host", "path", "rule", "verdict", "strict", "soft")


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms. One strict term rejects; soft ones reject from so many distinct ones on."""

    strict: tuple[str, ...]
    soft: tuple[str, ...]
    soft_needed: int = SOFT_NEEDED

    def __post_init__(self):
        if max(len(self.strict), len(self.soft)) > MAX_ENTRIES:
            raise ValueError(f"more than {MAX_ENTRIES} terms")
        if any(t != t.lower() or not t for t in (*self.strict, *self.soft)):
            raise ValueError("terms are lower-case and not empty")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, rule: str) -> Rule:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"a rule is allow or block, and host/path: {verdict} {rule}")
        return cls(verdict, host.lower(), "/" + path)

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production vocabulary.
VOCABULARY = Vocabulary(
    strict=("adult-x", "casino", "casinos", "camgirl", "camgirls", "hardcore-sex", "hentai", "milf", "porn", "porno", "pornstar", "sexcam", "sexcams", "viagra", "x-rated", "xvideos", "xxx"),
    soft=(
        "ads", "adult", "bet", "bets", "betting", "bonus", "cheap", "click", "dating", "download", "escort", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery",
        "nude", "nudes", "payday", "pharmacy", "pill", "pills", "poker", "sex", "sexy", "slots", "spam", "torrent", "track", "tracker", "tracking", "warez", "webcam", "win",
    ),
)
RULES = (Rule.parse("allow", "org/"), Rule.parse("block", "example.org/es/"), Rule.parse("block", "example.org/en/1"), Rule.parse("allow", "com/fr/"), Rule.parse("block", "com/de/"))


def host_of(url: Column) -> Column:
    return lower_ascii(_raw_host(url))


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _raw_host(url: Column) -> Column:
    head = _rest(url)
    for end in "/?#":
        head = F.substring_index(head, end, 1)
    return head


def path_of(url: Column) -> Column:
    rest = _rest(url)
    tail = F.substring(rest, F.length(_raw_host(url)) + 1, F.length(rest))
    return F.substring_index(F.substring_index(tail, "?", 1), "#", 1)


class Matcher:
    """Rules by host, and an automaton of all terms; made once for each task."""

    def __init__(self, rules: Iterable[Rule], vocabulary: Vocabulary):
        import ahocorasick

        self.rules: dict[str, list[Rule]] = defaultdict(list)
        for rule in sorted(set(rules), key=lambda r: (-len(r.path), r.verdict == "allow")):
            self.rules[rule.host].append(rule)
        self.terms = ahocorasick.Automaton()
        for term in {*vocabulary.strict, *vocabulary.soft}:
            self.terms.add_word(term, (term, term in vocabulary.strict))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while True:  # the longest host first
            for rule in self.rules.get(host[at:], ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
            at = host.find(".", at) + 1
            if not at:
                return best

    def hits(self, text: str) -> Iterator[tuple[str, bool]]:
        """(term, whether it is strict) of every hit that no letter touches."""
        if not len(self.terms):
            return
        letter = lambda c: "a" <= c <= "z" or c > "\x7f"
        for end, (term, strict) in self.terms.iter(text):
            start = end - len(term)
            if not (start >= 0 and letter(text[start])) and not (end + 1 < len(text) and letter(text[end + 1])):
                yield term, strict


def judged(host: Column, path: Column, rules: Iterable[Rule] = RULES, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """struct<rule, verdict, strict, soft>: the rule that decides, allow or block, distinct strict and distinct soft terms."""
    rules = tuple(rules)
    if len(rules) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} rules")
    escape, upper = re.compile("%[0-9a-f]{2}"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [("rule", pa.string()), ("verdict", pa.string()), ("strict", pa.int64()), ("soft", pa.int64())]

    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        matcher = Matcher(rules, vocabulary)
        for hosts, paths in batches:
            columns: list[list] = [[], [], [], []]
            for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                found = set(matcher.hits(escape.sub(" ", (h + p).translate(upper))))
                strict = sum(s for _, s in found)
                soft = len(found) - strict
                rule = matcher.rule(h, p)
                own = "block" if strict or soft >= vocabulary.soft_needed else "allow"
                for column, x in zip(columns, (rule and rule.text, rule.verdict if rule else own, strict, soft), strict=True):
                    column.append(x)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    judge.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(judge, "rule string, verdict string, strict long, soft long")(host, path)


def filter_urls(df: DataFrame, url: str = "url", rules: Iterable[Rule] = RULES, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """df with host, path, rule, verdict, strict and soft. Only host and path go through Python."""
    own = [c for c in df.columns if c.lower() not in RESULT]
    text = F.coalesce(df[url].cast("string"), F.lit(""))
    rows = df.select(F.struct(*[df[c] for c in own]).alias("row") if own else F.struct(F.lit(0)).alias("row"), host_of(text).alias("host"), path_of(text).alias("path"))
    rows = rows.withColumn("j", judged(F.col("host"), F.col("path"), rules, vocabulary))
    return rows.select(*[F.col("row")[c].alias(c) for c in own], "host", "path", "j.rule", "j.verdict", "j.strict", "j.soft")


def allowed(df: DataFrame, url: str = "url", rules: Iterable[Rule] = RULES, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """The rows whose url is allowed, as they are."""
    text = F.coalesce(df[url].cast("string"), F.lit(""))
    return df.where(judged(host_of(text), path_of(text), rules, vocabulary)["verdict"] == "allow")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spread(table(spark, sf_dir, "pages").select("page_id", "url"))).drop("url")


def _sql() -> str:
    any_of = lambda terms: ", ".join(f"'{t}'" for t in terms)
    edge = "[\\x00-\\x60\\x7B-\\x7F]"
    hit = f"regexp_matches(t, '(^|{edge})(' || w || ')($|{edge})')"
    rules = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
r(rule, rh, rp, verdict) AS (VALUES {rules}),
s AS (SELECT *, regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%[0-9a-f]{{2}}', ' ', 'g') AS t,
  (SELECT arg_max(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM p),
v AS (SELECT s.*, (SELECT count(*) FROM (SELECT unnest([{any_of(VOCABULARY.strict)}]) AS w) WHERE {hit}) AS strict,
  (SELECT count(*) FROM (SELECT unnest([{any_of(VOCABULARY.soft)}]) AS w) WHERE {hit}) AS soft FROM s)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN strict > 0 OR soft >= {VOCABULARY.soft_needed} THEN 'block' ELSE 'allow' END) AS verdict, strict, soft
FROM v
"""


SQL = _sql()
