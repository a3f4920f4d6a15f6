"""Conversation structure repair: a fold of higher-order functions over a conversation's turns.

A conversation in order is a system turn or none, then pairs of a user's and an assistant's turn; no turns at all are in
order as well: role initials (s?(ua)+)?. A turn is faulty if it is blank, repeats role and text of an earlier one, or ends without
a sentence's end. Edits keep a turn (K, cost 0), give it the role user or assistant (R, 1), delete it (D, 2; blank and
repeated turns must go) or insert an empty turn of user or assistant (I, 5); a truncated turn that stays costs 5 more.

Windows give each turn its flags; the turns are collected in order and aggregate() carries four structs (cost, audit), the
cheapest way to be before the first turn kept (e), after a system turn (s), after a user's (u) and after an assistant's (a).
least() over such structs takes the cheaper and, of equally cheap ones, the audit that is less in ASCII. That is right for
whole audits: of two audits of equal cost over the same turns none begins the other, as each letter more is an insertion
that costs. The roles given to R and I follow from the audit, as roles alternate.

Rows are dealt by conversation once; windows and the fold use that order. A conversation's repaired text is one value, so a
conversation must fit a row; the fold copies its audit, a byte a turn, with each turn (10,000 turns: 0.2 GB copied).

Defined results: a null role or text counts as one space, and stays so where it is kept; an empty role is none of the three; turns are taken by number, nulls
first, and equal numbers by role and text; a null conversation id is a conversation like others; of rows without turns (all
dropped) all counts are 0, the audit is empty and the text is empty; columns other than the four are not used, whatever
their names; an empty table gives an empty result; repeated rows are repeated turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import table

#: The six ASCII characters of white space.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RETURNED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
#: Costs of the edits, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: More than any repair costs.
NEVER = 1 << 40


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): nulls of role and text as one space; gone is false."""
    spaced = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    return df.select(df[conv].alias("conv"), df[turn].alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(False).alias("gone"))


def damaged(turns: DataFrame, modulus: int = 20) -> DataFrame:
    """Turns with faults put in by crc32(`conv:turn`) % modulus: 0 drops a turn (gone, its text emptied), 1 empties it, 2 takes
    away what ends sentences, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.withColumn("kind", F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")) % modulus)
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("gone") | (F.col("kind") == 0)).alias("gone"), F.explode(copies)).drop("col")


def flagged(turns: DataFrame) -> DataFrame:
    """Turns with nth (among equal ones), fault (blank, duplicate, truncated or null: a turn's first) and illegal (the pair with the turn before it)."""
    order = ["gone", F.col("turn").asc_nulls_first(), "role", "text"]
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    rows = turns.repartition("conv")  # the one exchange: what follows is clustered by conv or by more
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy("turn")))
    rows = rows.withColumn("before", F.lag(initial).over(Window.partitionBy("conv").orderBy(*order)))
    fault = F.when(said == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(said, -1, 1).isin(*ENDS), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    return rows.select("conv", "turn", "role", "text", "nth", "gone", fault.alias("fault"), illegal.alias("illegal"))


def _edit(way: str, cost: str, letter: str) -> str:
    return f"named_struct('c', {way}.c + {cost}, 't', concat({way}.t, '{letter}'))"


def _let(name: str, value: str, result: str) -> str:
    """SQL of result, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {result})[0]"


def repair_fold(rows: str) -> str:
    """SQL for struct<c, t>, the cheapest repair of an array of struct<i: initial, fault> in order."""
    way = lambda cost, audit: f"named_struct('c', CAST({cost} AS BIGINT), 't', '{audit}')"
    start = f"named_struct('e', {way(0, '')}, 's', {way(NEVER, '')}, 'u', {way(INSERT, 'I')}, 'a', {way(2 * INSERT, 'II')})"
    gone = "r.fault IN ('blank', 'duplicate')"
    extra = f"IF(r.fault = 'truncated', {TRUNCATED}, 0)"
    stays = lambda initial: f"IF({gone} OR r.i <> '{initial}', {NEVER}, {extra})"
    given = f"IF({gone}, {NEVER}, {REROLE} + {extra})"
    deleted = {x: _edit(f"w.{x}", str(DELETE), "D") for x in "esua"}
    turned = {
        "e": deleted["e"],
        "s": f"least({deleted['s']}, {_edit('w.e', stays('s'), 'K')})",
        "u": f"least({deleted['u']}, {_let('f', 'least(w.e, w.s, w.a)', f'least({_edit('f', stays('u'), 'K')}, {_edit('f', given, 'R')})')})",
        "a": f"least({deleted['a']}, {_edit('w.u', stays('a'), 'K')}, {_edit('w.u', given, 'R')})",
    }
    after = "named_struct(" + ", ".join(f"'{x}', {y}" for x, y in turned.items()) + ")"
    # An insertion of a user's turn, and then of an assistant's, behind each turn; more in one place never pay.
    user = f"least(x.u, {', '.join(_edit(f'x.{y}', str(INSERT), 'I') for y in 'esa')})"
    inserted = _let("y", user, f"named_struct('e', x.e, 's', x.s, 'u', y, 'a', least(x.a, {_edit('y', str(INSERT), 'I')}))")
    return f"aggregate({rows}, {start}, (w, r) -> {_let('x', after, inserted)}, w -> least(w.e, w.a))"


def repaired_lines(rows: str, audit: str) -> str:
    """SQL for the lines `role:text` that an audit makes of an array of struct<i, role, text>: `at` is the number of the turn, `made`
    that of lines so far, `lead` whether a system's turn leads."""
    state = "named_struct('at', 0, 'lead', 0, 'lines', CAST(array() AS ARRAY<STRING>))"
    role = "IF((size(z.lines) - z.lead) % 2 = 0, 'user', 'assistant')"
    turn = f"element_at({rows}, z.at + 1)"
    line = f"CASE l WHEN 'K' THEN concat({turn}.role, ':', {turn}.text) WHEN 'R' THEN concat({role}, ':', {turn}.text) ELSE concat({role}, ':') END"
    lead = f"IF(l = 'K' AND size(z.lines) = 0 AND {turn}.i = 's', 1, z.lead)"
    step = f"named_struct('at', z.at + IF(l = 'I', 0, 1), 'lead', {lead}, 'lines', IF(l = 'D', z.lines, array_append(z.lines, {line})))"
    return f"aggregate(filter(split({audit}, ''), l -> l <> ''), {state}, (z, l) -> {step}, z -> z.lines)"


def repair(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): a row for each conversation of turns (conv, turn,
    role, text, gone); turns that are gone only name their conversation. repaired has the lines `role:text`."""
    rows = flagged(turns)
    here = ~F.col("gone")
    turn: Column = F.when(here, F.col("turn"))
    count = lambda cond: F.count(F.when(here & cond, 1)).alias
    per = rows.groupBy("conv").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.size(F.collect_set(turn)), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal"))("illegal"),
        F.sort_array(F.collect_list(F.when(here, F.struct("turn", "role", "text", "nth", "fault", F.substring("role", 1, 1).alias("i"))))).alias("rows"),
    )
    per = per.withColumn("best", F.expr(repair_fold("transform(rows, r -> named_struct('i', r.i, 'fault', coalesce(r.fault, '')))")))
    per = per.withColumn("audit", F.col("best.t")).withColumn("cost", F.col("best.c"))
    return per.select("conv", *RETURNED, F.expr(repaired_lines("rows", "audit")).alias("repaired"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair(damaged(turns_of(table(spark, sf_dir, "conversations"))))
    digest = F.sha2(F.array_join("repaired", "\n").cast("binary"), 256)
    return repaired.select(F.col("conv").alias("conv_id"), *RETURNED, digest.alias("repaired_sha256"))


SQL = """
WITH RECURSIVE k(i, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM k WHERE step < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM k WHERE step = 8),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM given, crc
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0
), faults AS (
  SELECT conv_id, turn, role, text, copy, substr(role, 1, 1) AS i,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    row_number() OVER o AS n, lag(substr(role, 1, 1)) OVER o || substr(role, 1, 1) AS pair
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM faults GROUP BY conv_id
),
-- A way is its cost in ten digits and its audit, so that least() compares both.
walk(conv_id, n, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, '0000000000', '5000000000', '0000000005I', '0000000010II' FROM counts
  UNION ALL
  SELECT conv_id, n, e, s, u, least(a, ins_u) FROM (
    SELECT conv_id, n, e, s, u, a, lpad(CAST(substr(u, 1, 10)::BIGINT + 5 AS VARCHAR), 10, '0') || substr(u, 11) || 'I' AS ins_u FROM (
      SELECT conv_id, n, e, s, a, least(u, lpad(CAST(substr(x, 1, 10)::BIGINT + 5 AS VARCHAR), 10, '0') || substr(x, 11) || 'I') AS u FROM (
        SELECT *, least(e, s, a) AS x FROM (
          SELECT conv_id, n, de AS e, CASE WHEN must OR i <> 's' THEN ds ELSE least(ds, ke) END AS s,
            CASE WHEN must THEN du WHEN i = 'u' THEN least(du, kx, rx) ELSE least(du, rx) END AS u,
            CASE WHEN must THEN da WHEN i = 'a' THEN least(da, ku, ru) ELSE least(da, ru) END AS a FROM (
            SELECT w.conv_id, f.n, f.i, f.fault IN ('blank', 'duplicate') AS must, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS extra, least(w.e, w.s, w.a) AS x,
              lpad(CAST(substr(w.e, 1, 10)::BIGINT + 2 AS VARCHAR), 10, '0') || substr(w.e, 11) || 'D' AS de, lpad(CAST(substr(w.s, 1, 10)::BIGINT + 2 AS VARCHAR), 10, '0') || substr(w.s, 11) || 'D' AS ds,
              lpad(CAST(substr(w.u, 1, 10)::BIGINT + 2 AS VARCHAR), 10, '0') || substr(w.u, 11) || 'D' AS du, lpad(CAST(substr(w.a, 1, 10)::BIGINT + 2 AS VARCHAR), 10, '0') || substr(w.a, 11) || 'D' AS da,
              lpad(CAST(substr(w.e, 1, 10)::BIGINT + extra AS VARCHAR), 10, '0') || substr(w.e, 11) || 'K' AS ke, lpad(CAST(substr(w.u, 1, 10)::BIGINT + extra AS VARCHAR), 10, '0') || substr(w.u, 11) || 'K' AS ku,
              lpad(CAST(substr(w.u, 1, 10)::BIGINT + extra + 1 AS VARCHAR), 10, '0') || substr(w.u, 11) || 'R' AS ru, lpad(CAST(substr(least(w.e, w.s, w.a), 1, 10)::BIGINT + extra AS VARCHAR), 10, '0') || substr(least(w.e, w.s, w.a), 11) || 'K' AS kx,
              lpad(CAST(substr(least(w.e, w.s, w.a), 1, 10)::BIGINT + extra + 1 AS VARCHAR), 10, '0') || substr(least(w.e, w.s, w.a), 11) || 'R' AS rx
            FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1)))))
), best AS (
  SELECT w.conv_id, substr(least(e, a), 1, 10)::BIGINT AS cost, substr(least(e, a), 11) AS audit FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.size = w.n
), letters AS (
  SELECT conv_id, p, substr(audit, p, 1) AS l, length(replace(substr(audit, 1, p), 'I', '')) AS n, length(replace(substr(audit, 1, p), 'D', '')) AS line FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)
), lines AS (
  SELECT l.*, f.role, f.text, max(CASE WHEN l.l = 'K' AND l.line = 1 AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS lead
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n AND l.l <> 'I'
), made AS (
  SELECT conv_id, string_agg(CASE l WHEN 'K' THEN role ELSE CASE WHEN (line - 1 - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE l WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
  FROM lines WHERE l <> 'D' GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(m.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM d.conv_id
"""
