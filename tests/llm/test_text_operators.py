"""Line dedup, near-dedup, fingerprints: against brute force, and the cases that every operator must stand."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rillflow.llm import linededup, neardup, simhash
from rillflow.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words, n))
    base = [line(int(r.integers(1, 40))) for _ in range(60)]
    out = []
    for i in range(90):
        own = [base[int(k)] for k in r.integers(0, 60, r.integers(1, 5))] + [line(20)]
        if i % 3 == 0:
            parts = own[0].split()
            parts[int(r.integers(0, len(parts)))] += "x"
            own[0] = " ".join(parts)
        out.append("\n".join(own))
    crowd = line(120).split()
    for i in range(100):
        own = list(crowd)
        own[i] = f"edit{i}"
        out.append(" ".join(own))
    return out + [out[0], out[0].upper(), "", "  \n\t", None, "Of.", "of.", "é ß 日本 😀"]


def lines_by_force(texts):
    first, order = {}, []
    for d, t in enumerate(texts):
        for i, x in enumerate((t or "").split("\n")):
            x = x.lower().strip(" ")
            if x:
                order.append((d, i, x))
                first.setdefault(x, (d, i))
    names = list(first)
    sets = [frozenset(x[i : i + linededup.WIDTH] for i in range(max(1, len(x) - linededup.WIDTH + 1))) for x in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(len(names), links)
    head = {}
    for k, x in enumerate(names):
        head[root[k]] = min(head.get(root[k], (1 << 60, 0)), first[x])
    at = {x: k for k, x in enumerate(names)}
    gone = defaultdict(list)
    for d, i, x in order:
        if head[root[at[x]]] != (d, i):
            gone[d].append(i)
    return gone


def test_line_dedup_equals_brute_force(spark, corpus):
    want = lines_by_force(corpus)
    df = docs(spark, corpus)
    got = linededup.dropped_lines(linededup.line_classes(df)).collect()
    found = {r["key"]: r["dropped"] for r in got}
    missed = sum(len(set(want[d]) - set(found.get(d, []))) for d in want)
    assert missed <= 0.02 * sum(map(len, want.values()))
    assert all(set(x) <= set(want[d]) for d, x in found.items())
    clean = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert set(clean) == set(range(len(corpus))) and clean[corpus.index(None)] is None
    for d, t in enumerate(corpus):
        if t is not None:
            assert clean[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in found.get(d, []))


def test_lines_at_the_bound_are_found(spark):
    """Pairs at Jaccard 0.8: every one among short lines, as independent permutations find them among longer ones."""
    r = np.random.default_rng(9)
    share = {}
    for n, edits, pairs in ((10, 1, 400), (18, 2, 400), (40, 4, 400)):
        texts = []
        for _ in range(pairs):
            own = "".join(r.choice(list("abcdefghijklmnop"), n + linededup.WIDTH - 2 + edits - 1))
            texts += [own, own[:-edits] + "z" * edits]
        ids = docs(spark, texts)
        sets = [{x[i : i + linededup.WIDTH] for i in range(len(x) - linededup.WIDTH + 1)} for x in texts]
        assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
        gone = {x["key"] for x in linededup.dropped_lines(linededup.line_classes(ids)).where("size(dropped) > 0").collect()}
        assert all(d % 2 for d in gone)
        share[n] = len(gone) / pairs
    assert share[10] == share[18] == 1 and share[40] >= 0.99, share


def test_bands_meet_pairs_at_the_bound(spark):
    """By bands alone: pairs at Jaccard 0.8 of 10, 20 and 50 shingles in all, and unlike ones of 20."""
    r = np.random.default_rng(19)
    share = {}
    for union, common, pairs in ((10, 8, 600), (20, 16, 600), (50, 40, 600), (20, 4, 600)):
        only = (union - common) // 2
        lines = []
        for _ in range(pairs):
            middle = "".join(r.choice(list("abcdefghijklmnop"), common + linededup.WIDTH - 1))
            lines += [middle + "".join(r.choice(list("qrst"), only)), middle + "".join(r.choice(list("uvwx"), only))]
        df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
        met = linededup.bands(df).select("lid", "bucket", (F.col("lid") / 2).cast("long").alias("pair")).distinct()
        share[union, common] = met.groupBy("pair", "bucket").count().where("count > 1").select("pair").distinct().count() / pairs
    assert min(share[10, 8], share[20, 16], share[50, 40]) >= 0.97, share
    assert share[20, 4] <= 0.15, share


def test_tiny_lines_and_low_bounds_are_met_exactly(spark):
    r = np.random.default_rng(10)
    texts = sorted({"".join(r.choice(list("ab"), r.integers(1, 4))) * int(r.integers(1, 9)) for _ in range(120)} | {"a" * k for k in range(8, 26)})
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in texts]
    lines = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "lid binary, line string")
    for similarity in (0.5, 0.8):
        near = {(i, j) for j in range(len(texts)) for i in range(j) if max(map(len, (texts[i], texts[j]))) <= linededup.SHORT + 7 and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9}
        keys = linededup.short_keys(lines, similarity)
        met = keys.alias("x").join(keys.alias("y"), "bucket").select("x.lid", F.col("y.lid").alias("other")).distinct().collect()
        assert near and near <= {(a[0], b[0]) for a, b in met}


def fingerprint(text, width=4):
    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = WORD.findall(t)
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup_equals_brute_force(spark, corpus):
    prints = [fingerprint(t) for t in corpus]
    root = roots(len(corpus), [(i, j) for i in range(len(corpus)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component"]) for r in neardup.near_duplicates(docs(spark, corpus)).collect()}
    assert got == {i: (prints[i], root[i]) for i in range(len(corpus))}


@pytest.mark.parametrize("limits", [{}, {"SLICE": 4096, "CROWD": 200, "LEAST_BITS": 3}])
def test_ball_links_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 62, 20)]
    values = {b ^ sum(1 << int(i) for i in r.choice(64, r.integers(0, 5), replace=False)) for b in base for _ in range(30)}
    crowd = {base[0] ^ sum(1 << int(i) for i in r.choice(64, 3, replace=False)) for _ in range(150)}
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values | crowd | {0, 1, (1 << 64) - 1})
    root = roots(len(values), [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 4])
    links = neardup.ball_links(spark.createDataFrame([(v,) for v in values], "x long"), 4)
    got = dict(map(tuple, connected_components(links).collect()))
    assert [got.get(v, v) for v in values] == [values[k] for k in root]
    if limits:
        assert links.count() <= 3 * len(values) * 40  # never all pairs of a crowd


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == 100 and 7 in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edited_fingerprints(spark, corpus, tmp_path):
    docs(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in simhash.op4_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(range(len(corpus)), reverse=True)
    for k, d in enumerate(order):
        t, after = corpus[d] or "", corpus[order[(k + 1) % len(order)]] or ""
        n = len(t) // 3
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
        assert got[d]["n_chars"] == len(t)
        assert got[d]["near_next"] == 1 - (int(got[d]["fingerprint"], 16) ^ int(got[order[(k + 1) % len(order)]]["fingerprint"], 16)).bit_count() / (4 * len(got[d]["fingerprint"]))
    assert got[0]["fingerprint"] == got[corpus.index(corpus[0], 1)]["fingerprint"]
    assert set(got[corpus.index("")]["fingerprint"]) == {"0"}


def test_the_next_in_order_over_many_ranges(spark):
    ids = sorted({int(x) for x in np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 3000)} | set(range(50)))
    df = spark.createDataFrame([(i, h) for i in ids for h in ((0, 7) if i % 5 == 0 else (0,))], "id0 long, h long").repartition(3)
    order = sorted(((r["id0"], r["h"]) for r in df.collect()), reverse=True)
    got = {(r["id0"], r["h"]): (r["next_id"], r["next_h"]) for r in simhash.next_in_order(df, 40).collect()}
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_edited_fingerprints_of_repeated_rows(spark, tmp_path):
    rows = [(3, "one two three", "en", "s", 13)] * 3 + [(2, "four five", "en", "s", 9), (None, None, "en", "s", 0), (None, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op4_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 0), (2, 9), (3, 13), (3, 13), (3, 13)]
    assert {r["edited_sha256"] for r in got if r["doc_id"] == 3} == {hashlib.sha256(b"one two tfour").hexdigest()}


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(2)
    base = [int(x) << 66 | int(y) for x, y in r.integers(0, 1 << 62, (30, 2))]
    values = sorted({b ^ sum(1 << int(i) for i in r.choice(128, r.integers(0, 5), replace=False)) for b in base for _ in range(8)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda v: (signed(v & (1 << 64) - 1), signed(v >> 64))
    queries, prints = values[::2] + [values[0]], values[::3] + [values[0]]
    want = {(*halves(a), *halves(b), (a ^ b).bit_count()) for a in queries for b in prints if (a ^ b).bit_count() <= 3}
    frame = lambda vs, *names: spark.createDataFrame([*map(halves, vs), (None, 1)], ", ".join(f"{n} long" for n in names))
    got = simhash.neighbours(frame(queries, "q0", "q1"), frame(prints, "p0", "p1"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60


def print128(text):
    """Both halves, plainly: neighbouring words chained through XXH64, and the hash of that hash."""
    w = WORD.findall(text)
    h0 = [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(w, w[1:], strict=False)] or [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    h1 = [xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42) for h in h0]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in (h0, h1))


def test_fingerprints_and_near_documents_equal_brute_force(spark, corpus, tmp_path):
    docs(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in simhash.op4_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(range(len(corpus)), reverse=True)
    after = {d: corpus[order[(k + 1) % len(order)]] or "" for k, d in enumerate(order)}
    own = [print128(t or "") for t in corpus]
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    for d, t in enumerate(corpus):
        t = t or ""
        n = len(t) // 3
        edited = print128(t[: len(t) - n] + after[d][:n])
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == tuple("".join(f"{x:016x}" for x in p) for p in (own[d], edited))
        assert got[d]["near_edited"] == 1 - bits(own[d], edited) / 128
        assert got[d]["near_docs"] == sum(bits(p, edited) <= simhash.RADIUS for p in own)


@pytest.mark.parametrize("operator", [linededup.dedup_lines, neardup.near_duplicates, lambda d: simhash.edited_texts(d, "text", "doc_id")])
def test_empty_null_and_repeated(spark, operator):
    assert operator(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "same words here in this line", "x"), (1, "same words here in this line", "x"), (None, None, None), (2, "word " * 30_000, None), (None, "", "k")], "doc_id long, text string, key string")
    assert operator(odd).count() >= 3
