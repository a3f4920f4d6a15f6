"""Mixing, packing, neighbours, HTML, WARC, toxicity, quality and the pipeline."""

import base64
import hashlib
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import html_text, html_train, labelled, mixing, packing, quality, toxicity, vptree, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=("a", "b", None)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(300)]
    return [" ".join(r.choice(words, r.integers(1, 60))) for _ in range(150)] + ["", None, "It's 12,5 don't! É ß 日本\tx\ny", "w " * 9000]


def test_mixing_equals_sql(spark, texts, tmp_path):
    docs(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, mixing.op6_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert got == sorted(con.execute(mixing.SQL).fetchall())
    per: dict = {}
    for _, size, total, target, taken in got:
        assert taken <= 2 * size
        per.setdefault(total, [target, 0])[1] += taken
    assert all(abs(target - taken) <= 9000 for target, taken in per.values())
    assert mixing.mix(docs(spark, [])).count() == 0


def test_unequal_probabilities_equal_brute_force(spark):
    """Pareto sampling with a merit per document, drawn again in plain Python; and over many seeds, each document as often as wanted."""
    r = np.random.default_rng(14)
    sizes, merit, source = r.integers(1, 40, 240), r.uniform(0.2, 3, 240), r.integers(0, 3, 240)
    rows = [(i, " ".join(["w"] * int(sizes[i])), f"s{source[i]}", float(merit[i])) for i in range(240)] + [(240, "w w", "s0", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, merit double")
    got, wanted = {x["doc_id"]: x for x in mixing.mix(df, merit="merit").collect()}, {}
    for k in range(3):
        own = [i for i, _, s, _ in rows if s == f"s{k}"]
        size = {i: len(rows[i][1].split()) for i in own}
        good = {i: rows[i][3] or 0.0 for i in own}
        total, target = sum(size.values()), got[own[0]]["target"]
        levels, capped, worth = [], 0, sum(size[i] * good[i] for i in own)
        for i in sorted(own, key=good.get, reverse=True):
            if good[i]:
                levels.append((target - 2 * capped) / worth)
            capped, worth = capped + size[i], worth - size[i] * good[i]
        want = {i: min(2.0, max(levels) * good[i]) for i in own}
        wanted.update(want)
        certain = sum(int(want[i]) * size[i] for i in own)
        u = {i: (int(hashlib.md5(f"17:{i}:{hashlib.md5(rows[i][1].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in own}
        odds = {i: u[i] / (1 - u[i]) / ((want[i] % 1) / (1 - want[i] % 1)) for i in own if want[i] % 1}
        upto, copies = 0, {i: int(want[i]) for i in own}
        for i in sorted(odds, key=odds.get):
            upto += size[i]
            copies[i] += upto - size[i] / 2 <= target - certain
        assert {i: got[i]["copies"] for i in own} == copies and got[own[0]]["source_size"] == total
    assert got[240]["copies"] == 0
    often = np.zeros(241)
    for seed in range(25):
        for x in mixing.mix(df, merit="merit", seed=seed).select("doc_id", "copies").collect():
            often[x["doc_id"]] += x["copies"] / 25
    want = np.array([wanted[i] for i in range(241)])
    assert np.abs(often - want).mean() < 0.1 and np.corrcoef(often, want)[0, 1] > 0.95


def test_packing_equals_brute_force(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = np.array(ids[i : i + 4096], "<u4")
            want[d, i // 4096] = (i, len(part), zlib.crc32(part.tobytes()))
    rows = packing.pack(docs(spark, texts)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack(docs(spark, [])).count() == 0


def test_plan_fills_every_slot_once():
    r = np.random.default_rng(4)
    for _ in range(20):
        histogram = {int(x): int(r.integers(1, 500)) for x in r.integers(1, 101, 12)}
        plan = packing.best_fit_plan(histogram, 100)
        used: dict = {}
        for i, (length, rank, first, offset) in enumerate(plan):
            upto = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else histogram[length]
            for k in range(upto - rank):
                used.setdefault(first + k, []).append((offset, length))
        assert sum(len(v) for v in used.values()) == sum(histogram.values())
        for slots in used.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= 100


def test_neighbours_and_recall(spark):
    r = np.random.default_rng(6)
    v = r.standard_normal((900, 16)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (None, [1.0] * 16), (960, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    exact = {}
    w = v.astype(float)
    for q in range(0, 900, 20):
        s = (w * w[q]).sum(1)
        s[q] = -np.inf
        exact[q] = [(int(i), float(s[i])) for i in np.lexsort((np.arange(900), -s))[:20]]
    for relax, least in ((1.0, 1.0), (2.0, 0.9)):
        got: dict = {}
        for x in vptree.nearest(df, F.col("vec_id") % 20 == 0, relax=relax).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
        assert set(exact) <= set(got)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact)
        assert hits >= least * 20 * len(exact)
        if relax == 1:
            assert all([i for i, _ in got[q]] == [i for i, _ in exact[q]] for q in exact)
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ids_above_double_precision_beside_null(spark, tmp_path):
    """Ids near 2**63 and a null in one batch: none is rounded on its way through Python."""
    ids = [(1 << 53) + 1, None, (1 << 53) + 3, (1 << 62) + 1]
    df = spark.createDataFrame([(i, "good words of a text", "en", "s", 1) for i in ids], SCHEMA).coalesce(1)
    _, labels, _ = labelled_docs(spark)
    sample = labelled.labelled_sample(labelled_docs(spark)[0], labels, "toxic", F.lit(True), 100)
    of = lambda rows: sorted((r["doc_id"] for r in rows), key=str)
    want = sorted(ids, key=str)
    assert of(packing.pack(df).collect()) == want
    assert of(toxicity.score(df, toxicity.fit(sample)).collect()) == want
    model = quality.fit(sample)
    assert of(quality.score(df, model).collect()) == want
    assert of(quality.keep(df, model, least=0.0).collect()) == want


def test_special_strings_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = ["x <|endoftext|> y", "a<|startoftext|>b <|endoftext|>", "<|endoftext", "x <|ENDOFTEXT|> y"]
    for r in packing.pack(docs(spark, special)).collect():
        part = np.array([*t.encode(special[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))


def test_labelled_sample_is_bounded_in_rows(spark):
    df = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    got = labelled.labelled_sample(df, labels, "toxic", F.lit(True), 100).collect()
    assert sorted((r["key"], r["label"]) for r in got) == [(1, 1), (2, 1)]


def test_neighbours_with_many_ties(spark):
    r = np.random.default_rng(12)
    v = r.integers(0, 2, (1500, 12))
    v[:, 0] = 1
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(1500)] + [(7, [float(x) for x in v[7]])] * 3, "vec_id long, embedding array<double>")
    got: dict = {}
    for x in vptree.nearest(df, F.col("vec_id") % 20 == 0, relax=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    for q in range(0, 1500, 20):
        s = (v * v[q]).sum(1).astype(float)
        s[q] = -1
        assert got[q] == [(int(i), float(s[i])) for i in np.lexsort((np.arange(1500), -s))[:20]]


def test_neighbours_of_every_length(spark):
    rows = [(i, [float(x + 1) for x in range(1 + i // 2)]) for i in range(140)]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True)).collect()
    assert {(x["query_id"], x["vec_id"]) for x in got} == {(i, i ^ 1) for i in range(140)}


def test_html_fixture():
    field = html_text.default_field()
    page = "<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies on this site.</p></div><article><h1>A &amp; B</h1><p>First  paragraph\n of <b>text</b>&nbsp;here, long enough.<p>Second one, it is unclosed.<br><ul><li>One item here.</li></ul></article><aside><p>Other stories</p></aside><section id=comments><p>Nice article, thanks.</p></section><form><label>Mail</label><button>Send</button></form><footer>&copy; Site</footer></body>"
    assert html_text.main_text(page, field) == "A & B\nFirst paragraph of text here, long enough.\nSecond one, it is unclosed.\nOne item here."
    assert html_text.main_text("", field) == "" and html_text.main_text("<nav><a href=/>x</a></nav>", field) == ""


def test_html_open_head_and_formulas():
    field = html_text.default_field()
    article = "<article><h1>A heading</h1><p>The first paragraph, long enough to be read.</p><p>The second one, with more words in it.</p></article>"
    want = "A heading\nThe first paragraph, long enough to be read.\nThe second one, with more words in it."
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title><style>p{}</style>", "<html><head><title>T</title><script>var a = 1;</script>\n<noscript><p>Switch it on.</p></noscript><body class=x>", "<head><title>T</title></head><body><head>"):
        assert html_text.main_text(start + article, field) == want, start
    assert [t for _, t, _ in html_text.leaves("<head><title>T</title>Bare text.<p>More.")] == ["Bare text.", "More."]
    formula = "<head></head><body><article><p>The sum is <math><mi>a</mi><mo>+</mo><mn>17</mn></math> in all of the cases.</p></article></body>"
    assert html_text.main_text(formula, field) == "The sum is a+17 in all of the cases."


def test_html_that_ends_within_markup():
    field = html_text.default_field()
    start = "<article><h1>A heading of it</h1><p>Good sentence, which is long enough to be read.</p>"
    want = "A heading of it\nGood sentence, which is long enough to be read."
    for end in ("<!-- unclosed <p>more text that is none</p>", '<a href="x', "</p", "<!DOCTYPE", "<?php echo"):
        assert html_text.main_text(start + end, field) == want, end


def test_deep_pages_take_time_in_proportion():
    field = html_text.default_field()
    took = {}
    shapes = {"open": lambda n: "<div>x" * n, "hints": lambda n: "".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}">x' for i in range(n)), "stray": lambda n: "<b><table>" + "<div>" * n + "</b>x" * n}
    for name, page in shapes.items():
        for n in (2_000, 32_000):
            began = time.process_time()
            html_text.main_text(page(n), field)
            took[name, n] = time.process_time() - began
        assert took[name, 32_000] < 60 * took[name, 2_000] + 1, took  # 16 times, not 256


def test_scores_of_ancestors_are_those_of_their_features():
    field = html_text.default_field()
    for page in html_train.pages(20, seed=5):
        found = html_text.leaves("".join(part for part, _ in page))
        plain = np.array([field.emission[field.columns(html_text.features(b))].sum(0) for b in found])
        assert np.allclose(field.emissions(found), plain)


def test_html_held_out_accuracy():
    field, right, total = html_text.default_field(), 0, 0
    for page in html_train.pages(80, seed=99):
        found = html_text.leaves("".join(part for part, _ in page))
        want = {" ".join(t.split()) for part, main in page if main for _, t, _ in html_text.leaves(part)}
        states = field.decode([field.columns(html_text.features(b)) for b in found])
        right += sum(bool(k) == (t in want) for (_, t, _), k in zip(found, states, strict=True))
        total += len(found)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    field = html_text.default_field()
    rows = [[1, 5], [9], [3, 77], [12]]
    score = lambda path: field.start[path[0]] + sum(field.emission[r].sum(0)[k] for r, k in zip(rows, path, strict=True)) + sum(field.transition[a, b] for a, b in zip(path, path[1:], strict=False))
    best = max((tuple(map(int, f"{i:04b}")) for i in range(16)), key=score)
    assert score(field.decode(rows)) == pytest.approx(score(best))


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "z"), (1, "u", "<article><p>Some main text of a page.</p></article>", "z"), (None, None, "", "z")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract(df).collect()) == ["", "", "Some main text of a page."]


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://é/ b", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, "u", "y" * 200_000), (7, None, None), (8, "u", ""), (9, "u", "<p>x</p>")] + [(i, "u", f"page {i} " * 50) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    first: dict = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        data, to = (h or "").encode(), first[h or ""]
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if to == i else ("revisit", to))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(warc.SQL).fetchall()) == sorted(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.values())
    back = {r["record_id"]: r for r in warc.read_archives(warc.write_records(df)).collect()}
    assert bytes(back["2"]["payload"]).decode() == "y" * 200_000 and back["3"]["url"] == "http://é/ b"
    assert all(r["record_type"] == "response" for r in warc.read_archives(warc.write_records(df, least_bytes=1 << 30)).collect())
    assert warc.read_archives(warc.write_records(df.limit(0))).count() == 0


def test_warc_of_many_equal_ids(spark):
    """Ids that say nothing: many nulls, rows equal in all, one id with several payloads and addresses, large payloads."""
    rows = [(None, "u", f"page {i} " * 40) for i in range(1500)] + [(None, "u", "same")] * 700 + [(5, "u", "same"), (5, "v", "same"), (5, "u", "other"), (5, "u", "other")]
    rows += [(100 + i, "u", chr(97 + i) * (6 << 20)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archives = warc.write_records(df)
    sizes = [sum(1 for _ in warc.frames(r["content"])) for r in archives.collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 4 and max(sizes) < 900
    ids = [warc.parse_record(raw)["headers"]["warc-record-id"] for r in archives.collect() for raw in warc.frames(r["content"])]
    assert len(set(ids)) == len(ids)
    back = [warc.parse_record(raw) for r in archives.collect() for raw in warc.frames(r["content"])]
    assert {x["headers"]["warc-refers-to"] for x in back if x["type"] == "revisit"} <= {x["headers"]["warc-record-id"] for x in back if x["type"] == "response"}
    got = warc.read_archives(archives).groupBy("record_id", "record_type", "refers_to", "payload_bytes").count().collect()
    found = {(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]): r["count"] for r in got}
    assert found["null", "revisit", "5", 4] == 700 and found["5", "revisit", "5", 4] == found["5", "response", None, 4] == 1  # a real id is the one to refer to
    assert found["5", "response", None, 5] == found["5", "revisit", "5", 5] == 1
    assert all(r["record_type"] == "response" for r in warc.read_archives(warc.write_records(df, least_bytes=1 << 30)).collect())


def test_warc_damage(spark):
    records = [warc.record_bytes(str(i), "u", f"body {i}".encode() * 30, 30 * len(f"body {i}"), warc.digest32(f"body {i}".encode() * 30), None) for i in range(60)]
    content = warc.write_archive(records)
    assert list(warc.frames(content)) == records
    with pytest.raises(warc.WarcError):
        list(warc.frames(content[:-5]))
    for bad in (b"", b"HTTP/1.1 200\r\n\r\n", records[0][:-1], records[0].replace(b"body 0", b"body 1", 1), records[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    df = spark.createDataFrame([(bytearray(content[:-5]),)], "content binary")
    assert warc.read_archives(df, strict=False).where("error IS NOT NULL").count() == 1


def labelled_docs(spark):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(3, 8))) for _ in range(300)]
    rows, marks = [], []
    for i in range(400):
        own = list(r.choice(words, r.integers(20, 80)))
        toxic, good = i % 4 == 0, i % 5 != 0
        if toxic:
            own[3], own[7] = "vilething", "nastyword"
        if not good:
            own = [w + "###" for w in own]
        rows.append(" ".join(own))
        marks.append((i, int(good), int(toxic)))
    return docs(spark, rows), spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), marks


def test_classifiers_on_held_out(spark, tmp_path):
    df, labels, marks = labelled_docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for run, at, folds, fold in ((quality.op9_quality, 1, 3, 1), (toxicity.op8_toxicity, 2, 5, 0)):
        got = {r["doc_id"]: r for r in run(spark, str(tmp_path)).collect()}
        held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % folds == fold]
        assert all(got[m[0]]["held_out"] == (m in held) for m in marks)
        assert sum(got[m[0]]["predicted"] == m[at] for m in held) >= 0.95 * len(held)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_classifiers_stand_odd_rows(spark):
    df, labels, _ = labelled_docs(spark)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "12 !!"), (3, "long " * 50_000)], "doc_id long, text string")
    sample = labelled.labelled_sample(df, labels, "toxic", F.lit(True), 100)
    assert sample.count() == 100
    index, model = toxicity.fit(sample), quality.fit(sample)
    assert toxicity.score(odd, index).count() == quality.score(odd, model).count() == 5
    none = labelled.labelled_sample(df, labels.limit(0), "toxic", F.lit(True), 100)
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(none)).collect()} == {0.0}
    assert {r["score"] for r in quality.score(odd, quality.fit(none)).collect()} == {0.5}


def test_block_max_search_is_exact(spark):
    df, labels, _ = labelled_docs(spark)
    index = toxicity.fit(labelled.labelled_sample(df, labels, "toxic", F.lit(True), 400))
    dense = np.zeros((index.size, len(index.idf)))
    for j, parts in enumerate(index.postings):
        for b, (at, w) in parts.items():
            dense[b * toxicity.BLOCK + at, j] = w
    for r in df.limit(60).collect():
        columns, n = index.query(r["text"])
        q = np.zeros(len(index.idf))
        q[columns] = n * index.idf[columns]
        cos = dense @ (q / np.linalg.norm(q))
        assert np.allclose(np.sort(cos)[::-1][: toxicity.NEAREST], index.nearest(columns, n)[1], atol=1e-9)


def dense_index(index):
    dense = np.zeros((index.size, len(index.idf)))
    for j, parts in enumerate(index.postings):
        for b, (at, w) in parts.items():
            dense[b * toxicity.BLOCK + at, j] = w
    return dense


def test_toxicity_scores_equal_brute_force(spark):
    """Votes and calibration in plain Python, from all cosines."""
    df, labels, _ = labelled_docs(spark)
    index = toxicity.fit(labelled.labelled_sample(df, labels, "toxic", F.lit(True), 300))
    dense = dense_index(index)

    def vote(q, without=None):
        cos = dense @ (q / np.linalg.norm(q))
        order = [i for i in np.lexsort((np.arange(len(cos)), -np.round(cos, 12))) if i != without][: toxicity.NEAREST]
        weight = [1 / (1 - min(cos[i], 1) + toxicity.NEARLY) for i in order]
        return sum(w * index.labels[i] for w, i in zip(weight, order, strict=True)) / sum(weight)

    votes = np.array([vote(row, i) for i, row in enumerate(dense)])
    order = np.argsort(votes, kind="stable")
    y = index.labels[order]
    pooled = [max(min(y[i : k + 1].mean() for k in range(j, len(y))) for i in range(j + 1)) for j in range(len(y))]  # isotonic, by its definition
    at, to = index.curve
    assert (np.diff(at) > -1e-12).all() and (np.diff(to) > 0).all() and abs(np.interp(votes[order], at, to) - pooled).max() < 1 and np.allclose(sorted(set(np.round(pooled, 9))), np.round(to, 9))
    for r in df.limit(80).collect():
        columns, n = index.query(r["text"])
        q = np.zeros(len(index.idf))
        q[columns] = n * index.idf[columns]
        score, near = index.vote(r["text"])
        assert score == pytest.approx(index.calibrated(vote(q)), abs=1e-6) and 0 <= score <= 1
        assert near[0][1] == pytest.approx((dense @ (q / np.linalg.norm(q))).max())


def test_quality_scores_equal_brute_force(spark):
    """Neighbours and votes from all cosines, one text at a time."""
    df, labels, _ = labelled_docs(spark)
    model = quality.fit(labelled.labelled_sample(df, labels, "quality", F.lit(True), 300))
    texts = [r["text"] for r in df.limit(60).collect()] + ["one", "###"]
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        z = model.project(model.weigh(quality.counts(text)[None]))[0].astype(np.float64)
        cos = model.vectors.astype(np.float64) @ z
        last = np.sort(cos)[-quality.NEAREST]
        sure, border = np.nonzero(cos > last + 1e-5)[0], np.nonzero(abs(cos - last) <= 1e-5)[0]

        def vote(first):
            """With those of label `first` before others among the ones that tie, up to rounding, for the last places."""
            rest = sorted(border, key=lambda k: abs(model.labels[k] - first))[: quality.NEAREST - len(sure)]
            near = [*sure, *rest]
            weight = np.exp(quality.SHARPNESS * (cos[near] - 1))
            return (weight * model.labels[near]).sum() / weight.sum()

        assert vote(0) - 1e-3 <= got[i] <= vote(1) + 1e-3


def test_pipeline(spark, tmp_path):
    df, labels, marks = labelled_docs(spark)
    extra = df.where("doc_id IN (1, 2, 3)").withColumn("doc_id", F.col("doc_id") + 1000)
    df.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs_, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), df.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = corpus_pipeline.materialize(stage(spark, docs_, str(tmp_path)), "test")
        assert docs_.columns == columns, name
        seen.append({r["doc_id"] for r in docs_.select("doc_id").collect()})
    good = {m[0] for m in marks if m[1]}
    assert len(good - seen[0]) <= 0.02 * len(good) and len(seen[0] & {m[0] for m in marks if not m[1]}) <= 4
    assert seen[1] == seen[0] and not seen[2] & {1002, 1003} and seen[3] <= seen[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 0


def test_stages_tell_documents_apart_without_ids(spark):
    r = np.random.default_rng(11)
    text = lambda: " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(60))
    alone = [text() for _ in range(5)]
    rows = [(None, t, "en", "a", 1) for t in alone] + [(None, alone[0], "en", "a", 1)] * 2
    one, two, copied = text(), text(), text()
    rows += [(7, one, "en", "a", 1), (7, two, "en", "b", 1), (8, copied, "en", None, 1), (7, copied, None, "a", 1), (None, copied, "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.near_dedup(spark, df, "").collect()), key=repr)
    assert kept == sorted([(None, t) for t in alone] + [(7, one), (7, two), (7, copied)], key=repr)
    taken = mixing.mix(df).agg(F.sum("copies")).first()[0]
    mixed = corpus_pipeline.mix_sources(spark, df, "").groupBy(*df.columns).count().collect()
    assert abs(sum(x["count"] for x in mixed) - taken) <= 3  # a document more or less in each source, by other random numbers
    assert all(x["count"] <= 2 * rows.count(tuple(x)[:-1]) for x in mixed)


def test_fit_of_quality_holds_few_copies_of_its_counts():
    """The driver fits the model: beside the counts it holds two copies of them at most, and little else."""
    rows = np.random.default_rng(1).poisson(0.3, (2048, quality.BUCKETS + quality.EXTRA)).astype(np.float32)
    labels = np.arange(2048) % 2
    tracemalloc.start()
    quality.LatentModel(rows, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.6 * rows.nbytes, peak / rows.nbytes
