"""Every stage of the pipeline against plain Python, on documents without ids, with one id for several texts, and clashing columns."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_text_operators import fingerprint, lines_by_force, roots

import corpus_pipeline
from rillflow.llm import mixing, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, copies int, n long, key string"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(21)
    words = ["".join(r.choice(list("abcdefghijklmnop"), r.integers(3, 8))) for _ in range(300)]
    text = lambda n: "\n".join(" ".join(r.choice(words, 12)) for _ in range(n))
    base = [text(int(k)) for k in r.integers(1, 9, 40)]
    out = [(i, t) for i, t in enumerate(base)] + [(100, base[3]), (101, base[3].replace(base[3].split()[0], "changed", 1)), (None, base[7]), (None, text(4)), (None, text(5)), (102, ""), (103, None), (7, text(3)), (104, base[5] + "\n" + base[6]), ((1 << 53) + 1, text(6))]
    rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "r", "d", k % 2, k, "k") for k, (i, t) in enumerate(out)]
    return rows + [rows[8], rows[8]]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_quality(spark, rows, frame, tmp_path):
    spark.createDataFrame([(r[0], int(k % 3 > 0)) for k, r in enumerate(rows) if r[0] is not None], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.quality_filter(spark, frame, str(tmp_path))
    model = quality.quality_model(spark, str(tmp_path), frame)
    assert got.columns == frame.columns
    assert bag(got) == Counter(r for r in rows if model.score([r[1] or ""])[0] >= 0.5)


def test_line_dedup(spark, rows, frame):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))  # ids in order, a null one last
    gone = lines_by_force([rows[k][1] for k in order])
    got = corpus_pipeline.line_dedup(spark, frame, "")
    have = got.collect()
    assert got.columns == frame.columns and len(have) == len(rows)
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in have)
    # Which of several rows with one id comes first is a matter of hashes; those with an id of their own are certain.
    alone = {i for i, n in Counter(r[0] for r in rows).items() if n == 1 and i is not None}
    clean = {x["doc_id"]: x["text"] for x in have}
    for at, k in enumerate(order):
        i, t = rows[k][0], rows[k][1]
        if i in alone and t is not None:
            assert clean[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[at])
    assert sum(map(len, gone.values())) > 20


def test_near_dedup(spark, rows, frame):
    got = corpus_pipeline.near_dedup(spark, frame, "")
    prints = [fingerprint(r[1]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert got.columns == frame.columns
    kept = [tuple(x) for x in got.collect()]
    assert set(kept) <= set(rows) and len(kept) == len(set(root))
    at = {r: k for k, r in reversed(list(enumerate(rows)))}
    assert sorted(root[at[x]] for x in kept) == sorted(set(root))
    for x in kept:
        group = [rows[k][0] for k in range(len(rows)) if root[k] == root[at[x]]]
        assert x[0] == min((i for i in group if i is not None), default=None)


def test_mixing(spark, rows, frame):
    got = corpus_pipeline.mix_sources(spark, frame, "")
    assert got.columns == frame.columns
    taken = bag(got)
    assert set(taken) <= set(rows) and all(n <= 2 * rows.count(r) for r, n in taken.items())
    size = lambda r: len((r[1] or "").split())
    targets = {x["source"]: x["target"] for x in mixing.mix(frame).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        have = sum(n * size(r) for r, n in taken.items() if r[3] == source)
        assert abs(have - target) <= max(size(r) for r in rows if r[3] == source)


def test_packing(spark, rows, frame):
    got = corpus_pipeline.pack_sequences(spark, frame, "").collect()
    ids = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r[0], len(ids.direct(r[1] or "")) + 1) for r in rows)
    assert Counter((x["doc_id"], x["length"]) for x in got) == want
    ends: dict = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 4096


def test_stages_stand_an_empty_table(spark, frame):
    none = frame.limit(0)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mix_sources, corpus_pipeline.pack_sequences):
        assert stage(spark, none, "").count() == 0
