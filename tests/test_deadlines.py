"""Scores and deadlines: in tables, and as streams, where late ones leave the default and states leave the memory."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rillflow.streaming import deadlines

START = datetime(2024, 5, 1, 12)
STATE, SCORE = "key long, asked_at timestamp, deadline long, name string", "key long, scored_at timestamp, score double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_formulas(spark):
    row = spark.range(1).select(
        deadlines.build_deadline(F.lit(30), F.lit(5), F.lit(16)), deadlines.build_deadline(F.lit(0), F.lit(5), F.lit(16)), deadlines.build_deadline(F.lit(-10), F.lit(5), F.lit(16)),
        deadlines.judge_deadline(F.lit(30), F.lit(3)), deadlines.questions_deadline(F.lit(30), F.lit(5), F.lit(16), F.lit(4)), deadlines.questions_deadline(F.lit(1), F.lit(1), F.lit(1), F.lit(4)),
    ).first()
    assert tuple(row) == (2460, 60, 40, 150, 1230, 60)


def test_tables(spark):
    states = [(1, at(0), 60, "in time"), (2, at(0), 60, "late"), (3, at(0), 60, "none"), (4, at(0), 60, "at the end"), (5, at(10), 60, "before it was asked"), (None, at(0), 60, "no key"), (6, at(0), None, "no deadline"), (7, None, 60, "no time"), (8, at(0), 60, "null score"), (9, at(0), 9000, "beyond the longest")]
    scores = [(1, at(59), 0.5), (2, at(61), 0.5), (4, at(60), 0.5), (5, at(9), 0.5), (None, at(1), 0.5), (6, at(1), 0.5), (7, at(1), 0.5), (8, at(1), None), (9, at(3601), 0.5), (99, at(1), 0.5)]
    got = deadlines.scores_in_time(spark.createDataFrame(states, STATE), spark.createDataFrame(scores, SCORE))
    assert {r["name"]: (r["score"], r["in_time"]) for r in got.collect()} == {"in time": (0.5, True), "late": (0.0, False), "none": (0.0, False), "at the end": (0.5, True), "before it was asked": (0.0, False), "no key": (0.0, False), "no deadline": (0.0, False), "no time": (0.0, False), "null score": (0.0, True), "beyond the longest": (0.0, False)}
    assert got.columns == ["key", "asked_at", "deadline", "name", "score", "in_time"]


def test_streams(spark, tmp_path):
    """Files of states and scores arrive in turn; the query is started again from its checkpoint for each."""
    folders = {"states": (str(tmp_path / "states"), STATE), "scores": (str(tmp_path / "scores"), SCORE)}

    def arrive(states, scores):
        for rows, (path, schema) in zip((states, scores), folders.values(), strict=True):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(schema).parquet(path) for path, schema in folders.values()]
        joined = deadlines.scores_in_time(*streams, late="5 seconds", longest="100 seconds")
        q = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        done = {r["name"]: (r["score"], r["in_time"]) for r in spark.read.schema(joined.schema).parquet(str(tmp_path / "out")).collect()}
        held = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
        return done, held

    done, held = arrive([(1, at(0), 60, "early"), (2, at(0), 60, "late"), (3, at(0), 60, "never")], [(1, at(30), 0.9)])
    assert done == {"early": (0.9, True)} and held > 0  # the others still may get a score
    done, _ = arrive([(4, at(90), 60, "second")], [(2, at(61), 0.7), (4, at(95), 0.4)])
    assert done == {"early": (0.9, True), "second": (0.4, True)}  # 2's score is past its deadline
    done, held = arrive([(5, at(1000), 60, "third")], [(99, at(1000), 0.1)])
    assert done == {"early": (0.9, True), "second": (0.4, True), "late": (0.0, False), "never": (0.0, False)}
    assert held == 2  # the third state, and the score of no state: all that the watermark has passed is gone
    done, _ = arrive([(6, at(2000), 60, "fourth")], [(5, at(1010), 0.6), (6, at(2001), 0.3)])
    assert done["third"] == (0.6, True) and done["fourth"] == (0.3, True)  # within the lag of its side
