from pathlib import Path

from rillflow.sources import replay


def test_folders_go(spark):
    replay.release(spark)
    folders = [replay.batch_folder(spark) for _ in range(2)]
    for f in folders:
        spark.range(3).write.parquet(f"{f}/rows")
    assert len(set(folders)) == 2 and all(Path(f.removeprefix("file://")).exists() for f in folders)
    assert replay.release(spark) == 2 and replay.release(spark) == 0
    assert not any(Path(f.removeprefix("file://")).exists() for f in folders)
