"""Every catalogue query with SQL equals DuckDB on the small tables; the others run; the entry works."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rillflow.plans import catalogue
from rillflow.sources import tasks

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, DATA)
    ran = oracle.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(r) for r in ran.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want


def test_metric_table_of_large_keys(spark, tmp_path):
    """Supplier keys 1000 apart, as larger tables have: each keeps its use prompt and its build."""
    spark.createDataFrame([(k + 1000 * i,) for k in range(1, 7) for i in range(3)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["rollout_metric_table"]).fetchall()
    got = catalogue.QUERIES["rollout_metric_table"](spark, str(tmp_path)).select("batch_id", "name", "value").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {f"task_{t}" for t in tasks.BANDS}))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("task", sorted(tasks.BANDS))
def test_generated_rows_verify(spark, task):
    rows = tasks.generate(spark, task)
    total, fine = rows.count(), rows.where("verified").count()
    assert total == fine == sum(b[1] for b in tasks.BANDS[task])
    kept = tasks.dataset(spark, task)
    assert kept.count() == kept.select("split", "question").distinct().count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    root = Path(entry.__file__).parent / "rillflow"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "rillflow.llm" in p.read_text()]
