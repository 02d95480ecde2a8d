import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from graphloom import streaming
from graphloom.plans import ALL

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ALL) <= set(entry.queries())


def test_the_rest_does_not_need_the_subpackage():
    code = "import sys; sys.modules['graphloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "graphloom.llm" not in p.read_text(), p


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["p4_found", "p5_found", "kind_histogram", "resolve_span", "walk_forward", "prose"])
def test_queries_match_their_sql(spark, name):
    sys.path.insert(0, str(ROOT / "tools"))
    from compare import connect, rows_of

    df = entry.queries()[name](spark, SF)
    cur = connect(SF).execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_bronze_follows_its_source(spark, tmp_path):
    schema = "repo string, path string, source string, scanned_at timestamp"
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    put = lambda rows: spark.createDataFrame(rows, "repo string, path string, source string, t string").selectExpr("repo", "path", "source", "cast(t as timestamp) scanned_at").write.mode("append").parquet(str(tmp_path / "in"))
    for rows in ([("a", "x", "1", "2025-01-02"), ("b", "y", "1", "2025-01-01")], [("a", "x", "0", "2025-01-01"), ("a", "z", "2", "2025-01-03")]):
        put(rows)
        q = streaming.build_bronze(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), spark.createDataFrame([], schema).schema)
        assert q.awaitTermination(120)
    got = {(r.repo, r.path, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "x", "1"), ("b", "y", "1"), ("a", "z", "2")}
