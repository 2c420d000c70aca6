import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from streamloom import queries as core
from streamloom.benchmark import compare, levels
from streamloom.worker import main as worker

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    want = con.execute(core.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = core.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want.fetchall())


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


def test_worker(spark, capsys):
    assert worker(["--job", "other"]) == 1
    assert worker(["--records", "2000"]) == 0
    assert "written=2000" in capsys.readouterr().out


def test_levels_and_compare():
    assert levels("1, ,8") == [1, 8]
    for bad in ("0", "", "-1"):
        with pytest.raises(ValueError):
            levels(bad)
    got = {"results": [{"parallelism": 1, "records_per_sec": 80.0}, {"parallelism": 2, "records_per_sec": 90.0}, {"parallelism": 4, "records_per_sec": 1.0}]}
    want = {"results": [{"parallelism": 1, "records_per_sec": 100.0}, {"parallelism": 2, "records_per_sec": 100.0}]}
    assert compare(got, want, 15) == ["parallelism 1 is 20.0% slower"]


def test_library_does_not_need_the_optional_subpackage():
    code = "import sys; sys.modules['streamloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'identity_events' in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)
