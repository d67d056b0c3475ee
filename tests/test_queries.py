"""Every query with SQL agrees with it; the others run."""

import pytest

from memloom import queries as memory

from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(memory.QUERIES))
def test_query(spark, con, name):
    df = memory.QUERIES[name](spark, SF)
    if name in memory.SQL:
        assert_same(df, con, memory.SQL[name])
    else:
        assert df.count() >= 0


def test_every_standing_query_is_read(spark):
    items = {r.query_id for r in memory.QUERIES["standing_queries_whole"](spark, SF).select("query_id").distinct().collect()}
    assert max(items) >= 10


def test_entry_imports_without_the_corpus_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "memloom", tmp_path / "memloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
