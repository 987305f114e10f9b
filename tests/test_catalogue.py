"""Every catalogue query against its SQL, and the repository without its llm parts."""

import os
import shutil
import subprocess
import sys

import pytest

from ledgerweave.plans import catalogue

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return ""
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    rows, order = df.collect(), sorted(df.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


@pytest.mark.parametrize(
    "pages",
    [
        [(i, f"http://{i:05}/" + "u" * 21000) for i in range(80)],  # all too large, many of one size
        [(i, "u" * (21000 if i % 2 else 3)) for i in range(80)],  # texts that are equal, read or not
        [(i, f"u{i}") for i in range(40) if i != 7] + [(None, "v"), (80, None)],  # no empty file; pages without an id
        [],
    ],
    ids=["one size", "equal", "no id", "none"],
)
def test_each_different_file_is_taken_in_once(spark, tmp_path, pages):
    """files_accepted tells files that are too large apart by their text, as its SQL does."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.queries()["files_accepted"](spark, str(tmp_path)).select("document_id", "size", "refusals").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT document_id, size, refusals FROM ({catalogue.oracle_sql()['files_accepted']})").fetchall()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_without_the_llm_parts(tmp_path):
    """The driver's contract holds when the llm folders and the pipeline are gone."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'decision_summary' in q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
