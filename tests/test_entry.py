import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) < set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_works_without_the_training_data_operators(tmp_path):
    """A copy without the optional folders still imports and has all other queries."""
    import shutil

    shutil.copytree(ROOT / "notegrove", tmp_path / "notegrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "snippet" in rows.columns


@pytest.mark.parametrize("name", ["file_catalog", "chunk_documents", "bm25_phrase", "knn_cosine", "hybrid_topk", "mmr_rerank", "idf_boost", "sync_changeset", "metric_summary", "stratified_split"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    with duckdb.connect() as db:
        for path in Path(SF).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert as_rows(got) == as_rows(want)
