"""The queries over wrapped rows, and the entry without the training-text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import verify
from folioworks import registry, registry_more

SF = "/root/testdata/sf0.001"
NAMES = ["markup_scalars", "page_references", "sanitized_parts", "han_search_keys", "display_scalars", "text_cards", "scoped_search", "parsed_contents", "docs_of_node", "entries_and_states", "score_terms_found", "quick_search_ranked"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    assert hasattr(registry_more, name)
    db = duckdb.connect()
    for t in verify.TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cur = db.execute(registry.ORACLE_SQL[name])
    got = verify.rows(df.columns, df.collect())
    assert got and got == verify.rows([c[0] for c in cur.description], cur.fetchall())


def test_display_of_empty_and_missing(spark, tmp_path):
    """Documents without characters, and with nulls, as the SQL shows them."""
    rows = [(i, "t", "en", source, n) for i, (source, n) in enumerate([(x, y) for x in ("src1", "src19", None) for y in (0, None, 5, 3_000_000)])] + [(None, "t", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, cur = registry.QUERIES["display_scalars"](spark, str(tmp_path)), db.execute(registry.ORACLE_SQL["display_scalars"])
    assert verify.rows(df.columns, df.collect()) == verify.rows([c[0] for c in cur.description], cur.fetchall())


def test_entry_without_training_text_operators(tmp_path):
    root = Path(__file__).parent.parent
    shutil.copytree(root / "folioworks", tmp_path / "folioworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'full_text_search' in q and not any(x.startswith('op1_') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"]
    subprocess.run(run, cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
