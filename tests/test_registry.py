"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql()) & set(__spark_entry__.queries())))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", [n for n in sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())) if not n.startswith("op") and n != "pipeline"])
def test_query_without_sql_runs(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [["matchloom/llm", "tests/llm"], ["matchloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_loads_without_the_optional_parts(tmp_path, gone):
    root = Path(__spark_entry__.__file__).resolve().parent
    for part in ("matchloom", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / part).is_dir():
            shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", *[Path(g).name for g in gone if Path(g).parent.name == part]))
        elif part not in gone and (root / part).exists():
            shutil.copy(root / part, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "", "PYTHONPATH": str(tmp_path) + ":" + ":".join(p for p in sys.path if p and p != str(root))}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, pipeline, operators = said.stdout.split()
    assert int(n) >= 150 and pipeline == "False" and (operators == "False" or gone == ["corpus_pipeline.py"])
