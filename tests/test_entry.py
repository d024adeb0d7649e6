import ast
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_nothing_outside_imports_the_optional_part():
    for path in (ROOT / "paraloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        names = [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names]
        names += [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
        assert not [n for n in names if ".llm" in n], path


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_core_queries_match_their_sql(spark):
    from paraloom.plans import catalogue

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    queries = catalogue.queries()
    for name in ("group_topic_diff", "para_skip_counts", "null_model_add_one", "evolution_up", "volatility", "similarity_summary", "ctfidf_terms"):
        got = queries[name](spark, str(DATA)).toPandas()
        want = con.execute(catalogue.oracle_sql()[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        assert len(got) == len(want), name
        numbers = [c for c in columns if want[c].dtype.kind in "fi"]
        for c in numbers:
            assert sorted(got[c].fillna(-1e9)) == pytest.approx(sorted(want[c].fillna(-1e9)), abs=1e-6), (name, c)


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scratch_tables_go(spark):
    from pathlib import Path

    from paraloom import session

    df = session.materialize(spark.range(3).toDF("id"), "three")
    path = Path(session._scratch(spark))
    assert df.count() == 3 and list(path.glob("three-*"))
    session.clear_scratch(spark)
    assert not path.exists()


def test_a_cluster_must_name_its_shared_folder():
    import types

    from paraloom import session

    conf = types.SimpleNamespace(get=lambda *_: None)
    cluster = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://host:7077", getConf=lambda: conf), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)
