"""What must hold of the physical plans whatever the size of the data."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paraloom.operators import groups, topics, vectors
from paraloom.plans import catalogue, outputs

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_seeds_ride_along_and_no_vector_is_shuffled(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id int, embedding array<double>").repartition(4).selectExpr("vec_id + 0 as vec_id", "embedding")
    seeds = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "seed_id int, centroid array<double>")
    before = plan(v).count("Exchange hashpartitioning") + plan(v).count("Exchange RoundRobin")
    text = plan(vectors.seed_affinity(v, seeds, "vec_id"))
    assert text.count("Exchange hashpartitioning") + text.count("Exchange RoundRobin") == before and "BroadcastNestedLoopJoin" in text
    got = {r.vec_id: r.seed for r in vectors.seed_affinity(v, seeds, "vec_id").collect()}
    assert got[0] == 1 and got[1] == 0 and got[2] == 0


def test_too_many_seeds_fail(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_SEEDS", 1)
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    seeds = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "seed_id int, centroid array<double>")
    with pytest.raises(Exception, match="over 1 seeds"):
        vectors.seed_affinity(v, seeds, "vec_id").collect()


def test_documents_meet_keywords_where_they_are(spark):
    tokens = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "doc_id int, tokens array<string>")
    keywords = spark.createDataFrame([(0, 1, "a"), (0, 2, "c")], "topic int, rank int, term string")
    found = topics.keyword_documents(tokens, keywords, "doc_id")
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, "c")] and "SortMergeJoin" not in plan(found)


def test_the_permutation_test_ranks_no_documents(spark):
    df = spark.createDataFrame([(i, i % 3, "L" if i % 2 else "R") for i in range(60)], "doc_id int, topic int, grp string")
    text = plan(groups.permutation_test(df, "L", "R", 20))
    assert "row_number" not in text and "md5" not in text


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.queries()["yearly_counts"](spark, str(DATA)))
    schemas = [line for line in text.split("\n") if "ReadSchema" in line]
    assert schemas and not any("text:string" in x or "filename" in x for x in schemas)
    rules = plan(catalogue.queries()["para_valid"](spark, str(DATA)))
    assert "PushedFilters: [IsNotNull(text)]" in rules or "isnotnull(text" in rules


@needs_data
def test_all_result_files_are_written(spark, tmp_path):
    names = outputs.write_outputs(spark, str(DATA), str(tmp_path))
    assert len(names) == 18
    read = lambda n: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/{n}")
    assert read("yearly_paragraph_counts").columns == ["year", "num_paragraphs"]
    assert read("potential_focusing_events").columns == ["Date", "Topic", "Topic_Name", "Z_Score"]
    sizes = read("topics_over_time_absolute").agg(F.sum(F.col("Frequency").cast("int"))).first()[0]
    assert sizes == catalogue.docs(spark, str(DATA)).where("topic is not null").count()
    assert read("topics_over_time_normalized").where("cast(Frequency as double) > 1").count() == 0


@needs_data
def test_every_query_on_empty_tables(spark, tmp_path):
    for path in DATA.glob("*.parquet"):
        spark.read.parquet(str(path)).where("false").write.parquet(str(tmp_path / path.name))
    given = {"para_skip_counts": 8, "stop_words": 286, "corpus_stats": 1, "summary_report": 12}
    for name, query in catalogue.queries().items():
        assert len(query(spark, str(tmp_path)).collect()) == given.get(name, 0), name
