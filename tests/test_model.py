import math

import pytest
from pyspark.sql import functions as F

from paraloom.operators import model, topics
from paraloom.streaming import paragraphs as streaming


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"malaria nets spraying mosquito bednet {'larva' if i % 4 else 'fever'}" if i % 2 else f"latrine pumps chlorine water spring {'basin' if i % 3 else 'slab'}") for i in range(60)]
    return spark.createDataFrame(rows + [(90, None), (91, ""), (92, "the of and")], "doc_id bigint, text string")


def test_model_finds_the_two_subjects_and_survives_a_restart(spark, corpus, tmp_path):
    seeds = spark.createDataFrame([(0, ["malaria nets", "spraying"]), (1, ["water pumps"])], "seed_id int, terms array<string>")
    fitted = model.fit(corpus, "doc_id", k=2, seeds=seeds, components=2, merge_above=None)
    fitted.save(str(tmp_path / "m"))
    again = model.TopicModel.load(spark, str(tmp_path / "m"))
    by = {r.doc_id: r.topic for r in again.doc_topic.collect()}
    assert len(by) == 60 and len({by[i] for i in by if i % 2}) == 1 and by[0] != by[1]
    info = {r.topic: r for r in again.topic_info.collect()}
    assert info[by[1]]["count"] == 30 and "malaria" in info[by[1]].representation and info[by[1]].name.startswith(f"{by[1]}_")


    # the fitted documents get their topics again, also after a restart, and new ones those of their subject
    first = {r.doc_id: (r.topic, round(r.prob, 9)) for r in fitted.doc_topic.collect()}
    assert {r.doc_id: (r.topic, round(r.prob, 9)) for r in again.transform(corpus).collect()} == first
    assert all(0.5 < p <= 1 for _, p in first.values())
    new = spark.createDataFrame([(1000, "mosquito nets spraying larva"), (1001, "water pumps basin"), (1002, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.topic for r in again.transform(new).collect()} == {1000: by[1], 1001: by[0]}
    assert any(" " in r.term for r in again.topic_terms.collect())  # runs of words are terms too


def test_an_embedder_of_ones_own_is_given_again(spark, corpus, tmp_path):
    embedder = lambda t: model.hashed_embedding(t, "doc_id", 64, 4)
    fitted = model.fit(corpus, "doc_id", k=2, embedder=embedder, components=2, merge_above=None, upto=1)
    fitted.save(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="given again"):
        model.TopicModel.load(spark, str(tmp_path / "m"))
    again = model.TopicModel.load(spark, str(tmp_path / "m"), embedder)
    assert {tuple(r)[:2] for r in again.transform(corpus).collect()} == {tuple(r)[:2] for r in fitted.doc_topic.collect()}


def test_small_topics_go_to_the_most_similar(spark, corpus):
    fitted = model.fit(corpus, "doc_id", k=6, components=2, merge_above=None, min_topic_size=20)
    sizes = {r.topic: r["count"] for r in fitted.topic_info.collect()}
    assert sum(sizes.values()) == 60 and min(sizes.values()) >= 20
    similar = spark.createDataFrame([(0, 2, 0.9), (1, 2, 0.1)], "a int, b int, cosine double")
    assigned = spark.createDataFrame([(0,)] * 5 + [(1,)] * 6 + [(2,)] * 2, "topic int")
    assert {r.topic: r.merged for r in topics.without_small(assigned, similar, 3).collect()} == {0: 0, 1: 1, 2: 0}


def test_too_many_topics_are_refused(spark, monkeypatch):
    monkeypatch.setattr(topics, "MOST_TOPICS", 2)
    weights = spark.createDataFrame([(i, "t", 1.0) for i in range(3)], "topic int, term string, weight double")
    for merge in (topics.merged_topics, topics.topic_hierarchy):
        with pytest.raises(ValueError, match="topics"):
            merge(topics.topic_similarity(weights), weights.select("topic"))


def test_shared_windows_by_brute_force(spark):
    import random

    rng = random.Random(1)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, tokens array<string>")
    keywords = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "d"), (1, 2, "zz")], "topic int, rank int, term string")
    got = {r.topic: r.score for r in topics.coherence_cv(df, keywords, "doc_id", window=7).collect()}
    windows = [set(t[i:i + 7]) for t in texts if t for i in range(max(len(t) - 6, 1))]
    p = lambda *w: sum(all(x in s for x in w) for s in windows) / len(windows)
    npmi = lambda x, y: math.log((p(x, y) + 1e-12) / (p(x) * p(y))) / -math.log(p(x, y) + 1e-12)
    v = {x: [npmi(x, y) for y in "abc"] for x in "abc"}
    total = [sum(c) for c in zip(*v.values())]
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    assert got[0] == pytest.approx(sum(cosine(v[x], total) for x in "abc") / 3) and got[1] is None


def test_a_labeller_can_be_given(spark, corpus):
    tokens = model.tokenized(corpus, "doc_id")
    assigned = corpus.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("topic"))
    _, info = model.describe(assigned, tokens, "doc_id", lambda terms: terms.groupBy("topic").agg(F.lit("own").alias("name")))
    assert {r.name for r in info.collect()} == {"own"}


def test_n_grams_and_vocabulary(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a"]), (2, [])], "topic int, tokens array<string>")
    got = {r.topic: r.tokens for r in topics.n_grams(df).collect()}
    assert got[0] == ["a", "b", "c", "a b", "b c", "a b c"] and got[1] == ["a"] and got[2] == []
    kept = topics.vocabulary_filter(topics.term_counts(df), 2, 1.0)
    assert {r.term for r in kept.collect()} == {"a"}


def test_stream_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([("document_2019-01-01_A.pdf", 1, "word " * 12 + "\n\nshort"), ("b.pdf", 1, None)], "filename string, page_num int, text string")
    pages.withColumn("read_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = streaming.judged(streaming.page_stream(spark, str(tmp_path / "in")))
    query = streaming.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    assert {(r.year, r.skip_reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("2019", None), ("2019", "short_paragraph")}
    events = spark.readStream.schema("filename string, page_num int, text string, read_at timestamp").parquet(str(tmp_path / "in"))
    counts = streaming.windowed_counts(events, "read_at", "filename").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert counts.awaitTermination(120)
    assert {(r.filename, r.n) for r in spark.table("counts").collect()} == {("document_2019-01-01_A.pdf", 1), ("b.pdf", 1)}
