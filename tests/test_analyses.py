import math
import struct
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paraloom.operators import charts, groups, report, topics, trends, vectors


def counts(spark, rows):
    return spark.createDataFrame(rows, "topic int, period int, frequency int")


def grouped(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id int, topic int, grp string")


def test_difference_and_shift(spark):
    df = grouped(spark, [(1, "L"), (1, "L"), (2, "L"), (1, "R"), (3, "O"), (None, "R"), (2, None)])
    got = {r.topic: (r.L, r.R, r.difference) for r in groups.topic_difference(df, "L", "R").collect()}
    assert got == {1: pytest.approx((2 / 3, 1.0, 1 / 3)), 2: pytest.approx((1 / 3, 0.0, 1 / 3))}
    shift = {r.topic: r.attention_shift for r in groups.attention_shift(df, "L", "R").collect()}
    assert shift[3] == 0 and shift[1] == pytest.approx(1 / 3) and shift[2] == pytest.approx(-1 / 3)


def test_missing_group_and_empty_table(spark):
    df = grouped(spark, [(1, "L")])
    assert [(r.L, r.R) for r in groups.topic_difference(df, "L", "R").collect()] == [(1.0, 0.0)]
    empty = grouped(spark, [(1, "L")]).where("false")
    assert groups.topic_difference(empty, "L", "R").count() == 0
    assert groups.permutation_test_ranked(empty, "L", "R", 5).count() == 0
    assert trends.evolution(counts(spark, [(1, 1, 1)]).where("false")).count() == 0


def test_p_values(spark):
    df = grouped(spark, [(1, "L")] * 12 + [(2, "R")] * 12)
    a = {r.topic: r.p_value for r in groups.permutation_test_ranked(df, "L", "R", 50).collect()}
    b = {r.topic: r.p_value for r in groups.permutation_test_ranked(df, "L", "R", 50, "add_one").collect()}
    assert a == {1: 0.0, 2: 0.0} and b == pytest.approx({1: 1 / 51, 2: 1 / 51})
    c = {r.topic: r.p_value for r in groups.permutation_test(df, "L", "R", 50, "add_one").collect()}
    assert c == pytest.approx(b)


def test_both_permutation_plans_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(int(t), "L" if x < 0.4 else "R" if x < 0.8 else "O") for t, x in zip(rng.integers(0, 4, 400), rng.random(400))]
    df = grouped(spark, rows)
    a = {r.topic: r.p_value for r in groups.permutation_test_ranked(df, "L", "R", 200).collect()}
    b = {r.topic: r.p_value for r in groups.permutation_test(df, "L", "R", 2000).collect()}
    assert all(abs(a[t] - b[t]) < 0.13 for t in a)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1, y) for y in range(2016, 2024)], "topic int, year int")
    got = sorted(r.timestamp for r in trends.topics_over_time(df, "year", 20).collect())
    assert got == pytest.approx([2015.993, 2016.7, 2017.75, 2018.8, 2019.85, 2020.9, 2021.95, 2022.65], abs=1e-6)
    flat = spark.createDataFrame([(1, 2016), (2, 2016)], "topic int, year int")
    assert sum(r.frequency for r in trends.topics_over_time(flat, "year", 4).collect()) == 2


def test_normalisation_modes(spark):
    over = spark.createDataFrame([(1, 2016.7, 10), (1, 2015.993, 6)], "topic int, timestamp double, frequency bigint")
    yearly = spark.createDataFrame([(2016, 3), (2017, 5)], "year int, n bigint")
    calendar = {r.timestamp: r.share for r in trends.normalized_trend(over, yearly).collect()}
    left = {r.timestamp: r.share for r in trends.normalized_trend(over, yearly, "bin_left").collect()}
    assert calendar == pytest.approx({2016.7: 2.0, 2015.993: 2.0}) and left == pytest.approx({2016.7: 10 / 3, 2015.993: 6.0})


def test_gaps(spark):
    df = counts(spark, [(1, 1, 1), (1, 3, 5), (1, 4, 9), (2, 2, 7)])
    assert {r.topic: r.change for r in trends.evolution(df).collect()} == {1: 4.0, 2: 0.0}
    only = counts(spark, [(1, 1, 1), (1, 3, 5), (1, 4, 9), (2, 2, 0)])
    assert [r.volatility for r in trends.volatility(only).orderBy("period").collect()] == [0.0, 1.0, 5.0, 4.0]


def test_spike_limits(spark):
    six = counts(spark, [(1, i, 0) for i in range(5)] + [(1, 5, 5)])
    five = counts(spark, [(1, i, 0) for i in range(4)] + [(1, 4, 5)])
    assert [round(r.z, 4) for r in trends.focusing_events(six).collect()] == [2.0412]
    assert trends.focusing_events(five).count() == 0
    z = trends.z_scores(counts(spark, [(1, 1, 3), (1, 2, 3)])).orderBy("period").collect()
    assert z[0].z is None and z[1].z == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), min_size=1, max_size=40, unique=True), st.randoms())
def test_volatility_agrees_with_pandas_in_any_row_order(spark, cells, random):
    rows = [(t, p, (t * 7 + p * 3) % 5 + 1) for t, p in cells]
    frame = pd.DataFrame(rows, columns=["topic", "period", "frequency"]).pivot(index="period", columns="topic", values="frequency").fillna(0).sort_index()
    want = frame.diff().abs().sum(axis=1).tolist()
    random.shuffle(rows)
    assert [r.volatility for r in trends.volatility(counts(spark, rows)).orderBy("period").collect()] == want


def test_heatmap_averages_topics_of_one_name(spark):
    over = spark.createDataFrame([(1, 1.0, 4), (2, 1.0, 2), (3, 2.0, 9)], "topic int, timestamp double, frequency bigint")
    names = spark.createDataFrame([(1, "a"), (2, "a")], "topic int, name string")
    got = {(r.label, r.timestamp): r.frequency for r in trends.heatmap(over, names).collect()}
    assert got == {("a", 1.0): 3.0, ("a", 2.0): 0.0, ("Topic 3", 1.0): 0.0, ("Topic 3", 2.0): 9.0}


def test_ties_take_the_smaller_topic(spark):
    df = spark.createDataFrame([(7, 1.0), (5, 2.0), (3, 2.0), (1, 0.0)], "topic int, change double")
    assert [r.topic for r in trends.growing(df, 2).collect()] == [3, 5]
    assert len(groups.extremes(df, "change", 3).collect()) == 6


def test_similarity_identity(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(9, 5))
    v[3] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r], "L" if i < 5 else "R") for i, r in enumerate(v)] + [(99, None, "L")], "vec_id int, embedding array<float>, grp string")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.where(n > 0, v / np.where(n > 0, n, 1), 0)
    c = u @ u.T
    np.fill_diagonal(c, 0)
    row = vectors.similarity_summary(df, "L", "R").first()
    assert row.within_L == pytest.approx(c[:5, :5].mean(), abs=1e-6) and row.within_R == pytest.approx(c[5:, 5:].mean(), abs=1e-6)
    assert row.between == pytest.approx((u[:5] @ u[5:].T).mean(), abs=1e-6)
    assert vectors.similarity_summary(df.where("grp = 'L'"), "L", "R").count() == 0


def test_balanced_sample_is_repeatable(spark):
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 400, "L").otherwise("R").alias("grp"))
    a, b = ([r.vec_id for r in vectors.balanced_sample(df.repartition(n), "vec_id", ("L", "R"), 100).orderBy("vec_id").collect()] for n in (1, 7))
    assert a == b and sum(x < 400 for x in a) == 50 and len(a) == 100


def test_class_tf_idf_and_labels(spark):
    df = spark.createDataFrame([(0, ["net", "net", "bed"]), (1, ["bed", "pump"])], "topic int, tokens array<string>")
    weights = {(r.topic, r.term): r.weight for r in topics.class_tf_idf(topics.term_counts(df)).collect()}
    assert weights[0, "net"] == pytest.approx(2 / 3 * math.log(1 + 2.5 / 2))
    labels = {r.topic: r.name for r in topics.default_labels(topics.top_terms(topics.class_tf_idf(topics.term_counts(df)))).collect()}
    assert labels == {0: "0_net_bed", 1: "1_pump_bed"}


def test_umass_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "c"])], "doc_id int, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "a", 1.0), (0, 2, "b", 0.5), (1, 1, "a", 1.0)], "topic int, rank int, term string, weight double")
    pairs = topics.umass_pairs(docs, words, "doc_id")
    assert [r.score for r in pairs.collect()] == pytest.approx([math.log((1 / 3 + 1e-12) / (2 / 3))])
    scores = {r.topic: r.score for r in topics.coherence_umass(pairs, words).collect()}
    assert scores[1] is None and scores[0] == pytest.approx(math.log(0.5))
    filled = topics.coherence_umass(pairs, words, 0.01)
    assert {r.topic: r.score for r in filled.collect()}[1] == 0.01
    one = topics.coherence_statistics(filled.where("topic = 1")).first()
    assert one.std is None and one.mean == 0.01


def test_cv_against_numpy(spark):
    texts = [["a", "b", "x", "a"], ["b", "c"], ["x", "c", "a", "b", "y"], []]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, tokens array<string>")
    terms, window, eps = ["a", "b", "c"], 3, 1e-12
    words = spark.createDataFrame([(0, i + 1, t, 1.0) for i, t in enumerate(terms)], "topic int, rank int, term string, weight double")
    sets = [set(t[i:i + window]) for t in texts if t for i in range(max(1, len(t) - window + 1))]
    p = lambda *w: sum(all(x in s for x in w) for s in sets) / len(sets)
    m = np.array([[math.log((p(x, y) + eps) / (p(x) * p(y))) / -math.log(p(x, y) + eps) for y in terms] for x in terms])
    total = m.sum(0)
    want = np.mean([v @ total / np.linalg.norm(v) / np.linalg.norm(total) for v in m])
    assert topics.coherence_cv(docs, words, "doc_id", window).first().score == pytest.approx(want, abs=1e-9)


def test_merge_and_hierarchy(spark):
    weights = spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.9), (1, "b", 0.1), (2, "z", 1.0)], "topic int, term string, weight double")
    near = topics.topic_similarity(weights)
    assert {r.topic: r.merged for r in topics.merged_topics(near, weights, 0.9).collect()} == {0: 0, 1: 0, 2: 2}
    assert [(r.a, r.b) for r in topics.topic_hierarchy(near, weights).orderBy("step").collect()] == [(0, 1), (0, 2)]


def test_report_states_only_what_it_was_given(spark):
    assert report.summary() == "# Summary"
    spikes = spark.createDataFrame([(1, "2020-01", 5, 2.5)], "topic int, period string, frequency int, z double")
    assert "2.5000" in report.summary(spikes=spikes) and "Spikes" in report.summary(spikes=spikes)


def test_chart_file(spark, tmp_path):
    df = spark.createDataFrame([("a </b>", 1.0, "x"), ("c", -2.0, "y"), ("d", None, "y")], "label string, value double, kind string")
    for mark in ("bar", "line", "point", "cell"):
        charts.write_html(df, str(tmp_path / "c.html"), mark, "label", "value", "value" if mark == "cell" else "kind", title="A < B")
        page = (tmp_path / "c.html").read_text()
        drawing = page[page.index("<svg"):page.index("</svg>") + 6]
        root = ElementTree.fromstring(drawing)  # well-formed
        shapes = [e for e in root if e.tag.split("}")[1] in ("rect", "polyline", "circle")]
        assert len(shapes) == 2 and "A &lt; B" in page and "src=" not in page, mark
    charts.write_html(df.where("false"), str(tmp_path / "e.html"), "bar", "label", "value")
    with pytest.raises(ValueError, match="aggregate first"):
        charts.write_html(spark.range(charts.MOST_ROWS + 1).selectExpr("id", "id as value"), str(tmp_path / "m.html"), "bar", "id", "value")


def test_picture_of_bars(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "label string, value double")
    assert charts.write_png(df, str(tmp_path / "c.png"), "label", "value")
    data = (tmp_path / "c.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (charts.WIDTH, charts.HEIGHT)
    start = data.index(b"IDAT") + 4
    raw = zlib.decompress(data[start:])
    blue = [sum(raw[y * (3 * charts.WIDTH + 1) + 1 + 3 * x:][:3] == b"\x42\x69\xd0" for y in range(charts.HEIGHT)) for x in (200, 700)]
    assert 2.9 < blue[1] / blue[0] < 3.1  # heights as the values
    assert not charts.write_png(df.where("false"), str(tmp_path / "n.png"), "label", "value") and not (tmp_path / "n.png").exists()



def test_clashing_columns_do_not_break(spark):
    df = grouped(spark, [(1, "L"), (1, "R")]).withColumns({"n": F.lit(1), "n_left": F.lit(2), "difference": F.lit(3), "label": F.lit("x")})
    assert groups.topic_difference(df, "L", "R").first().difference == 0
