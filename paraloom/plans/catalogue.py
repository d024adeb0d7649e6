"""The named queries over the test tables, each with SQL that must agree with it.

``docs`` is every paragraph with a usable year and its topic; the panel is
lineitem by month and brand (83 months, so that a window of 60 has room); the
vectors are the table ``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.functions import language, periods, text
from paraloom.functions.stopwords import enhanced_stopwords
from paraloom.operators import charts, groups, model, quality, report, topics, trends, vectors
from paraloom.session import fresh_path, materialize
from paraloom.sources import pages
from paraloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
LEFT, RIGHT = "Trump", "Biden"
PARAGRAPHS = "processed_paragraphs_filtered"


# Bindings -------------------------------------------------------------------

def docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(doc_id, year, grp, topic, ...): paragraphs with a year; duplicate topic rows count once."""
    p = table(spark, d, PARAGRAPHS, "para_id", "year", *more).withColumn("year", text.parse_year(F.col("year"))).where("year is not null")
    t = table(spark, d, "paragraph_topics", "para_id", "topic").distinct()
    return p.join(t, "para_id").select(F.col("para_id").alias("doc_id"), "year", periods.period_label(F.col("year")).alias("grp"), "topic", *more)


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_info", "topic", "name")


def panel(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", "l_partkey", "l_shipdate")
    brands = table(spark, d, "part", "p_partkey", "p_brand")
    return lines.join(brands, lines.l_partkey == brands.p_partkey).select(
        F.expr("cast(regexp_extract(p_brand, '([0-9]+)', 1) as int)").alias("topic"), F.date_trunc("month", "l_shipdate").cast("date").alias("period"))


def panel_counts(spark: SparkSession, d: str) -> DataFrame:
    return trends.topic_period_counts(panel(spark, d))


def gappy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Months in which a brand sold under a limit are gaps."""
    return panel_counts(spark, d).where("frequency % 3 <> 0")


def year_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def grouped_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("grp", F.when(F.col("label") < 5, LEFT).otherwise(RIGHT))


def topic_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d, "text").where(F.col("text").isNotNull()).select("doc_id", "topic", "year", text.letter_tokens(F.col("text")).alias("tokens"))
    return topics.without_stopwords(rows, enhanced_stopwords())


def dated(df: DataFrame) -> DataFrame:
    """Dates as text, which every engine shows alike."""
    return df.withColumn("period", F.col("period").cast("string"))


# Queries --------------------------------------------------------------------

def _paragraph_rules(spark: SparkSession, d: str, language="lang", unicode: bool = True) -> DataFrame:
    source = table(spark, d, "documents", "doc_id", "text", "lang")
    return quality.with_reason(quality.paragraphs(source, unicode=unicode), language, unicode=unicode)


def _valid(language="lang", unicode: bool = True) -> Query:
    return lambda s, d: _paragraph_rules(s, d, language, unicode).where("skip_reason is null").select(
        "doc_id", F.col("para_idx").cast("bigint").alias("para_idx"), "paragraph")


def _cleaned(cleaner, unicode: bool) -> Query:
    return lambda s, d: table(s, d, PARAGRAPHS, "para_id", "text").select("para_id", cleaner(F.col("text"), unicode=unicode).alias("cleaned"))


def _corpus(s, d):
    """The paragraph table written as the corpus CSV and loaded again, cleaned."""
    rows = table(s, d, PARAGRAPHS, "filename", "year", "text").withColumn("skip_reason", F.lit(None).cast("string"))
    path = fresh_path(s, "corpus-csv")
    pages.write_corpus(rows, path)
    return pages.load_corpus(s, path)


def _null_model(pvalue: str) -> Query:
    return lambda s, d: groups.permutation_test_ranked(docs(s, d), LEFT, RIGHT, 50, pvalue).select(
        "topic", *[F.round(c, 9).alias(c.lower()) for c in (LEFT, RIGHT, "abs_difference", "p_value")], "significant")


def _over_time(bins) -> Query:
    return lambda s, d: trends.topics_over_time(docs(s, d), "year", bins).select("topic", F.round("timestamp", 6).alias("timestamp"), "frequency")


def _normalized(mode: str) -> Query:
    def query(s, d):
        over = trends.topics_over_time(docs(s, d), "year", 20)
        return trends.normalized_trend(over, year_counts(s, d), mode).select(
            "topic", F.round("timestamp", 6).alias("timestamp"), "frequency", F.round("share", 9).alias("share"))
    return query


def _difference(s, d):
    labelled = groups.labels(groups.topic_difference(docs(s, d), LEFT, RIGHT), names(s, d))
    return labelled.select("topic", F.round(LEFT, 9).alias("trump"), F.round(RIGHT, 9).alias("biden"), "label", F.round("difference", 9).alias("difference"))


def _shift(s, d):
    labelled = groups.labels(groups.attention_shift(docs(s, d), LEFT, RIGHT), names(s, d))
    return labelled.select("topic", F.round(LEFT, 9).alias("trump"), F.round(RIGHT, 9).alias("biden"), F.round("attention_shift", 9).alias("attention_shift"), "label")


def _keywords(s, d, n=10):
    return topics.top_terms(topics.class_tf_idf(topics.term_counts(topic_tokens(s, d))), n)


def _words_of_topics(s, d):
    """(tokens, keywords); the keywords are few, read several times by the coherence measures, and so set down once."""
    tokens = topic_tokens(s, d)
    return tokens, materialize(topics.top_terms(topics.class_tf_idf(topics.term_counts(tokens)), 10), "keywords")


def _umass(s, d):
    return topics.umass_pairs(*_words_of_topics(s, d), "doc_id")


def _umass_scores(s, d, fallback=None, first=None):
    """``first``: the measure over so many documents only, the first by id, as the measure may be stated."""
    tokens, words = _words_of_topics(s, d)
    if first is not None:
        tokens = topics.first_documents(tokens, "doc_id", first)
    return topics.coherence_umass(topics.umass_pairs(tokens, words, "doc_id"), words, fallback)


def _seed_affinity(s, d):
    v = table(s, d, "embeddings")
    seeds = vectors.centroids(v, "label").withColumnRenamed("label", "seed_id")
    return vectors.seed_affinity(v, seeds, "vec_id").select("vec_id", "seed", F.round("cosine", 6).alias("cosine"))


def _page_table(s, d):
    """Files of the paragraph table stood up as page texts, read back by the page reader."""
    p = table(s, d, PARAGRAPHS, "filename", "page_num", "text").where("text is not null")
    per_page = p.groupBy("filename", "page_num").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n\n").alias("text"))
    return pages.page_paragraphs(per_page, language.detect_language)


def _page_files(s, d):
    """Files of the paragraph table written as page files, a form feed between pages, and scanned, read and judged again."""
    p = table(s, d, PARAGRAPHS, "filename", "page_num", "text").where("text is not null").withColumn("text", F.translate("text", "\f", " "))
    per_page = p.groupBy("filename", "page_num").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n\n").alias("text"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"])
    files = per_page.groupBy("filename").agg(F.array_join(in_order, "\f").alias("value"))
    path = fresh_path(s, "page-files")
    files.repartition("filename").write.partitionBy("filename").text(path)
    read = pages.read_pages(s, f"{path}/*", pattern="*.txt").withColumn("filename", F.regexp_extract("path", "filename=([^/]+)/", 1))
    found = pages.page_paragraphs(read, language.detect_language)
    return found.groupBy("filename", "page_num").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.col("skip_reason").isNull()).alias("kept"))


def _corpus_stats(s, d):
    return docs(s, d).agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                          F.count_if(F.col("grp") == LEFT).alias("trump"), F.count_if(F.col("grp") == RIGHT).alias("biden"))


def _words_over_time(s, d):
    return topics.topic_words_over_time(topic_tokens(s, d).withColumnRenamed("year", "period"))


def _merged(s, d):
    weights = topics.class_tf_idf(topics.term_counts(topic_tokens(s, d)))
    return topics.merged_topics(topics.topic_similarity(weights), weights.select("topic"), 0.9)


def _hierarchy(s, d):
    weights = topics.class_tf_idf(topics.term_counts(topic_tokens(s, d)))
    return topics.topic_hierarchy(topics.topic_similarity(weights), weights.select("topic")).withColumn("distance", F.round("distance", 9))


def _ngram_vocabulary(s, d):
    grams = topics.n_grams(topic_tokens(s, d))
    return topics.vocabulary_filter(topics.term_counts(grams), 5, 0.95)


def _over_time_lines(s, d):
    """The rows of the ten most frequent topics with their names, a line each."""
    rows = charts.top_lines(trends.topics_over_time(docs(s, d), "year", 20), 10)
    return groups.labels(rows, names(s, d)).select("topic", "label", F.round("timestamp", 6).alias("timestamp"), "frequency")


def _over_time_years(s, d):
    """Topics by year, each year as the timestamp of its start and as what is read off that."""
    rows = docs(s, d).withColumn("stamp", periods.year_start(F.col("year")))
    return rows.where("topic is not null").groupBy("topic", F.col("stamp").cast("string").alias("stamp"), periods.timestamp_year(F.col("stamp"), "timestamp_ntz").alias("year")).agg(
        F.count(F.lit(1)).alias("frequency"))


def _significant(s, d):
    """The bars of the significant topics, with short labels."""
    tested = groups.labels(groups.permutation_test_ranked(docs(s, d), LEFT, RIGHT, 50), names(s, d)).where("p_value <= 0.5")
    return tested.select(text.short_label(F.col("topic"), F.col("label"), 20).alias("bar"), F.round("abs_difference", 9).alias("abs_difference"), "significant")


def _topic_terms_chart(s, d):
    weights = topics.class_tf_idf(topics.term_counts(topic_tokens(s, d)))
    largest = docs(s, d).where("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(15)
    return topics.top_terms(weights, 10).join(largest.select("topic"), "topic", "left_semi").select("topic", "rank", "term", F.round("weight", 9).alias("weight"))


def _topic_map(s, d):
    """Every topic's place and size: principal components of the centroids of its documents' vectors."""
    v = table(s, d, "embeddings")
    centres = vectors.centroids(v, "label").withColumnRenamed("centroid", "embedding")
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return vectors.project(centres, "label", 2).join(sizes, "label")


def _attention_pivot(s, d):
    counts = docs(s, d).where("topic is not null").groupBy("topic", "grp").agg(F.count(F.lit(1)).alias("n"))
    return trends.pivoted(counts, "topic", "grp", "n", [LEFT, RIGHT, "Other"]).toDF("topic", "trump", "biden", "other")


def _topic_model(s, d):
    """The whole model over all documents: hashed embedding, seeds, projection, clusters, terms and names."""
    fitted = model.fit(table(s, d, "documents", "doc_id", "text"), "doc_id", k=20, seeds=table(s, d, "seed_topics"))
    return fitted.topic_info


def _assigned(s, d):
    """A model of the documents gives the paragraphs, which it has not seen, their topics."""
    fitted = model.fit(table(s, d, "documents", "doc_id", "text"), "doc_id", k=20, seeds=table(s, d, "seed_topics"), min_topic_size=10)
    found = fitted.transform(table(s, d, PARAGRAPHS, F.col("para_id").alias("doc_id"), "text"))
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"))


def _guided(s, d):
    v = table(s, d, "embeddings")
    seeds = vectors.centroids(v, "label").withColumnRenamed("label", "seed_id")
    pulled = vectors.guided(v, vectors.seed_affinity(v, seeds, "vec_id"), seeds, "vec_id", floor=0.2)
    return pulled.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def _report(s, d):
    coherence = topics.coherence_cv(*_words_of_topics(s, d), "doc_id").withColumn("score", F.round("score", 6))
    return report.summary(
        significance=groups.permutation_test_ranked(docs(s, d), LEFT, RIGHT, 50), coherence=coherence,
        shift=_difference(s, d), similarity=_similarity_round(vectors.similarity_summary(grouped_vectors(s, d), LEFT, RIGHT)),
        spikes=trends.focusing_events(panel_counts(s, d)), volatility=trends.volatility(panel_counts(s, d)))


def _similarity_round(df):
    return df.select(*[F.round(c, 9).alias(c.lower()) if kind == "double" else F.col(c).alias(c.lower()) for c, kind in df.dtypes])


def queries() -> dict[str, Query]:
    return {
        "para_valid": _valid(),
        "para_valid_ascii": _valid(unicode=False),
        "para_valid_detected": _valid(language.detect_language),
        "para_languages": lambda s, d: table(s, d, "documents", "doc_id", "text").select("doc_id", language.detect_language(F.col("text")).alias("language")),
        "para_skip_counts": lambda s, d: quality.skip_counts(_paragraph_rules(s, d)),
        "corpus_clean": _cleaned(text.corpus_clean, True),
        "corpus_clean_ascii": _cleaned(text.corpus_clean, False),
        "ocr_clean": _cleaned(text.ocr_clean, True),
        "ocr_clean_ascii": _cleaned(text.ocr_clean, False),
        "corpus_load": lambda s, d: _corpus(s, d).select("filename", "year", "administration", F.col("text").alias("cleaned")),
        "corpus_yearly": lambda s, d: pages.yearly_paragraphs(_corpus(s, d)),
        "word_tokens": lambda s, d: table(s, d, PARAGRAPHS, "para_id", "text").select("para_id", F.array_join(text.letter_tokens(F.col("text")), " ").alias("tokens")),
        "label_words": lambda s, d: names(s, d).select("topic", F.array_join(text.label_words(F.col("name")), "|").alias("words")),
        "stop_words": lambda s, d: s.createDataFrame([(w,) for w in enhanced_stopwords()], "word string"),
        "year_from_filename": lambda s, d: table(s, d, "source_files", "filename").distinct().select("filename", text.year_from_filename(F.col("filename")).alias("year")),
        "period_label": lambda s, d: groups.value_counts(docs(s, d), "grp"),
        "period_share": lambda s, d: groups.value_counts(docs(s, d), "grp", normalize=True).select("grp", F.round("share", 9).alias("share")),
        "yearly_counts": lambda s, d: year_counts(s, d).select("year", F.col("n").alias("num_paragraphs")).orderBy("year"),
        "corpus_stats": _corpus_stats,
        "group_topic_diff": _difference,
        "group_topic_diff_top": lambda s, d: _difference(s, d).orderBy(F.desc("difference"), "topic").limit(15),
        "attention_shift": _shift,
        "attention_extremes": lambda s, d: groups.extremes(_shift(s, d), "attention_shift", 5),
        "null_model_empirical": _null_model("empirical"),
        "null_model_add_one": _null_model("add_one"),
        "null_model_by_counts": lambda s, d: groups.permutation_test(docs(s, d), LEFT, RIGHT, 200, "add_one"),
        "topics_over_time_20": _over_time(20),
        "topics_over_time_yearly": _over_time("yearly"),
        "topics_over_time_quarterly": _over_time("quarterly"),
        "topic_words_over_time": _words_over_time,
        "trend_normalized_calendar": _normalized("calendar"),
        "trend_normalized_bin_left": _normalized("bin_left"),
        "heatmap_top15": lambda s, d: trends.heatmap(trends.topic_period_counts(docs(s, d), period="year"), names(s, d), 15, "period"),
        "evolution_up": lambda s, d: trends.growing(trends.evolution(gappy_counts(s, d))),
        "evolution_down": lambda s, d: trends.shrinking(trends.evolution(gappy_counts(s, d))),
        "evolution_all": lambda s, d: trends.evolution(panel_counts(s, d)),
        "volatility": lambda s, d: dated(trends.volatility(panel_counts(s, d))),
        "volatility_gappy": lambda s, d: dated(trends.volatility(gappy_counts(s, d))),
        "volatility_events": lambda s, d: dated(trends.volatility(trends.topic_period_counts(
            table(s, d, "events", "event_type", "ts").select(F.col("event_type").alias("topic"), F.to_date("ts").alias("period"))))),
        "focusing_events": lambda s, d: dated(trends.focusing_events(panel_counts(s, d))).withColumn("z", F.round("z", 6)),
        "focusing_events_months": lambda s, d: dated(trends.focusing_events(trends.topic_period_counts(
            docs(s, d, "ingested_at").withColumn("period", periods.month_end(F.col("ingested_at")))))).withColumn("z", F.round("z", 6)),
        "similarity_summary": lambda s, d: _similarity_round(vectors.similarity_summary(grouped_vectors(s, d), LEFT, RIGHT)),
        "similarity_pairs": lambda s, d: _similarity_round(vectors.similarity_summary(grouped_vectors(s, d), LEFT, RIGHT, diagonal="pairs")),
        "balanced_sample": lambda s, d: vectors.balanced_sample(grouped_vectors(s, d), "vec_id", (LEFT, RIGHT), 200).select("vec_id", "grp"),
        "seed_affinity": _seed_affinity,
        "seed_terms": lambda s, d: table(s, d, "seed_topics").select("seed_id", F.explode("terms").alias("term")),
        "guided_vectors": _guided,
        "ctfidf_terms": lambda s, d: _keywords(s, d, 4).select("topic", "rank", "term", F.round("weight", 9).alias("weight")),
        "topic_labels": lambda s, d: topics.default_labels(_keywords(s, d, 4)),
        "ngram_vocabulary": _ngram_vocabulary,
        "coherence_umass": lambda s, d: _umass_scores(s, d).select("topic", "measure", F.round("score", 6).alias("score")),
        "coherence_pairs": lambda s, d: _umass(s, d).select("topic", "term_i", "term_j", F.round("score", 6).alias("score")),
        "coherence_umass_first": lambda s, d: _umass_scores(s, d, first=5_000).select("topic", "measure", F.round("score", 6).alias("score")),
        "coherence_cv": lambda s, d: topics.coherence_cv(*_words_of_topics(s, d), "doc_id").select("topic", "measure", F.round("score", 6).alias("score")),
        "coherence_stats": lambda s, d: topics.coherence_statistics(_umass_scores(s, d, 0.01)).select(
            "measure", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")]),
        "topic_merge": _merged,
        "topic_hierarchy": _hierarchy,
        "topic_model": _topic_model,
        "topic_assign": _assigned,
        "chart_over_time": _over_time_lines,
        "topics_by_year": _over_time_years,
        "kmeans_topics": lambda s, d: vectors.cluster(table(s, d, "embeddings"), "vec_id", 10),
        "pca_projection": lambda s, d: vectors.project(grouped_vectors(s, d), "vec_id", 2),
        "page_paragraphs": _page_table,
        "page_files": _page_files,
        "attention_pivot": _attention_pivot,
        "spikes_top15": lambda s, d: dated(trends.focusing_events(panel_counts(s, d)).withColumn("z", F.round("z", 6)).orderBy(F.desc("z"), "topic", "period").limit(15)),
        "chart_significant": _significant,
        "chart_topic_terms": _topic_terms_chart,
        "chart_topic_map": _topic_map,
        "chart_topic_shift": lambda s, d: charts.grouped_bars(_difference(s, d), "label", ("trump", "biden"), "difference", 15),
        "chart_similarity": lambda s, d: charts.unpivoted(_similarity_round(vectors.similarity_summary(grouped_vectors(s, d), LEFT, RIGHT)), ("within_trump", "within_biden", "between")),
        "chart_volatility": lambda s, d: dated(charts.with_markers(trends.volatility(panel_counts(s, d)), "period", ("1997-01-20", "2001-01-20"))),
        "summary_report": lambda s, d: s.createDataFrame(list(enumerate(_report(s, d).split("\n"))), "line_no int, line string"),
    }


# SQL ------------------------------------------------------------------------

_YEAR = """y AS (SELECT para_id, text, ingested_at, TRY_CAST(trim(year) AS DOUBLE) AS yd FROM processed_paragraphs_filtered),
docs AS (SELECT para_id AS doc_id, CAST(yd AS INT) AS year, topic, text, ingested_at,
  CASE WHEN yd >= 2021 THEN 'Biden' WHEN yd >= 2017 THEN 'Trump' ELSE 'Other' END AS grp
  FROM y JOIN (SELECT DISTINCT para_id, topic FROM paragraph_topics) USING (para_id) WHERE yd IS NOT NULL AND yd = floor(yd))"""
_SHARES = _YEAR + """,
g AS (SELECT topic, count(*) FILTER (grp = 'Trump') AS n_l, count(*) FILTER (grp = 'Biden') AS n_r, count(*) AS n FROM docs WHERE topic IS NOT NULL GROUP BY topic),
s AS (SELECT topic, n_l, n_r, n_l / (SELECT sum(n_l) FROM g)::DOUBLE AS trump, n_r / (SELECT sum(n_r) FROM g)::DOUBLE AS biden FROM g)"""
_LABEL = "coalesce(name, 'Topic ' || s.topic) AS label"
_DIFF = "WITH " + _SHARES + f""",
diff AS (SELECT s.topic, round(trump, 9) AS trump, round(biden, 9) AS biden, {_LABEL}, round(abs(trump - biden), 9) AS difference
  FROM s LEFT JOIN topic_info USING (topic) WHERE n_l + n_r > 0)"""
_SHIFT = "WITH " + _SHARES + f""",
shift AS (SELECT s.topic, round(trump, 9) AS trump, round(biden, 9) AS biden, round(biden - trump, 9) AS attention_shift, {_LABEL}
  FROM s LEFT JOIN topic_info USING (topic))"""
_PANEL = """panel AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS topic, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, count(*) AS frequency
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
gappy AS (SELECT * FROM panel WHERE frequency % 3 <> 0)"""


def _null_sql(p: str) -> str:
    return "WITH " + _SHARES + f""",
n AS (SELECT CAST(sum(n_l) AS BIGINT) AS nl, CAST(sum(n_r) AS BIGINT) AS nr FROM g),
r AS (SELECT p, topic, row_number() OVER (PARTITION BY p ORDER BY md5(p || '|' || doc_id), doc_id) AS rn FROM docs, range(50) t(p) WHERE topic IS NOT NULL),
c AS (SELECT p, topic, count(*) FILTER (rn <= nl) AS cl, count(*) FILTER (rn > nl AND rn <= nl + nr) AS cr FROM r, n GROUP BY p, topic),
d AS (SELECT p, topic, abs(cl / nl::DOUBLE - cr / nr::DOUBLE) AS nd FROM c, n),
o AS (SELECT topic, trump, biden, abs(trump - biden) AS ad FROM s WHERE n_l + n_r > 0),
h AS (SELECT o.topic, trump, biden, ad, count(*) FILTER (coalesce(nd, 0) >= ad) AS hits FROM o CROSS JOIN range(50) t(p) LEFT JOIN d ON d.topic = o.topic AND d.p = t.p GROUP BY ALL)
SELECT topic, round(trump, 9) AS trump, round(biden, 9) AS biden, round(ad, 9) AS abs_difference, round({p}, 9) AS p_value, {p} < 0.05 AS significant FROM h"""


def _bins_sql(bins: str, rest: str = "") -> str:
    return "WITH " + _YEAR + f""",
span AS (SELECT min(year)::DOUBLE AS lo, max(year)::DOUBLE AS hi FROM docs WHERE topic IS NOT NULL),
size AS (SELECT lo, hi, CAST({bins} AS INT) AS n FROM span),
edges AS (SELECT lo - (hi - lo) * 0.001::DOUBLE AS e FROM size UNION ALL SELECT lo + (hi - lo) * i / n FROM size, range(1, 1000) t(i) WHERE i <= n),
over_time AS (SELECT topic, (SELECT max(e) FROM edges WHERE e < year) AS ts, count(*) AS frequency FROM docs WHERE topic IS NOT NULL GROUP BY 1, 2)
""" + (rest or "SELECT topic, round(ts, 6) AS timestamp, frequency FROM over_time")


def _trend_sql(year: str) -> str:
    return _bins_sql("20", f""", years AS (SELECT year, count(*) AS n FROM docs GROUP BY year)
SELECT topic, round(ts, 6) AS timestamp, frequency, round(frequency / coalesce(n, 1)::DOUBLE, 9) AS share
FROM over_time LEFT JOIN years ON years.year = CAST({year} AS INT)""")


def _full(counts: str, fill: str) -> str:
    return f"""f AS (SELECT t.topic, p.period, {fill} AS frequency FROM (SELECT DISTINCT topic FROM {counts}) t CROSS JOIN (SELECT DISTINCT period FROM {counts}) p
  LEFT JOIN {counts} c ON c.topic = t.topic AND c.period = p.period),
l AS (SELECT *, frequency - lag(frequency) OVER (PARTITION BY topic ORDER BY period) AS change FROM f)"""


_EVOLUTION = "SELECT topic, coalesce(sum(change), 0)::DOUBLE AS change FROM l GROUP BY topic"
_VOLATILITY = "SELECT CAST(period AS VARCHAR) AS period, coalesce(sum(abs(change)), 0)::DOUBLE AS volatility FROM l GROUP BY period"
_Z = """, z AS (SELECT topic, period, frequency, avg(frequency) OVER w AS m, stddev_samp(frequency) OVER w AS sd FROM f
  WINDOW w AS (PARTITION BY topic ORDER BY period ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
zz AS (SELECT topic, period, frequency, (frequency - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM z)
SELECT topic, CAST(period AS VARCHAR) AS period, frequency, round(z, 6) AS z FROM zz WHERE z > 2"""
_MONTHS = "WITH " + _YEAR + """, m AS (SELECT topic, last_day(CAST(ingested_at AS DATE)) AS period, count(*) AS frequency FROM docs
  WHERE topic IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1, 2), """


def _similarity_sql(within: str) -> str:
    pairs = {"n2": "n * n", "pairs": "n * (n - 1)"}[within]
    return f"""WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT g, unnest(e) AS x, generate_subscripts(e, 1) AS i, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS nn FROM v),
s AS (SELECT g, i, sum(CASE WHEN nn > 0 THEN x / nn ELSE 0 END) AS t FROM u GROUP BY g, i),
n AS (SELECT g, count(*) AS n, count(*) FILTER (list_sum(list_transform(e, lambda y: y * y)) > 0) AS filled FROM v GROUP BY g),
w AS (SELECT s.g, (sum(t * t) - any_value(filled)) / any_value({pairs}) AS within, any_value(n) AS n FROM s JOIN n USING (g) GROUP BY s.g),
b AS (SELECT sum(x.t * y.t) AS ab FROM s x JOIN s y ON x.i = y.i AND x.g = 'a' AND y.g = 'b')
SELECT round(wa.within, 9) AS within_trump, round(wb.within, 9) AS within_biden, round(ab / (wa.n * wb.n), 9) AS between,
  wa.n AS trump_documents, wb.n AS biden_documents FROM w wa, w wb, b WHERE wa.g = 'a' AND wb.g = 'b'"""


# written out once more, so that it does not follow the list of the code
_STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain "
    "aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn "
    "prepared publication suggested citation isbn report washington dc agreement review official views positions contents executive summary background overview "
    "methodology appendix annex page section chapter paragraph figure table reference bibliography footnote note volume https www "
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec month monthly quarter quarterly "
    "annual annually year years fiscal fy 2016 2017 2018 2019 2020 2021 2022 2023 fy17 fy18 pennsylvania_ave de la les en des et le de_la du para dan pa za ke ali tes "
    "primer wa ts ee tr ea ti te ie io ro sb fn aa uo ye na_na_na na na_na tbd 90_90 600 200 85 90 total number percent frequency details questionnaire respondents "
    "procedure guidelines outreach budget procurement cooperative implemented").split()
# a word is a chunk between other signs; joined words are none; an ending in an apostrophe is parted
_WORDS_SQL = r"""list_transform(list_filter(flatten(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_./''’-]+'),
  lambda c: regexp_split_to_array(c, '^[-./''’]+|[-./''’]{2,}|[-./''’]+$'))),
  lambda w: regexp_full_match(w, '\p{L}{3,}([''’](s|re|ve|ll|d|m))?')), lambda w: regexp_replace(w, '[''’].*', ''))"""


def _tokens_sql() -> str:
    stop = ", ".join(f"'{w.replace('_', ' ')}'" for w in _STOP)
    return "WITH " + _YEAR + f""",
tok AS (SELECT doc_id, topic, year, list_filter({_WORDS_SQL}, lambda w: NOT list_contains([{stop}], w)) AS tokens FROM docs WHERE text IS NOT NULL),
tc AS (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest(tokens) AS term FROM tok WHERE topic IS NOT NULL) GROUP BY 1, 2),
tw AS (SELECT topic, sum(tf) AS words FROM tc GROUP BY topic),
tt AS (SELECT term, sum(tf) AS total FROM tc GROUP BY term),
wt AS (SELECT topic, term, tf / words::DOUBLE * ln(1 + (SELECT avg(words) FROM tw) / total::DOUBLE) AS weight FROM tc JOIN tw USING (topic) JOIN tt USING (term)),
rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM wt)"""


_PAIRS = """,
kw AS (SELECT topic, term, rank FROM rk WHERE rank <= 10),
base AS (SELECT * FROM tok WHERE {SOME}),
dt AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(tokens) AS term FROM base) WHERE term IN (SELECT term FROM kw)),
dc AS (SELECT term, count(*) AS d FROM dt GROUP BY term),
bc AS (SELECT x.term AS a, y.term AS b, count(*) AS d FROM dt x JOIN dt y USING (doc_id) GROUP BY 1, 2),
up AS (SELECT i.topic, i.term AS term_i, j.term AS term_j, ln((coalesce(bc.d, 0) / (SELECT count(*) FROM base)::DOUBLE + 1e-12) / (dc.d / (SELECT count(*) FROM base)::DOUBLE)) AS score
  FROM kw i JOIN kw j ON i.topic = j.topic AND i.rank > j.rank JOIN dc ON dc.term = j.term JOIN dc di ON di.term = i.term LEFT JOIN bc ON bc.a = i.term AND bc.b = j.term),
um AS (SELECT topic, 'u_mass' AS measure, avg(score) AS score FROM kw LEFT JOIN up USING (topic) GROUP BY topic)
"""
_CV = """,
kw AS (SELECT topic, term FROM rk WHERE rank <= 10),
placed AS (SELECT doc_id, tokens, unnest(range(greatest(len(tokens) - 109, 1))) AS w FROM tok WHERE len(tokens) > 0),
held AS (SELECT doc_id, w, list_distinct(list_intersect(tokens[w + 1:w + 110], (SELECT list(DISTINCT term) FROM kw))) AS terms FROM placed),
one AS (SELECT term, count(*) AS c FROM (SELECT unnest(terms) AS term FROM held) GROUP BY term),
each AS (SELECT terms, unnest(terms) AS a FROM held),
two AS (SELECT a, b, count(*) AS c FROM (SELECT a, unnest(terms) AS b FROM each) GROUP BY a, b),
n AS (SELECT count(*)::DOUBLE AS n FROM placed),
v AS (SELECT i.topic, i.term AS a, j.term AS b, coalesce(two.c, 0) / n AS p, x.c / n AS pa, y.c / n AS pb
  FROM kw i JOIN kw j ON i.topic = j.topic JOIN one x ON x.term = i.term JOIN one y ON y.term = j.term LEFT JOIN two ON two.a = i.term AND two.b = j.term, n),
m AS (SELECT topic, a, b, ln((p + 1e-12) / (pa * pb)) / -ln(p + 1e-12) AS v FROM v),
t AS (SELECT topic, b, sum(v) AS t FROM m GROUP BY topic, b),
c AS (SELECT topic, a, sum(v * t) / nullif(sqrt(sum(v * v)) * sqrt(sum(t * t)), 0) AS cosine FROM m JOIN t USING (topic, b) GROUP BY topic, a)
SELECT topic, 'c_v' AS measure, round(CASE WHEN count(a) >= 2 THEN avg(cosine) END, 6) AS score FROM (SELECT DISTINCT topic FROM kw) LEFT JOIN c USING (topic) GROUP BY topic"""
_WORDS_OVER_TIME = """,
cell AS (SELECT topic, year AS period, term, count(*) AS tf FROM (SELECT topic, year, unnest(tokens) AS term FROM tok WHERE topic IS NOT NULL) GROUP BY 1, 2, 3),
cw AS (SELECT topic, period, sum(tf) AS words FROM cell GROUP BY 1, 2),
ct AS (SELECT term, sum(tf) AS total FROM cell GROUP BY term),
lw AS (SELECT topic, period, term, (tf / words::DOUBLE * ln(1 + (SELECT avg(words) FROM cw) / total::DOUBLE) + weight) / 2 AS w
  FROM cell JOIN cw USING (topic, period) JOIN ct USING (term) JOIN wt USING (topic, term)),
ev AS (SELECT topic, period, term, coalesce((w + lag(w) OVER (PARTITION BY topic, term ORDER BY period)) / 2, w) AS w FROM lw),
br AS (SELECT *, row_number() OVER (PARTITION BY topic, period ORDER BY round(w, 12) DESC, term) AS r FROM ev)
SELECT topic, period, string_agg(term, ', ' ORDER BY r) AS words FROM br WHERE r <= 5 GROUP BY topic, period"""
_NGRAMS = """,
g AS (SELECT topic, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]),
  list_transform(range(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2]))) AS term FROM tok WHERE topic IS NOT NULL),
gc AS (SELECT topic, term, count(*) AS tf FROM g GROUP BY 1, 2),
keep AS (SELECT term FROM gc GROUP BY term HAVING count(*) >= 5 AND count(*) <= (SELECT count(DISTINCT topic) FROM gc) * 0.95::DOUBLE)
SELECT topic, term, tf FROM gc JOIN keep USING (term)"""
_MERGE = """,
nm AS (SELECT topic, sqrt(sum(weight * weight)) AS n FROM wt GROUP BY topic),
sc AS (SELECT topic, term, weight / n AS w FROM wt JOIN nm USING (topic) WHERE n > 0),
cs AS (SELECT a.topic AS a, b.topic AS b, sum(a.w * b.w) AS cosine FROM sc a JOIN sc b ON a.term = b.term AND a.topic <> b.topic GROUP BY 1, 2),
reach(topic, other) AS (SELECT DISTINCT topic, topic FROM wt UNION SELECT r.topic, cs.b FROM reach r JOIN cs ON cs.a = r.other AND cosine > {LIMIT})
SELECT topic, min(other) AS merged FROM reach GROUP BY topic"""


# a pair of topics is a step if the nearer pairs before it do not connect them; groups go by their smallest topic
_HIERARCHY = """,
nm AS (SELECT topic, sqrt(sum(weight * weight)) AS n FROM wt GROUP BY topic),
sc AS (SELECT topic, term, weight / n AS w FROM wt JOIN nm USING (topic) WHERE n > 0),
cs AS (SELECT a.topic AS a, b.topic AS b, sum(a.w * b.w) AS cosine FROM sc a JOIN sc b ON a.term = b.term AND a.topic < b.topic GROUP BY 1, 2),
pr AS (SELECT x.topic AS a, y.topic AS b, 1 - coalesce(cosine, 0) AS d FROM nm x JOIN nm y ON x.topic < y.topic LEFT JOIN cs ON cs.a = x.topic AND cs.b = y.topic),
od AS (SELECT *, row_number() OVER (ORDER BY d, a, b) AS k FROM pr),
reach(k, x, y) AS (SELECT k, topic, topic FROM od, nm UNION SELECT r.k, r.x, CASE WHEN e.a = r.y THEN e.b ELSE e.a END FROM reach r JOIN od e ON e.k < r.k AND (e.a = r.y OR e.b = r.y)),
root AS (SELECT k, x, min(y) AS root FROM reach GROUP BY k, x),
st AS (SELECT od.k, d, p.root AS ra, q.root AS rb FROM od JOIN root p ON p.k = od.k AND p.x = a JOIN root q ON q.k = od.k AND q.x = b WHERE p.root <> q.root)
SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS step, least(ra, rb) AS a, greatest(ra, rb) AS b, round(d, 9) AS distance FROM st"""


# the classes of the two modes, written out: white space, digits, word characters
_UNICODE = (r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"\p{Nd}", r"\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}")
_ASCII = (r"[ \t\r\n]", "[0-9]", "A-Za-z0-9_")
_WEB = r"http[s]?://(?:[a-zA-Z0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"


def _replaced(column: str, steps: list[tuple[str, str]], space: str) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({column}, '{space}+', ' ', 'g'))"


def _corpus_clean_sql(classes: tuple[str, str, str]) -> str:
    s, d, _ = classes
    steps = ["ISBN-: ----", "AID-OAA-A--", rf"{s}{{2,}}", r"\.{3,}", r"\([^)]*\)", rf"{d}+\.{d}+\.{d}+", rf"^{s}*{d}+\.", f"Figure {d}+", f"Table {d}+"]
    return _replaced("text", [(p, " ") for p in steps], s)


def _ocr_clean_sql(classes: tuple[str, str, str], word: str) -> str:
    """Word boundaries are spelt out: the sign before stays, and so does the one after; twice, as neighbours share it."""
    s, d, w = classes
    numbers = rf"(^|[^{word}])(?:{d}+(?:{s}*\|{s}*{d}+)+|{d}+($|[^{word}]))"
    column = "text"
    for pattern, by in ((numbers, r"\1\2"), (numbers, r"\1\2"), (rf"(^|[^{word}])(?:Figure|Table){s}*{d}+", r"\1"), (_WEB, ""), (rf"[{w}.-]+@[{w}.-]+\.[{w}]+", "")):
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({column}, '{s}+', ' ', 'g'))"


_RULES_TEXT = r"""WITH {BEFORE}p AS (SELECT {KEYS}, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS para_idx,
  regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^{T}+|{T}+$', '', 'g') AS paragraph FROM {SOURCE} WHERE text IS NOT NULL),
told AS (SELECT *, {LANG} AS language FROM p),
r AS (SELECT *, CASE WHEN contains(paragraph, repeat('.', 147)) THEN 'table_of_contents' WHEN contains(paragraph, 'ACRONYMS AND ABBREVIATIONS') THEN 'acronyms'
  WHEN regexp_matches(paragraph, '[\x{0E00}-\x{0E7F}\x{0600}-\x{06FF}]') THEN 'non_latin'
  WHEN len(regexp_split_to_array(paragraph, '{S}+')) < 10 THEN 'short_paragraph'
  WHEN length(regexp_replace(paragraph, '{ND}', '', 'g')) / length(paragraph)::DOUBLE > 0.2::DOUBLE THEN 'too_many_numbers'
  WHEN upper(paragraph) = paragraph AND lower(paragraph) <> paragraph THEN 'all_caps'
  WHEN regexp_matches(paragraph, '^({D}+\.|[A-Z][a-z]+{S}*,|et al\.)') THEN 'references'
  WHEN language IN ('id', 'fr', 'es', 'ar', 'th') THEN 'unwanted_language' END AS skip_reason FROM told WHERE paragraph <> '')
"""


def _rules_sql(unicode: bool = True, language: str = "lang", keys: str = "doc_id, lang", source: str = "documents", before: str = "") -> str:
    space, digit, _ = _UNICODE if unicode else _ASCII
    trim = space[:-1] + r"\x{1C}-\x{1F}]" if unicode else r"[ \t\r\n\x0b\x0c]"
    space = space if unicode else trim
    return _RULES_TEXT.replace("{T}", trim).replace("{S}", space).replace("{ND}", r"\P{Nd}" if unicode else "[^0-9]").replace("{D}", digit).replace(
        "{LANG}", language).replace("{KEYS}", keys).replace("{SOURCE}", source).replace("{BEFORE}", before)


# written out once more, as the stop words
_FREQUENT = {
    "en": "the of and to in is that for was with are this from were have has which their been not",
    "fr": "le la les des et est dans une que pour qui sur pas par avec sont cette aux ont ses",
    "es": "el los las del una por con para que se es en como más fue son sus esta este y",
    "pt": "os das dos uma não com para que em ao pela pelo são foi mais seus também à às e",
    "id": "yang dan di dengan untuk dari pada ini itu tidak dalam adalah akan oleh ke telah kepada juga sebagai para",
    "de": "der die das und ist von mit den für nicht auf ein eine dem des sich als auch wird zu",
}


def _language_sql(column: str) -> str:
    letters = f"len(regexp_extract_all({column}, '\\p{{L}}'))"
    words = f"list_distinct(regexp_extract_all(lower({column}), '\\p{{L}}+'))"
    hits = {k: "len(list_intersect({}, [{}]))".format(words, ", ".join(f"'{w}'" for w in v.split())) for k, v in _FREQUENT.items()}
    most = f"greatest({', '.join(hits.values())})"
    told = " ".join(f"WHEN {most} >= 2 AND {h} = {most} THEN '{k}'" for k, h in hits.items())
    script = lambda r: f"len(regexp_extract_all({column}, '{r}')) * 4 > {letters}"
    return (f"CASE WHEN {column} IS NULL OR {letters} = 0 THEN NULL WHEN {script('[\\x{0E00}-\\x{0E7F}]')} THEN 'th' WHEN {script('[\\x{0600}-\\x{06FF}]')} THEN 'ar' {told} END")


def _report_sql() -> str:
    panel = _full("panel", "coalesce(c.frequency, 0)")
    top = lambda what, source, order, n: f"(SELECT list({what} ORDER BY {order}) FROM (SELECT * FROM {source} ORDER BY {order} LIMIT {n}))"
    return f"""WITH sig AS ({_null_sql('(hits / 50::DOUBLE)')}), cv AS ({_tokens_sql() + _CV}), sim AS ({_similarity_sql("n2")}), df AS ({_DIFF} SELECT * FROM diff),
sp AS (SELECT * FROM (WITH {_PANEL}, {panel}{_Z.replace("round(z, 6)", "z")})), vo AS (SELECT * FROM (WITH {_PANEL}, {panel} {_VOLATILITY})),
lines AS (SELECT list_concat(['# Summary', '', '## Significance'],
  [(SELECT count(*) FILTER (significant) || ' of ' || count(*) || ' topics differ significantly between the groups.' FROM sig)],
  {top("printf('- topic %d: p = %.4f', topic, p_value)", "sig", "p_value, topic", 5)},
  ['', '## Coherence', (SELECT printf('- mean c_v: %.4f', avg(score)) FROM cv)],
  {top("printf('- topic %d: %.4f', topic, score)", "(SELECT * FROM cv WHERE score IS NOT NULL)", "score DESC, topic", 5)},
  ['', '## Similarity'], (SELECT [printf('- within: %.4f and %.4f', within_trump, within_biden), printf('- between: %.4f', between),
    printf('- ratio: %.2f', CASE WHEN between > 0 THEN (within_trump + within_biden) / 2 / between ELSE 'inf'::DOUBLE END),
    CASE WHEN between <= 0 OR (within_trump + within_biden) / 2 / between > 1.1 THEN '- the groups differ in content' ELSE '- the groups are alike in content' END] FROM sim),
  ['', '## Largest differences'], {top("printf('- %s: %.4f', label, difference)", "df", "difference DESC, label", 5)},
  ['', '## Spikes'], {top("printf('- %d, %s: %.4f', topic, period, z)", "sp", "z DESC, topic", 5)},
  ['', '## Most volatile periods'], {top("printf('- %s: %.4f', period, volatility)", "vo", "volatility DESC, period", 3)}) AS l)
SELECT CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS line FROM lines"""


def oracle_sql() -> dict[str, str]:
    reasons = ", ".join(f"('{r}')" for r in ("table_of_contents", "acronyms", "non_latin", "short_paragraph", "too_many_numbers", "all_caps", "references", "unwanted_language"))
    valid = "SELECT doc_id, CAST(para_idx AS BIGINT) AS para_idx, paragraph FROM r WHERE skip_reason IS NULL"
    pairs = _PAIRS.replace("{SOME}", "true")
    clean = "SELECT para_id, {} AS cleaned FROM processed_paragraphs_filtered"
    seeds = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT label AS seed, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT vec_id, seed, list_cosine_similarity(e, c) AS cosine FROM v CROSS JOIN c)
SELECT vec_id, seed, round(cosine, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, seed) = 1"""
    return {
        "para_valid": _rules_sql() + valid,
        "para_valid_ascii": _rules_sql(False) + valid,
        "para_valid_detected": _rules_sql(language=_language_sql("paragraph")) + valid,
        "para_languages": "SELECT doc_id, " + _language_sql("text") + " AS language FROM documents",
        "para_skip_counts": _rules_sql() + f"SELECT d.skip_reason, count(r.doc_id) AS n FROM (VALUES {reasons}) d(skip_reason) LEFT JOIN r USING (skip_reason) GROUP BY 1",
        "corpus_clean": clean.format(_corpus_clean_sql(_UNICODE)),
        "corpus_clean_ascii": clean.format(_corpus_clean_sql(_ASCII)),
        "ocr_clean": clean.format(_ocr_clean_sql(_UNICODE, _UNICODE[2])),
        "ocr_clean_ascii": clean.format(_ocr_clean_sql(_ASCII, r"\p{L}\p{Nd}_")),
        "corpus_load": f"""WITH c AS (SELECT filename, TRY_CAST(trim(year) AS DOUBLE) AS yd, CASE WHEN text IS NULL OR text IN ('', 'NA', 'N/A', 'null', 'NULL', 'NaN', 'nan', 'None') THEN 'nan' ELSE text END AS text
FROM processed_paragraphs_filtered) SELECT filename, CAST(yd AS INT) AS year, CASE WHEN yd >= 2021 THEN 'Biden' WHEN yd >= 2017 THEN 'Trump' ELSE 'Other' END AS administration,
{_corpus_clean_sql(_UNICODE)} AS cleaned FROM c WHERE yd = floor(yd)""",
        "corpus_yearly": "SELECT CAST(yd AS INT) AS year, count(*) AS num_paragraphs FROM (SELECT TRY_CAST(trim(year) AS DOUBLE) AS yd FROM processed_paragraphs_filtered) WHERE yd = floor(yd) GROUP BY 1",
        "word_tokens": f"SELECT para_id, array_to_string({_WORDS_SQL}, ' ') AS tokens FROM processed_paragraphs_filtered",
        "label_words": """SELECT topic, CASE WHEN len(string_split(name, '_')) > 2 THEN array_to_string(string_split(name, '_')[2:], '|')
ELSE replace(regexp_replace(name, '^[^_]*_', ''), ' ', '|') END AS words FROM topic_info""",
        "stop_words": "SELECT DISTINCT replace(unnest([" + ", ".join(f"'{w}'" for w in _STOP) + "]), '_', ' ') AS word",
        "year_from_filename": "SELECT DISTINCT filename, regexp_extract(filename, 'document_([0-9]{4})-', 1) AS year FROM source_files",
        "period_label": "WITH " + _YEAR + " SELECT grp, count(*) AS n FROM docs GROUP BY grp",
        "period_share": "WITH " + _YEAR + " SELECT grp, round(count(*) / (SELECT count(*) FROM docs)::DOUBLE, 9) AS share FROM docs GROUP BY grp",
        "yearly_counts": "WITH " + _YEAR + " SELECT year, count(*) AS num_paragraphs FROM docs GROUP BY year",
        "corpus_stats": "WITH " + _YEAR + " SELECT count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (grp = 'Trump') AS trump, count(*) FILTER (grp = 'Biden') AS biden FROM docs",
        "group_topic_diff": _DIFF + " SELECT * FROM diff",
        "group_topic_diff_top": _DIFF + " SELECT * FROM diff ORDER BY difference DESC, topic LIMIT 15",
        "attention_shift": _SHIFT + " SELECT * FROM shift",
        "attention_extremes": _SHIFT + " (SELECT * FROM shift ORDER BY attention_shift DESC, topic LIMIT 5) UNION ALL (SELECT * FROM shift ORDER BY attention_shift, topic LIMIT 5)",
        "null_model_empirical": _null_sql("(hits / 50::DOUBLE)"),
        "null_model_add_one": _null_sql("((hits + 1) / 51::DOUBLE)"),
        "topics_over_time_20": _bins_sql("20"),
        "topics_over_time_yearly": _bins_sql("hi - lo + 1"),
        "topics_over_time_quarterly": _bins_sql("(hi - lo + 1) * 4"),
        "trend_normalized_calendar": _trend_sql("ceil(ts)"),
        "trend_normalized_bin_left": _trend_sql("floor(ts)"),
        "heatmap_top15": "WITH " + _YEAR + """, c AS (SELECT topic, year AS period, count(*) AS frequency FROM docs WHERE topic IS NOT NULL GROUP BY 1, 2),
top AS (SELECT topic FROM c GROUP BY topic ORDER BY sum(frequency) DESC, topic LIMIT 15),
m AS (SELECT coalesce(name, 'Topic ' || c.topic) AS label, period, avg(frequency) AS frequency FROM c JOIN top USING (topic) LEFT JOIN topic_info USING (topic) GROUP BY 1, 2)
SELECT label, period, coalesce(frequency, 0)::DOUBLE AS frequency FROM (SELECT DISTINCT label FROM m) CROSS JOIN (SELECT DISTINCT period FROM m) LEFT JOIN m USING (label, period)""",
        "evolution_up": "WITH " + _PANEL + ", " + _full("gappy", "c.frequency") + f" SELECT * FROM ({_EVOLUTION}) ORDER BY change DESC, topic LIMIT 10",
        "evolution_down": "WITH " + _PANEL + ", " + _full("gappy", "c.frequency") + f" SELECT * FROM ({_EVOLUTION}) ORDER BY change, topic LIMIT 10",
        "evolution_all": "WITH " + _PANEL + ", " + _full("panel", "c.frequency") + " " + _EVOLUTION,
        "volatility": "WITH " + _PANEL + ", " + _full("panel", "coalesce(c.frequency, 0)") + " " + _VOLATILITY,
        "volatility_gappy": "WITH " + _PANEL + ", " + _full("gappy", "coalesce(c.frequency, 0)") + " " + _VOLATILITY,
        "volatility_events": "WITH e AS (SELECT event_type AS topic, CAST(ts AS DATE) AS period, count(*) AS frequency FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2), "
        + _full("e", "coalesce(c.frequency, 0)") + " " + _VOLATILITY,
        "focusing_events": "WITH " + _PANEL + ", " + _full("panel", "coalesce(c.frequency, 0)") + _Z,
        "focusing_events_months": _MONTHS + _full("m", "coalesce(c.frequency, 0)") + _Z,
        "similarity_summary": _similarity_sql("n2"),
        "similarity_pairs": _similarity_sql("pairs"),
        "balanced_sample": """SELECT vec_id, grp FROM (SELECT vec_id, CASE WHEN label < 5 THEN 'Trump' ELSE 'Biden' END AS grp FROM embeddings)
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY md5('42|' || vec_id), vec_id) <= 100""",
        "seed_affinity": seeds,
        "guided_vectors": f"""WITH nearest AS ({seeds}), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT label AS seed, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT vec_id, CASE WHEN cosine > 0.2 THEN list_transform(list_zip(e, c), lambda p: p[1] * 0.75::DOUBLE + p[2] * 0.25::DOUBLE) ELSE e END AS g FROM v JOIN nearest USING (vec_id) JOIN c USING (seed))
SELECT vec_id, round(sqrt(list_sum(list_transform(g, lambda x: x * x))), 6) AS norm FROM g""",
        "chart_over_time": _bins_sql("20", """, top AS (SELECT topic FROM over_time GROUP BY topic ORDER BY sum(frequency) DESC, topic LIMIT 10)
SELECT topic, coalesce(name, 'Topic ' || topic) AS label, round(ts, 6) AS timestamp, frequency FROM over_time JOIN top USING (topic) LEFT JOIN topic_info USING (topic)"""),
        "topics_by_year": "WITH " + _YEAR + " SELECT topic, year || '-01-01 00:00:00' AS stamp, year, count(*) AS frequency FROM docs WHERE topic IS NOT NULL GROUP BY topic, year",
        "page_paragraphs": _rules_sql(language=_language_sql("paragraph"), keys="filename, page_num", source="pages",
            before="""pages AS (SELECT filename, page_num, string_agg(text, chr(10) || chr(10) ORDER BY text) AS text FROM processed_paragraphs_filtered WHERE text IS NOT NULL GROUP BY 1, 2),
""") + "SELECT filename, page_num, CAST(para_idx AS INT) AS para_idx, regexp_extract(filename, 'document_([0-9]{4})-', 1) AS year, paragraph AS text, skip_reason FROM r",
        "page_files": _rules_sql(language=_language_sql("paragraph"), keys="filename, page_num", source="pages",
            before="""per AS (SELECT filename, page_num AS n, string_agg(translate(text, chr(12), ' '), chr(10) || chr(10) ORDER BY translate(text, chr(12), ' ')) AS text
  FROM processed_paragraphs_filtered WHERE text IS NOT NULL GROUP BY 1, 2),
pages AS (SELECT filename, CAST(row_number() OVER (PARTITION BY filename ORDER BY n NULLS FIRST) AS INT) AS page_num, text FROM per),
""") + "SELECT filename, page_num, count(*) AS paragraphs, count(*) FILTER (skip_reason IS NULL) AS kept FROM r WHERE paragraph <> '' GROUP BY 1, 2",
        "chart_topic_shift": _DIFF + ", b AS (SELECT * FROM diff ORDER BY difference DESC, label LIMIT 15) SELECT label, 'trump' AS series, trump AS value FROM b UNION ALL SELECT label, 'biden', biden FROM b",
        "chart_similarity": f"""WITH s AS ({_similarity_sql("n2")}) SELECT 'within_trump' AS measure, within_trump AS value FROM s UNION ALL SELECT 'within_biden', within_biden FROM s
UNION ALL SELECT 'between', between FROM s""",
        "seed_terms": "SELECT seed_id, unnest(terms) AS term FROM seed_topics",
        "ctfidf_terms": _tokens_sql() + " SELECT topic, CAST(rank AS INT) AS rank, term, round(weight, 9) AS weight FROM rk WHERE rank <= 4",
        "topic_labels": _tokens_sql() + " SELECT topic, topic || '_' || string_agg(term, '_' ORDER BY rank) AS name FROM rk WHERE rank <= 4 GROUP BY topic",
        "coherence_cv": _tokens_sql() + _CV,
        "coherence_umass_first": _tokens_sql() + _PAIRS.replace("{SOME}", "doc_id IN (SELECT doc_id FROM tok ORDER BY doc_id LIMIT 5000)") + "SELECT topic, measure, round(score, 6) AS score FROM um",
        "topic_words_over_time": _tokens_sql() + _WORDS_OVER_TIME,
        "ngram_vocabulary": _tokens_sql() + _NGRAMS,
        "topic_merge": _tokens_sql().replace("WITH ", "WITH RECURSIVE ", 1) + _MERGE.replace("{LIMIT}", "0.9::DOUBLE"),
        "topic_hierarchy": _tokens_sql().replace("WITH ", "WITH RECURSIVE ", 1) + _HIERARCHY,
        "coherence_pairs": _tokens_sql() + pairs + "SELECT topic, term_i, term_j, round(score, 6) AS score FROM up",
        "coherence_umass": _tokens_sql() + pairs + "SELECT topic, measure, round(score, 6) AS score FROM um",
        "coherence_stats": _tokens_sql() + pairs + """SELECT measure, round(avg(coalesce(score, 0.01)), 6) AS mean, round(median(coalesce(score, 0.01)), 6) AS median,
round(stddev_samp(coalesce(score, 0.01)), 6) AS std FROM um GROUP BY measure""",
        "attention_pivot": "WITH " + _SHARES + " SELECT topic, n_l AS trump, n_r AS biden, n - n_l - n_r AS other FROM g",
        "spikes_top15": "WITH " + _PANEL + ", " + _full("panel", "coalesce(c.frequency, 0)") + _Z + " ORDER BY 4 DESC, topic, period LIMIT 15",
        "chart_significant": f"SELECT topic || ': ' || CASE WHEN length(label) > 20 THEN substr(label, 1, 20) || '...' ELSE label END AS bar, abs_difference, significant "
        f"FROM (SELECT t.*, coalesce(name, 'Topic ' || topic) AS label FROM ({_null_sql('(hits / 50::DOUBLE)')}) t LEFT JOIN topic_info USING (topic)) WHERE p_value <= 0.5",
        "chart_topic_terms": _tokens_sql() + """, big AS (SELECT topic FROM docs WHERE topic IS NOT NULL GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 15)
SELECT topic, CAST(rank AS INT) AS rank, term, round(weight, 9) AS weight FROM rk JOIN big USING (topic) WHERE rank <= 10""",
        "summary_report": _report_sql(),
        "chart_volatility": "WITH " + _PANEL + ", " + _full("panel", "coalesce(c.frequency, 0)") + f""", v AS ({_VOLATILITY})
SELECT period, volatility, CAST((SELECT count(*) FROM (VALUES ('1997-01-20'), ('2001-01-20')) m(x) WHERE x <= period) AS INT) AS era FROM v""",
    }
