"""The result files of a full run, each by its name and with its columns.

``frames`` builds them all from the bindings of the catalogue; ``write_outputs``
writes each as one CSV file in a folder of its name.  Only result tables are
written here: topics, periods and summaries, and one row per document for the
projection.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.operators import groups, topics, trends, vectors
from paraloom.plans import catalogue
from paraloom.session import materialize
from paraloom.sources.tables import write_table

log = logging.getLogger("paraloom.outputs")
LEFT, RIGHT = catalogue.LEFT, catalogue.RIGHT
#: Files that are written only if they have rows.
IF_ANY = frozenset({"potential_focusing_events"})


def _named(df: DataFrame, names: DataFrame) -> DataFrame:
    return groups.labels(df, names).withColumnRenamed("label", "Name")


def _over_time(documents: DataFrame, tokens: DataFrame, names: DataFrame, bins) -> DataFrame:
    counts = trends.topics_over_time(documents, "year", bins)
    spans = trends.bin_edges(documents.where("topic is not null and year is not null"), "year", bins)
    stamped = tokens.crossJoin(F.broadcast(spans)).withColumn("period", catalogue.periods.bin_left(F.col("year").cast("double"), F.col("edges")))
    words = topics.topic_words_over_time(stamped).select("topic", F.col("period").alias("timestamp"), F.col("words").alias("Words"))
    return _named(counts.join(words, ["topic", "timestamp"], "left"), names).select(
        F.col("topic").alias("Topic"), "Words", F.col("frequency").alias("Frequency"), F.col("timestamp").alias("Timestamp"), "Name")


def _coherence(tokens: DataFrame, names: DataFrame, keywords: DataFrame) -> DataFrame:
    umass = topics.coherence_umass(topics.umass_pairs(tokens, keywords, "doc_id"), keywords)
    both = umass.unionByName(topics.coherence_cv(tokens, keywords, "doc_id"))
    used = keywords.groupBy("topic").agg(F.count(F.lit(1)).alias("Num_Keywords"))
    return _named(both.join(used, "topic"), names).select(
        F.col("topic").alias("Topic"), "Name", F.col("measure").alias("Coherence_Measure"), F.col("score").alias("Score"), "Num_Keywords")


def frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every result table by its name."""
    documents = materialize(catalogue.docs(spark, d, "ingested_at"), "documents")
    tokens, keywords = catalogue._words_of_topics(spark, d)
    names = catalogue.names(spark, d)
    coherence = materialize(_coherence(tokens, names, keywords), "coherence")
    counts = trends.topic_period_counts(documents, period="year")
    monthly = trends.topic_period_counts(documents.withColumn("period", catalogue.periods.month_end(F.col("ingested_at"))))
    changed = _named(trends.evolution(counts), names).select(F.col("topic").alias("Topic"), F.col("change").alias("Change_Value"), "Name")
    grouped = catalogue.grouped_vectors(spark, d)
    places = vectors.project(grouped, "vec_id", 2).join(grouped.select("vec_id", "grp"), "vec_id").select(
        F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y"), F.col("grp").alias("Administration"), F.col("vec_id").alias("Original_Index"))
    similarity = vectors.similarity_summary(grouped, LEFT, RIGHT).toDF(
        f"Within_{LEFT}", f"Within_{RIGHT}", "Between_Administrations", f"{LEFT}_Documents", f"{RIGHT}_Documents")
    compared = _named(groups.topic_difference(documents, LEFT, RIGHT), names)
    tested = _named(groups.permutation_test(documents, LEFT, RIGHT, 50), names)
    shifted = _named(groups.attention_shift(documents, LEFT, RIGHT), names)
    absolute = _over_time(documents, tokens, names, 20)
    yearly = catalogue.year_counts(spark, d)
    normalized = trends.normalized_trend(absolute.withColumnRenamed("Timestamp", "timestamp").withColumnRenamed("Frequency", "frequency"), yearly).select(
        "Topic", "Words", F.col("share").alias("Frequency"), F.col("timestamp").alias("Timestamp"), "Name")
    sizes = documents.where("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("Count"))
    told = keywords.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    info = _named(sizes.join(told, "topic", "left"), names).select(F.col("topic").alias("Topic"), "Count", "Name", F.transform("t", lambda x: x["term"]).alias("Representation"))
    return {
        "yearly_paragraph_counts": yearly.select("year", F.col("n").alias("num_paragraphs")).orderBy("year"),
        "administration_topic_comparison": compared.select("topic", LEFT, RIGHT, F.col("Name").alias("Label"), F.col("difference").alias("Difference")).orderBy(F.desc("Difference"), "topic"),
        "null_model_comparison": tested.select(
            F.col("topic").alias("Topic"), "Name", F.col(LEFT).alias(f"{LEFT}_Frequency"), F.col(RIGHT).alias(f"{RIGHT}_Frequency"),
            F.col("abs_difference").alias("Abs_Difference"), "p_value", F.col("significant").alias("Significant")).orderBy("p_value", "Topic"),
        "topic_coherence_metrics": coherence,
        "average_topic_coherence": topics.coherence_statistics(coherence.select(F.col("Coherence_Measure").alias("measure"), F.col("Score").alias("score"))).withColumnRenamed("measure", "Coherence_Measure"),
        "topics_over_time_quarterly": _over_time(documents, tokens, names, "quarterly"),
        "topics_over_time_yearly": _over_time(documents, tokens, names, "yearly"),
        "document_embeddings": places,
        "administration_similarity": similarity,
        "increasing_topics": changed.orderBy(F.desc("Change_Value"), "Topic").limit(10),
        "decreasing_topics": changed.orderBy("Change_Value", "Topic").limit(10),
        "topic_info": info,
        "topics_over_time": absolute,
        "policy_attention_shifts": shifted.select("topic", LEFT, RIGHT, "attention_shift", "Name").orderBy("topic"),
        "potential_focusing_events": _named(trends.focusing_events(monthly), names).select(
            F.col("period").alias("Date"), F.col("topic").alias("Topic"), F.col("Name").alias("Topic_Name"), F.col("z").alias("Z_Score")),
        "policy_volatility": trends.volatility(counts).select(F.col("period").alias("Date"), F.col("volatility").alias("Volatility")).orderBy("Date"),
        "topics_over_time_absolute": absolute,
        "topics_over_time_normalized": normalized,
    }


def write_outputs(spark: SparkSession, d: str, folder: str) -> list[str]:
    """Write every result table; returns the names written."""
    written = []
    for name, df in frames(spark, d).items():
        if name in IF_ANY and not df.limit(1).count():
            log.info("%s has no rows and is not written", name)
            continue
        write_table(df, folder, name, "csv", single_file=name != "document_embeddings")
        written.append(name)
    log.info("%d tables written to %s", len(written), folder)
    return written
