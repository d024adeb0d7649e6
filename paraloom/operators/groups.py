"""How topics are shared out between two groups of documents.

Every operator takes a frame with columns ``topic`` and ``grp`` (one row per
document) and names its columns after the two groups.  Rows with a null topic
or group are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labels(df: DataFrame, topic_info: DataFrame) -> DataFrame:
    """Adds ``label``: the topic's name, or ``Topic n``.  Names are a small dimension; the planner sees its size."""
    names = topic_info.groupBy("topic").agg(F.min("name").alias("name"))
    return df.join(names, "topic", "left").withColumn("label", F.coalesce("name", F.concat(F.lit("Topic "), F.col("topic").cast("string")))).drop("name")


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, (F.col("n") / F.col("total")).alias("share"))


def topic_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    """(topic, n_left, n_right, left_total, right_total) of the topics that occur in either group; one shuffle of a row per topic and task."""
    counts = df.where(F.col("grp").isin(left, right) & F.col("topic").isNotNull()).groupBy("topic").agg(
        F.count_if(F.col("grp") == left).alias("n_left"), F.count_if(F.col("grp") == right).alias("n_right"))
    everything = Window.partitionBy(F.lit(1))  # over topics, not over documents
    return counts.withColumns({"left_total": F.sum("n_left").over(everything), "right_total": F.sum("n_right").over(everything)})


def _share(n: str, total: str) -> Column:
    return F.coalesce(F.col(n) / F.nullif(F.col(total), F.lit(0)), F.lit(0.0))


def topic_difference(df: DataFrame, left: str, right: str) -> DataFrame:
    """(topic, left, right, difference): shares within each group and their absolute difference."""
    shares = topic_counts(df, left, right).select("topic", _share("n_left", "left_total").alias(left), _share("n_right", "right_total").alias(right))
    return shares.withColumn("difference", F.abs(F.col(left) - F.col(right)))


def attention_shift(df: DataFrame, left: str, right: str) -> DataFrame:
    """(topic, left, right, attention_shift): the signed difference, over all topics of all groups."""
    clean = df.where(F.col("topic").isNotNull())
    counts = clean.groupBy("topic").agg(F.count_if(F.col("grp") == left).alias("n_left"), F.count_if(F.col("grp") == right).alias("n_right"))
    everything = Window.partitionBy(F.lit(1))
    totals = counts.withColumns({"left_total": F.sum("n_left").over(everything), "right_total": F.sum("n_right").over(everything)})
    shares = totals.select("topic", _share("n_left", "left_total").alias(left), _share("n_right", "right_total").alias(right))
    return shares.withColumn("attention_shift", F.col(right) - F.col(left))


def extremes(df: DataFrame, by: str, n: int = 10, key: str = "topic") -> DataFrame:
    """The ``n`` largest and the ``n`` smallest, one after the other; a row can be in both."""
    return df.orderBy(F.desc(by), key).limit(n).unionAll(df.orderBy(F.asc(by), key).limit(n))


def permutation_test_ranked(df: DataFrame, left: str, right: str, permutations: int = 50, pvalue: str = "empirical", key: str = "doc_id") -> DataFrame:
    """(topic, left, right, abs_difference, p_value, significant) against shuffled group labels.

    The shuffle of permutation p orders documents by md5(p|key), so any engine
    gets the same result.  Ranks are taken within the first four digits of the
    digest and offset by the counts of the digits before, so no task ranks a
    whole permutation.  It moves permutations x documents narrow rows, so it is
    for checking ``permutation_test`` against other engines.
    ``pvalue``: ``empirical`` is mean(null >= observed), ``add_one`` is (count + 1) / (permutations + 1).
    """
    docs = df.where(F.col("topic").isNotNull()).select(F.col(key).alias("key"), "topic", "grp")
    sizes = docs.agg(F.count_if(F.col("grp") == left).alias("n_l"), F.count_if(F.col("grp") == right).alias("n_r"))
    spread = docs.select("key", "topic", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p"))
    spread = spread.withColumn("digest", F.md5(F.concat_ws("|", F.col("p").cast("string"), F.col("key").cast("string"))))
    spread = spread.withColumn("lead", F.substring("digest", 1, 4))
    leads = spread.groupBy("p", "lead").agg(F.count(F.lit(1)).alias("n"))
    before = leads.select("p", "lead", (F.sum("n").over(Window.partitionBy("p").orderBy("lead")) - F.col("n")).alias("before"))
    ranked = spread.withColumn("rn", F.row_number().over(Window.partitionBy("p", "lead").orderBy("digest", "key")))
    placed = ranked.join(before, ["p", "lead"]).withColumn("rn", F.col("rn") + F.col("before")).crossJoin(F.broadcast(sizes))
    null_counts = placed.where(F.col("rn") <= F.col("n_l") + F.col("n_r")).groupBy("p", "topic").agg(
        F.count_if(F.col("rn") <= F.col("n_l")).alias("c_l"), F.count_if(F.col("rn") > F.col("n_l")).alias("c_r"),
        F.first("n_l").alias("n_l"), F.first("n_r").alias("n_r"))
    null = null_counts.select("p", "topic", F.abs(F.col("c_l") / F.col("n_l") - F.col("c_r") / F.col("n_r")).alias("null_difference"))
    return _p_values(topic_difference(df, left, right), null, permutations, pvalue)


def _p_values(observed: DataFrame, null: DataFrame, permutations: int, pvalue: str) -> DataFrame:
    # permutations that leave a topic out of both groups differ by zero: they count only where nothing was observed
    reached = observed.join(null, "topic", "left").groupBy("topic").agg(
        F.count_if(F.col("null_difference") >= F.col("difference")).alias("hits"), F.count("null_difference").alias("drawn"))
    joined = observed.join(reached, "topic").withColumn(
        "hits", F.col("hits") + F.when(F.col("difference") <= 0, permutations - F.col("drawn")).otherwise(0))
    p = (F.col("hits") + 1) / F.lit(permutations + 1) if pvalue == "add_one" else F.col("hits") / F.nullif(F.lit(permutations), F.lit(0))
    scored = joined.withColumnRenamed("difference", "abs_difference").withColumn("p_value", p.cast("double"))
    return scored.drop("hits", "drawn").withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def permutation_test(df: DataFrame, left: str, right: str, permutations: int = 50, pvalue: str = "empirical", seed: int = 42) -> DataFrame:
    """(topic, left, right, abs_difference, p_value, significant) against shuffled group labels, from topic counts alone.

    A shuffle of labels draws the groups' topic counts from a multivariate
    hypergeometric law, so each permutation is drawn directly in one task.
    The counts have one row per topic; they are gathered per permutation.
    """
    counts = df.where(F.col("topic").isNotNull()).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("grp") == left).alias("n_l"), F.count_if(F.col("grp") == right).alias("n_r"))
    packed = counts.agg(F.collect_list(F.struct("topic", "n")).alias("topics"), F.sum("n_l").alias("n_l"), F.sum("n_r").alias("n_r"))
    drawn = packed.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).repartition("p")
    topic_type = df.schema["topic"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cells = sorted(row["topics"] or [], key=lambda c: c["topic"])
                n = np.array([c["n"] for c in cells], np.int64)
                n_l, n_r = int(row["n_l"] or 0), int(row["n_r"] or 0)
                rng = np.random.default_rng([seed, row["p"]])
                a = rng.multivariate_hypergeometric(n, n_l, method="marginals") if len(n) else n
                b = rng.multivariate_hypergeometric(n - a, n_r, method="marginals") if len(n) else n
                diff = np.abs(a / max(n_l, 1) - b / max(n_r, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["topic"] for c in cells], batch.schema.field("topics").type.value_type.field("topic").type), pa.array([row["p"]] * len(n), pa.int32()), pa.array(diff)],
                    names=["topic", "p", "null_difference"])

    null = drawn.mapInArrow(run, f"topic {topic_type}, p int, null_difference double")
    return _p_values(topic_difference(df, left, right), null, permutations, pvalue)
