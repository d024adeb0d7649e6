"""Topics over time: binning, normalisation, growth, volatility and spikes.

Periods and topics are few, documents many: every operator first aggregates to
(topic, period) and works on that.  Windows are partitioned by topic and run
over the complete spine, never over the observed rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraloom.functions.periods import bin_left, equal_width_edges, filled


def topic_period_counts(df: DataFrame, topic: str = "topic", period: str = "period") -> DataFrame:
    """(topic, period, frequency); rows with a null topic or period are left out."""
    return df.where(F.col(topic).isNotNull() & F.col(period).isNotNull()).groupBy(
        F.col(topic).alias("topic"), F.col(period).alias("period")).agg(F.count(F.lit(1)).alias("frequency"))


def bin_edges(rows: DataFrame, x: str, bins: int | str = 20) -> DataFrame:
    """(edges), one row: right-closed bins of equal width over the span of ``x``.

    ``bins``: a number, ``yearly`` (one a year of the span) or ``quarterly`` (four).
    """
    span = rows.agg(F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high"))
    years = F.greatest(F.col("high") - F.col("low") + 1, F.lit(1))
    n = F.lit(bins) if isinstance(bins, int) else (years * {"yearly": 1, "quarterly": 4}[bins]).cast("int")
    return span.select(equal_width_edges(F.col("low"), F.col("high"), n).alias("edges"))


def topics_over_time(df: DataFrame, x: str, bins: int | str = 20) -> DataFrame:
    """(topic, timestamp, frequency) in the bins of ``bin_edges``, named by their left edges."""
    rows = df.where(F.col("topic").isNotNull() & F.col(x).isNotNull())
    edges = bin_edges(rows, x, bins)
    # bin the distinct values, not the documents
    narrow = rows.groupBy("topic", x).agg(F.count(F.lit(1)).alias("n"))
    binned = narrow.crossJoin(F.broadcast(edges)).withColumn("timestamp", bin_left(F.col(x).cast("double"), F.col("edges")))
    return binned.groupBy("topic", "timestamp").agg(F.sum("n").alias("frequency"))


def normalized_trend(over_time: DataFrame, yearly: DataFrame, normalize: str = "calendar") -> DataFrame:
    """Adds ``share``: frequency by the documents of the year (``year``, ``n``).

    ``calendar`` takes the year the bin covers (the integer above its left
    edge), ``bin_left`` the integer part of the edge; a year without
    documents divides by one.
    """
    year = F.floor("timestamp") if normalize == "bin_left" else F.floor("timestamp") + F.when(F.col("timestamp") > F.floor("timestamp"), 1).otherwise(0)
    keyed = over_time.withColumn("year", year.cast("int"))
    joined = keyed.join(yearly.select(F.col("year"), F.col("n").alias("_n")), "year", "left")
    return joined.withColumn("share", F.col("frequency") / F.coalesce(F.nullif("_n", F.lit(0)), F.lit(1))).drop("_n")


def top_topics(over_time: DataFrame, n: int = 15) -> DataFrame:
    """(topic) of the ``n`` largest total frequencies, smaller topics first on ties."""
    return over_time.groupBy("topic").agg(F.sum("frequency").alias("total")).orderBy(F.desc("total"), "topic").limit(n).select("topic")


def heatmap(over_time: DataFrame, names: DataFrame, n: int = 15, period: str = "timestamp") -> DataFrame:
    """(label, period, frequency): mean over topics of one name, zeros on the spine, of the top topics."""
    from paraloom.operators.groups import labels

    top = over_time.join(top_topics(over_time, n), "topic", "left_semi")
    mean = labels(top, names).groupBy("label", period).agg(F.avg("frequency").alias("frequency"))
    return filled(mean, "label", period, "frequency", 0.0)


def pivoted(cells: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """Wide form with given columns; zero where nothing is.  Two values for one cell fail."""
    kind = cells.schema[value].dataType
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("two values for one cell")).cast(kind)).otherwise(F.first(value))
    return cells.groupBy(row).pivot(column, values).agg(one).na.fill(0)


def _by_period(topic: str = "topic", period: str = "period"):
    return Window.partitionBy(topic).orderBy(period)


def evolution(counts: DataFrame, period: str = "period") -> DataFrame:
    """(topic, change): the sum of period-to-period changes; a change beside a gap is null and not counted."""
    full = filled(counts, "topic", period, "frequency", None)
    change = F.col("frequency") - F.lag("frequency").over(_by_period(period=period))
    return full.withColumn("_c", change).groupBy("topic").agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("double").alias("change"))


def growing(evolved: DataFrame, n: int = 10) -> DataFrame:
    return evolved.orderBy(F.desc("change"), "topic").limit(n)


def shrinking(evolved: DataFrame, n: int = 10) -> DataFrame:
    return evolved.orderBy(F.asc("change"), "topic").limit(n)


def volatility(counts: DataFrame, period: str = "period") -> DataFrame:
    """(period, volatility): the sum over topics of absolute changes on the zero-filled spine; the first period is 0."""
    full = filled(counts, "topic", period, "frequency", 0)
    change = F.abs(F.col("frequency") - F.lag("frequency").over(_by_period(period=period)))
    return full.withColumn("_c", change).groupBy(period).agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("double").alias("volatility"))


def z_scores(counts: DataFrame, window: int = 60, period: str = "period") -> DataFrame:
    """Adds rolling mean, deviation and z over the last ``window`` observed periods, the current one included.

    A deviation of zero divides by one; a single period has none, so its z is null.
    """
    full = filled(counts, "topic", period, "frequency", 0)
    rows = _by_period(period=period).rowsBetween(-(window - 1), 0)
    scored = full.withColumns({"mean": F.avg("frequency").over(rows), "deviation": F.stddev_samp("frequency").over(rows)})
    by: Column = F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation"))
    return scored.withColumn("z", (F.col("frequency") - F.col("mean")) / by)


def focusing_events(counts: DataFrame, window: int = 60, limit: float = 2.0, period: str = "period") -> DataFrame:
    """(topic, period, frequency, z) of the periods whose z is over the limit."""
    return z_scores(counts, window, period).where(F.col("z") > limit).select("topic", period, "frequency", "z")
