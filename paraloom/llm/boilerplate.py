"""Problem 3: lines repeated across the documents of one source.

Duplicates collapse first: paragraphs of one file that agree but for case,
figures and white space are one, and so is one text in several files for the
count of text clusters.  Each line is then counted over the distinct files,
clusters and publication dates it stands in; nothing else is counted.  The
stated rule asks for enough files, and that is what texts are cleaned by; the
flag ``boilerplate`` asks for several clusters and dates too and tells lines
that only a republished article repeats.

Defined results: null texts have no lines; empty lines and lines under the
minimum of words are never boilerplate but keep their numbers; rows without a
recognisable source are left alone; repeated rows are each cleaned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = r"([A-Z]{3})-[0-9]"
DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"


def line_key(line: Column) -> Column:
    """Lines are the same if they agree in this form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "#"), r"(?U)\s+", " "))


def source_of(filename: Column) -> Column:
    return F.regexp_extract(filename, SOURCE, 1)


def numbered_lines(df: DataFrame, key: str = "para_id", text: str = "text", filename: str = "filename", min_words: int = 5) -> DataFrame:
    """(key, line_no, source, line, file, cluster, date) with hashes for the wide parts."""
    # what holds for the whole text is told before it is cut, else it would be told for every line
    texts = df.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), source_of(F.col(filename)).alias("source"), F.xxhash64(filename).alias("file"),
        F.xxhash64(line_key(F.col(text))).alias("cluster"), F.regexp_extract(filename, DATE, 1).alias("date"), F.split(F.col(text), "\n").alias("_lines"))
    lines = texts.where(F.col("source") != "").select("key", "source", "file", "cluster", "date", F.posexplode("_lines").alias("line_no", "raw")).where(
        F.length("raw") >= 2 * min_words - 1)
    keyed = lines.withColumn("line", line_key(F.col("raw")))
    # a key has single blanks only, so its words are its blanks and one more
    long_enough = F.length("line") - F.length(F.translate("line", " ", "")) >= min_words - 1
    return keyed.where(long_enough).select(
        "key", F.col("line_no").cast("bigint").alias("line_no"), "source", F.xxhash64("line").alias("line"), "file", "cluster", "date")


def repeated_lines(lines: DataFrame, df: DataFrame, filename: str = "filename", min_files: int = 5, min_share: float = 0.2) -> DataFrame:
    """(source, line, n_files, n_clusters, n_dates, files_of_source, boilerplate): the lines over both limits.

    Lines of fewer rows than ``min_files`` are left out before anything is
    counted over.  Rows are then collapsed to (source, line, file, cluster,
    date) and counted on (source, line), never on the source alone, so a source
    with a third of all rows spreads over all tasks.  Only the sources
    themselves are broadcast: three capital letters, so at most 17,576 of them.
    """
    on = ["source", "line"]
    files = (
        df.where(F.col(filename).isNotNull()).select(source_of(F.col(filename)).alias("source"), F.xxhash64(filename).alias("file")).distinct()
        .groupBy("source").agg(F.count(F.lit(1)).alias("files_of_source"))
    )
    often = lines.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_files).select(*on)
    collapsed = lines.join(often, on, "left_semi").select(*on, "file", "cluster", "date").distinct()
    counted = collapsed.groupBy(*on).agg(
        F.countDistinct("file").alias("n_files"), F.countDistinct("cluster").alias("n_clusters"), F.countDistinct("date").alias("n_dates"))
    over = counted.where(F.col("n_files") >= min_files).join(F.broadcast(files), "source")
    kept = over.where(F.col("n_files") >= F.col("files_of_source") * F.lit(min_share))
    return kept.withColumn("boilerplate", (F.col("n_clusters") >= 3) & (F.col("n_dates") >= 2))


def without_lines(df: DataFrame, drop: DataFrame, key: str = "para_id", text: str = "text") -> DataFrame:
    """(key, text, n_removed): every text without the lines listed in ``drop`` (key, line_no)."""
    gone = drop.groupBy(key).agg(F.collect_set("line_no").alias("_drop"))
    joined = df.select(F.col(key), F.col(text)).join(gone, key, "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("_drop", i.cast("bigint")))
    return joined.select(
        key,
        F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text),
        F.coalesce(F.size("_drop"), F.lit(0)).alias("n_removed"),
    )
