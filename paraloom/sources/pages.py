"""From page files to the paragraph table, and the paragraph CSV."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraloom.functions.language import Detector, detect_language
from paraloom.functions.periods import ADMINISTRATIONS, period_label
from paraloom.functions.text import corpus_clean, parse_year, year_from_filename
from paraloom.operators import quality
from paraloom.session import materialize
from paraloom.sources.pdf import pdf_pages

log = logging.getLogger("paraloom.pages")
PAGE = "path string, page_num int, text string, error string"
CORPUS = T.StructType([T.StructField("filename", T.StringType()), T.StructField("year", T.StringType()), T.StructField("text", T.StringType())])
#: The pages of a file's content: a text each, or the exception that kept it from being read.
Extractor = Callable[[bytes], Iterable[str | Exception]]


def text_pages(content: bytes) -> list[str | Exception]:
    """The plain extractor: UTF-8 text, pages parted by form feeds."""
    out: list[str | Exception] = []
    for page in content.split(b"\f"):
        try:
            out.append(page.decode("utf-8"))
        except UnicodeDecodeError as e:
            out.append(e)
    return out


def file_pages(content: bytes) -> Iterable[str | Exception]:
    """PDF files by their text layer, anything else as plain text."""
    return pdf_pages(content) if content[:1024].lstrip()[:5] == b"%PDF-" else text_pages(content)


def read_pages(spark: SparkSession, folder: str, extractor: Extractor = file_pages, pattern: str = "*.pdf") -> DataFrame:
    """(path, page_num, text, error, filename): one row per page of the files whose names match; case matters, folders below are not read.

    A page that cannot be read gives a row with its error and no text, a file
    that cannot be read one such row without a page; neither fails the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    told = lambda e: f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list = []
                try:
                    for i, page in enumerate(extractor(content), 1):
                        rows.append((path, i, None, told(page)) if isinstance(page, Exception) else (path, i, page, None))
                except Exception as e:  # whatever the extractor raises belongs to the file; its pages so far stay
                    rows.append((path, None, None, told(e)))
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))],
                                                 names=["path", "page_num", "text", "error"])

    return files.mapInArrow(run, PAGE).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def page_paragraphs(pages: DataFrame, language: str | Detector | None = None, unicode: bool = True) -> DataFrame:
    """(filename, page_num, para_idx, year, text, skip_reason): every paragraph with its verdict; kept ones have none."""
    found = quality.with_reason(quality.paragraphs(pages.where(F.col("text").isNotNull()), unicode=unicode), language, unicode=unicode)
    return found.select("filename", "page_num", F.col("para_idx").cast("int").alias("para_idx"), year_from_filename(F.col("filename")).alias("year"),
                        F.col("paragraph").alias("text"), "skip_reason")


def write_corpus(paragraphs: DataFrame, path: str) -> None:
    """The kept paragraphs as CSV with header ``filename,year,text``; quotes are doubled, line breaks kept."""
    kept = paragraphs.where("skip_reason is null").select("filename", "year", "text")
    kept.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_corpus(spark: SparkSession, path: str, null_text: str | None = "nan", bad_year: str = "drop") -> DataFrame:
    """(filename, year int, text) of a paragraph CSV.

    Missing texts, also ``NA``, ``null`` and ``NaN``, become ``null_text``; rows without a year are dropped or fail.
    """
    raw = spark.read.schema(CORPUS).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    missing = F.col("text").isNull() | F.col("text").isin("", "NA", "N/A", "null", "NULL", "NaN", "nan", "None")
    out = raw.withColumns({"text": F.when(missing, F.lit(null_text)).otherwise(F.col("text")), "year": parse_year(F.col("year"), bad_year)})
    return out.where(F.col("year").isNotNull())


@dataclass
class Build:
    paragraphs: DataFrame  # filename, page_num, para_idx, year, text, skip_reason
    counts: DataFrame  # skip_reason, n
    errors: DataFrame  # filename, page_num, error


def build_corpus(spark: SparkSession, folder: str, out: str, extractor: Extractor = file_pages, language: str | Detector | None = detect_language) -> Build:
    """Read all files of a folder, judge their paragraphs, write the kept ones as CSV, and log how many each rule rejected."""
    pages = materialize(read_pages(spark, folder, extractor), "pages")
    judged = materialize(page_paragraphs(pages, language), "paragraphs")
    write_corpus(judged, out)
    errors = pages.where("error is not null").select("filename", "page_num", "error")
    built = Build(judged, quality.skip_counts(judged), errors)
    log.info("%d pages, %d not read", pages.count(), errors.count())
    for row in built.counts.orderBy("skip_reason").collect():  # one row per rule
        log.info("%s: %d paragraphs", row["skip_reason"], row["n"])
    return built


def load_corpus(spark: SparkSession, path: str, null_text: str | None = "nan", bad_year: str = "drop", periods=ADMINISTRATIONS, unicode: bool = True) -> DataFrame:
    """(doc_id, filename, year, administration, text) of a paragraph CSV, cleaned; ids are set down with the rows, so they stay."""
    rows = read_corpus(spark, path, null_text, bad_year)
    loaded = rows.select(F.monotonically_increasing_id().alias("doc_id"), "filename", "year", period_label(F.col("year"), periods).alias("administration"),
                         corpus_clean(F.col("text"), unicode).alias("text"))
    return materialize(loaded, "corpus")


def yearly_paragraphs(documents: DataFrame) -> DataFrame:
    """(year, num_paragraphs)."""
    return documents.groupBy("year").agg(F.count(F.lit(1)).alias("num_paragraphs"))
