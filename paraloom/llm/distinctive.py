"""Problem 7: how characteristic a term is of a record.

A term's counts per record are taken as a mixture of two Poisson laws: records
that merely mention it and records that are about it (the elite).  The mixture
is fitted per term by expectation-maximisation on the term's histogram of
counts (a few numbers, whatever the size of the collection); the score of an
occurrence count is the posterior probability of the elite component.

Defined results: null, empty and blank texts have no terms; repeated rows are
records of their own, and so are rows without a key; a term is a run of at least three letters of the
lower-cased text; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.session import materialize

ASCII_TERM, ANY_TERM = re.compile(r"[a-z]{3,}"), regex.compile(r"\p{L}{3,}")
FLUSH = 200_000  # entries of a task's local histogram before they are passed on
EM_ROUNDS = 40
HOT_TERMS = 1_000  # at most so many terms have more than a thousandth of all pairs
FIT_SCHEMA = "term string, records bigint, occurrences bigint, share double, low double, high double"


def terms_of(text: str) -> list[str]:
    low = text.lower()
    return ASCII_TERM.findall(low) if low.isascii() else ANY_TERM.findall(low)


def _count(min_count: int):
    schema = pa.schema([("id", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram: Counter = Counter()

        def flush():
            keys = list(histogram)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(keys), pa.int64()), pa.array([k[0] for k in keys], pa.string()),
                 pa.array([k[1] for k in keys], pa.int32()), pa.array(list(histogram.values()), pa.int64())], schema=schema)

        for batch in batches:
            ids, names, tfs = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(terms_of(text))
                histogram.update(counts.items())
                for term, tf in counts.items():
                    if tf >= min_count:
                        ids.append(key)
                        names.append(term)
                        tfs.append(tf)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(tfs, pa.int32()), pa.nulls(len(ids), pa.int64())], schema=schema)
            if len(histogram) > FLUSH:
                yield flush()
                histogram.clear()
        if histogram:
            yield flush()

    return run


def fit_mixtures(tf: np.ndarray, n: np.ndarray, zeros: np.ndarray, rounds: int = EM_ROUNDS):
    """EM for many terms at once.

    ``tf`` and ``n`` hold one histogram a row, padded with n = 0; ``zeros`` is the
    number of records without the term.  Returns (share of the elite, low rate,
    high rate).
    """
    tf, n = tf.astype(float), n.astype(float)
    records = np.maximum(n.sum(1), 1e-12)
    total = records + zeros
    mean_in = (tf * n).sum(1) / records
    top = np.where(n > 0, tf, 0).max(1)
    low = np.maximum((tf * n).sum(1) / total * 0.5, 1e-9)
    high = np.maximum(np.maximum(mean_in, 0.5 * top), low * 4)
    share = np.clip(records / total * 0.5, 1e-9, 0.5)
    for _ in range(rounds):
        tilt = np.log(share / (1 - share))
        log_ratio = tilt[:, None] + tf * np.log(high / low)[:, None] - (high - low)[:, None]
        elite = 1 / (1 + np.exp(-np.clip(log_ratio, -500, 500)))
        elite0 = 1 / (1 + np.exp(-np.clip(tilt - (high - low), -500, 500)))
        w1, w0 = elite * n, (1 - elite) * n
        mass1, mass0 = w1.sum(1) + elite0 * zeros, w0.sum(1) + (1 - elite0) * zeros
        high = np.maximum((w1 * tf).sum(1) / np.maximum(mass1, 1e-12), 1e-8)
        low = np.clip((w0 * tf).sum(1) / np.maximum(mass0, 1e-12), 1e-9, None)
        low, high = np.minimum(low, high), np.maximum(low, high) * (1 + 1e-9)
        share = np.clip(mass1 / total, 1e-12, 1 - 1e-12)
    return share, low, high


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(1)
        start = np.asarray(cells.offsets)
        width = np.diff(start)
        flat_tf = np.asarray(cells.values.field("tf"))
        flat_n = np.asarray(cells.values.field("n"))
        row = np.repeat(np.arange(batch.num_rows), width)
        col = np.arange(start[-1] - start[0]) - np.repeat(start[:-1] - start[0], width)
        tf = np.zeros((batch.num_rows, width.max()))
        n = np.zeros_like(tf)
        tf[row, col], n[row, col] = flat_tf[start[0]:start[-1]], flat_n[start[0]:start[-1]]
        records = n.sum(1)
        share, low, high = fit_mixtures(tf, n, np.asarray(batch.column(2)) - records)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(records.astype("int64")), pa.array((tf * n).sum(1).astype("int64")), pa.array(share), pa.array(low), pa.array(high)],
            names=["term", "records", "occurrences", "share", "low", "high"])


def term_scores(df: DataFrame, key: str = "para_id", text: str = "text", min_count: int = 1, max_records: int | None = None) -> DataFrame:
    """(key, term, tf, records, score): the posterior of the elite for every term of every record.

    ``min_count`` and ``max_records`` restrict the output, not the counting: all
    records enter the histograms and the fit.  The text is read once; a task
    passes on its own histogram, so the fit's shuffle is of vocabulary size.
    Terms with more than a thousandth of all pairs of record and term, of which
    there are at most a thousand, are looked up where the pairs are; only the
    others are joined by term, so no task holds a hot term.
    """
    source = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    counted = materialize(source.mapInArrow(_count(min_count), "id bigint, term string, tf int, n bigint"), "term-counts")
    total = source.agg(F.count(F.lit(1)).alias("total"))
    fitted = materialize(
        counted.where("n is not null").groupBy("term", "tf").agg(F.sum("n").alias("n"))
        .groupBy("term").agg(F.collect_list(F.struct("tf", "n")).alias("cells"))
        .crossJoin(F.broadcast(total)).select("term", "cells", "total")
        .mapInArrow(_fit, FIT_SCHEMA), "mixtures")
    n_pairs = fitted.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if max_records is not None:
        fitted = fitted.where(F.col("records") <= max_records)
    hot = F.col("records") * HOT_TERMS > F.lit(n_pairs)
    pairs = counted.where("n is null").select("id", "term", "tf")
    columns = [F.col(c) for c in ("records", "share", "low", "high")]
    known = pairs.join(F.broadcast(fitted.where(hot).select("term", F.struct(*columns).alias("fit"))), "term", "left")
    rest = known.where("fit is null").drop("fit").join(fitted.where(~hot).hint("merge"), "term").select("id", "term", "tf", *columns)
    every = known.where("fit is not null").select("id", "term", "tf", "fit.*").unionByName(rest)
    log_odds = (
        F.log(F.col("share") / (1 - F.col("share"))) + F.col("tf") * F.log(F.col("high") / F.col("low")) - (F.col("high") - F.col("low"))
    )
    return every.select(
        F.col("id").alias(key), "term", "tf", "records",
        (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), log_odds))))).alias("score"),
    )
