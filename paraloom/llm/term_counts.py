"""Problem 6: how often every term occurs, and in how many records.

The counts live in a store of Parquet tables, partitioned by a hash of the term.
A change set (records with sign +1 or -1; a changed record is its old text with
-1 and its new one with +1) is aggregated on its own into per-term deltas, and
only the buckets that these touch are read, merged and written again; unchanged
records are never read again.  A version is a small list that says which file
holds each bucket, so it costs what it changes.

Defined results: null texts are no records; empty and blank texts are records
without terms; repeated rows count each time; a term whose record count falls
to zero leaves the store; an empty table gives no terms.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paraloom.session import materialize

TOTAL = ""  # the store's row for the number of records; no term is empty
TERMS_PER_BUCKET, LEAST_BUCKETS = 500_000, 16
VERSIONS_KEPT = 2
MIN_LETTERS = 3


def term_deltas(changes: DataFrame, text: str = "text", sign: str | None = None) -> DataFrame:
    """(term, occurrences, records) as signed sums over the changed records only.

    Each text is cut once; its terms and then its distinct terms are exploded
    together, the position telling which is which, and summed map-side, so
    that the shuffle carries the vocabulary of each task and not the text.
    """
    signed = changes.where(F.col(text).isNotNull()).select(
        F.split(F.lower(F.col(text)), r"[^\p{L}]+").alias("_t"),
        (F.col(sign) if sign else F.lit(1)).cast("bigint").alias("_s"),
    )
    once = signed.select(
        F.size("_t").alias("_n"), "_s",
        F.posexplode(F.concat(F.array(F.lit(TOTAL)), "_t", F.array_distinct("_t"))).alias("_pos", "term"),
    )
    kept = once.where((F.col("_pos") == 0) | (F.length("term") >= MIN_LETTERS))
    first = F.col("_pos") <= F.col("_n")
    return kept.groupBy("term").agg(
        F.sum(F.when(first & (F.col("_pos") > 0), F.col("_s")).otherwise(0)).alias("occurrences"),
        F.sum(F.when(~first | (F.col("_pos") == 0), F.col("_s")).otherwise(0)).alias("records"),
    )


def merge_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored counts plus signed deltas; terms left without records disappear."""
    return (
        counts.select("term", "occurrences", "records")
        .unionByName(deltas.select("term", "occurrences", "records"))
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .where(F.col("records") != 0)
    )


class TermCountStore:
    """Counts in ``path/data/v=<n>/bucket=<b>`` and lists of what is valid in ``path/versions``.

    A version counts once its list is there, which is written last, so a job
    that dies midway leaves the one before valid.  The number of buckets is
    fixed by the first change set.  A stream's batches are noted in the list:
    one that is delivered again is counted once, whatever was applied since.
    """

    SCHEMA = "term string, occurrences bigint, records bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _children(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._children(f"{self.path}/versions") if n.endswith(".json"))

    def _newest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": -1, "buckets": None, "files": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{versions[-1]}.json", wholetext=True).first()[0])

    def _publish(self, state: dict) -> None:
        fs, target = self._fs(f"{self.path}/versions/{state['version']}.json")
        _, draft = self._fs(f"{self.path}/versions/{state['version']}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        fs.rename(draft, target)

    def _tidy(self, state: dict) -> None:
        """Lists beyond the kept ones go, and files that no kept list names."""
        versions = self._versions()
        kept = versions[-VERSIONS_KEPT:]
        used = {(v, int(b)) for n in kept for b, v in json.loads(self.spark.read.text(f"{self.path}/versions/{n}.json", wholetext=True).first()[0])["files"].items()}
        for n in versions[:-VERSIONS_KEPT]:
            fs, where = self._fs(f"{self.path}/versions/{n}.json")
            fs.delete(where, False)
        for name in self._children(f"{self.path}/data"):
            version = int(name[2:])
            if version <= state["version"] and not any(v == version for v, _ in used):
                fs, where = self._fs(f"{self.path}/data/{name}")
                fs.delete(where, True)
            elif version < state["version"]:
                for child in self._children(f"{self.path}/data/{name}"):
                    if child.startswith("bucket=") and (version, int(child[7:])) not in used:
                        fs, where = self._fs(f"{self.path}/data/{name}/{child}")
                        fs.delete(where, True)

    def _read(self, files: dict[str, int]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/data/v={v}/bucket={b}" for b, v in files.items()))

    def counts(self) -> DataFrame:
        """The newest counts, totals row included."""
        return self._read(self._newest()["files"])

    def apply(self, changes: DataFrame, text: str = "text", sign: str | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Merge one change set; returns the version it is in.  ``stream`` and ``batch`` name a delivery that may come again."""
        state = self._newest()
        if stream is not None and state["batches"].get(stream, -1) >= batch:
            return state["version"]
        deltas = materialize(term_deltas(changes, text, sign), "term-deltas")
        buckets = state["buckets"] or self.buckets or max(LEAST_BUCKETS, -(-deltas.count() // TERMS_PER_BUCKET))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        touched = {str(r[0]) for r in deltas.select(bucket).distinct().collect()}  # as many as there are buckets
        version = state["version"] + 1
        merged = merge_counts(self._read({b: v for b, v in state["files"].items() if b in touched}), deltas)
        (
            merged.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        )
        written = {n[7:]: version for n in self._children(f"{self.path}/data/v={version}") if n.startswith("bucket=")}
        files = {b: v for b, v in state["files"].items() if b not in touched} | written
        batches = state["batches"] | ({stream: batch} if stream is not None else {})
        state = {"version": version, "buckets": buckets, "files": files, "batches": batches}
        self._publish(state)
        self._tidy(state)
        return version

    def terms(self) -> DataFrame:
        """(term, occurrences, records, total): one row per term."""
        counts = self.counts()
        total = counts.where(F.col("term") == TOTAL).agg(F.coalesce(F.max("records"), F.lit(0)).alias("total"))
        return counts.where(F.col("term") != TOTAL).crossJoin(F.broadcast(total))


def mark_terms(terms: DataFrame, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Adds ``mark``: rare, common or null; both limits are exclusive as named."""
    return terms.withColumn(
        "mark",
        F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("total") * F.lit(common_above), "common"),
    )


def follow(stream: DataFrame, store: TermCountStore, checkpoint: str, text: str = "text", sign: str | None = None, once: bool = True) -> StreamingQuery:
    """Keep a store up to date with a stream of changed records.

    Batches are told by the query's own id, which its checkpoint keeps: one that
    is delivered again after a failure is counted once, and a stream that starts
    anew over the same store goes on from what is there.
    """
    def merge(batch: DataFrame, number: int) -> None:
        query = json.loads(store.spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]
        store.apply(batch, text, sign, stream=query, batch=number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()
