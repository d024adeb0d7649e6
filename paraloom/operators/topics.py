"""Topic terms, labels, coherence, and the merging of like topics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraloom.session import materialize

MOST_KEYWORDS, MOST_TOPICS = 100_000, 2_000


def term_counts(tokens: DataFrame) -> DataFrame:
    """(topic, term, tf) from a frame with an array column ``tokens`` and ``topic``."""
    return tokens.where(F.col("topic").isNotNull()).select("topic", F.explode("tokens").alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))


def without_stopwords(df: DataFrame, stopwords: list[str], column: str = "tokens") -> DataFrame:
    """Drops the stop words by a hash lookup in the JVM; a null array stays null."""
    remover = StopWordsRemover(inputCol="_in", outputCol=column, stopWords=stopwords, caseSensitive=True)
    return remover.transform(df.withColumnRenamed(column, "_in")).drop("_in")


def n_grams(df: DataFrame, upto: int = 3, column: str = "tokens") -> DataFrame:
    """The tokens and all their runs of up to ``upto``, joined by blanks."""
    out, made = df, [F.col(column)]
    for n in range(2, upto + 1):
        out = NGram(n=n, inputCol=column, outputCol=f"_g{n}").transform(out)
        made.append(F.col(f"_g{n}"))
    return out.withColumn(column, F.concat(*made)).drop(*[f"_g{n}" for n in range(2, upto + 1)])


def vocabulary_filter(counts: DataFrame, min_topics: int = 1, max_share: float = 1.0) -> DataFrame:
    """Terms found in at least ``min_topics`` topics and at most ``max_share`` of all topics."""
    spread = counts.groupBy("term").agg(F.countDistinct("topic").alias("topics"))
    total = counts.agg(F.countDistinct("topic").alias("all_topics"))
    keep = spread.crossJoin(F.broadcast(total)).where((F.col("topics") >= min_topics) & (F.col("topics") <= F.col("all_topics") * F.lit(max_share)))
    return counts.join(keep.select("term"), "term", "left_semi")


def class_tf_idf(counts: DataFrame) -> DataFrame:
    """(topic, term, tf, weight): tf / words of the topic * ln(1 + mean words of a topic / tf over all topics)."""
    words = counts.groupBy("topic").agg(F.sum("tf").alias("topic_words"))
    mean = words.agg(F.avg("topic_words").alias("mean_words"))
    everywhere = counts.groupBy("term").agg(F.sum("tf").alias("term_total"))
    joined = counts.join(everywhere, "term").join(words.crossJoin(F.broadcast(mean)), "topic")
    return joined.select("topic", "term", "tf", (F.col("tf") / F.col("topic_words") * F.log(1 + F.col("mean_words") / F.col("term_total"))).alias("weight"))


def top_terms(weights: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight); ties by the term."""
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("topic", "rank", "term", "weight")


def default_labels(terms: DataFrame, n: int = 4) -> DataFrame:
    """(topic, name): ``topic_term1_..._termn``; an external labeller can replace it."""
    parts = terms.where(F.col("rank") <= n).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return parts.select("topic", F.concat_ws("_", F.col("topic").cast("string"), F.array_join(F.transform("t", lambda x: x["term"]), "_")).alias("name"))


def topic_words_over_time(tokens: DataFrame, n: int = 5, period: str = "period", global_tuning: bool = True, evolution_tuning: bool = True) -> DataFrame:
    """(topic, period, words): the best terms of each cell by class TF-IDF, averaged with the whole topic's
    weights and with the period before, as asked."""
    cells = tokens.select("topic", period, F.explode("tokens").alias("term")).groupBy("topic", period, "term").agg(F.count(F.lit(1)).alias("tf"))
    overall = class_tf_idf(cells.groupBy("topic", "term").agg(F.sum("tf").alias("tf"))).select("topic", "term", F.col("weight").alias("overall"))
    words = cells.groupBy("topic", period).agg(F.sum("tf").alias("cell_words"))
    totals = cells.groupBy("term").agg(F.sum("tf").alias("term_total"))
    mean = words.agg(F.avg("cell_words").alias("mean_words"))
    local = cells.join(words.crossJoin(F.broadcast(mean)), ["topic", period]).join(totals, "term").withColumn(
        "weight", F.col("tf") / F.col("cell_words") * F.log(1 + F.col("mean_words") / F.col("term_total")))
    if global_tuning:
        local = local.join(overall, ["topic", "term"]).withColumn("weight", (F.col("weight") + F.col("overall")) / 2)
    if evolution_tuning:
        before = F.lag("weight").over(Window.partitionBy("topic", "term").orderBy(period))
        local = local.withColumn("weight", F.coalesce((F.col("weight") + before) / 2, F.col("weight")))
    order = Window.partitionBy("topic", period).orderBy(F.desc(F.round("weight", 12)), "term")  # so that equal weights tie, however they were summed
    best = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return best.groupBy("topic", period).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t")).select(
        "topic", period, F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("words"))


def _listed_keywords(keywords: DataFrame) -> DataFrame:
    """The distinct keywords in one row; more than ``MOST_KEYWORDS`` fail."""
    words = keywords.agg(F.collect_set("term").alias("_kw"))
    return words.select(F.when(F.size("_kw") > MOST_KEYWORDS, F.raise_error(F.lit(f"over {MOST_KEYWORDS} keywords")).cast("array<string>")).otherwise(F.col("_kw")).alias("_kw"))


def keyword_documents(tokens: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """(key, term): the distinct keywords of every document.  Each document meets the list of keywords where it is, and nothing else of it goes on."""
    met = tokens.select(key, "tokens").crossJoin(F.broadcast(_listed_keywords(keywords)))
    return met.select(key, F.explode(F.array_intersect("tokens", "_kw")).alias("term"))


def first_documents(tokens: DataFrame, key: str, n: int = 5_000) -> DataFrame:
    """The first ``n`` documents by key, for measures that are stated on so many."""
    return tokens.join(tokens.select(key).orderBy(key).limit(n), key, "left_semi")


def umass_pairs(tokens: DataFrame, keywords: DataFrame, key: str, epsilon: float = 1e-12) -> DataFrame:
    """(topic, term_i, term_j, score) for rank i > j: ln((D(i, j) / N + epsilon) / (D(j) / N)).

    Keyword pairs are generated within a topic (at most ten terms) and counted
    per document, so no document meets another.
    """
    present = materialize(keyword_documents(tokens, keywords, key), "keyword-documents")
    document_counts = present.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    total = tokens.agg(F.count(F.lit(1)).alias("n_docs"))
    ranked = present.join(keywords.select("topic", "term", "rank"), "term")
    lists = ranked.groupBy(key, "topic").agg(F.collect_list(F.struct("rank", "term")).alias("k"))
    together = lists.select("topic", F.explode("k").alias("i"), "k").select("topic", "i", F.explode("k").alias("j")).where("i.rank > j.rank")
    both = together.groupBy("topic", F.col("i.term").alias("term_i"), F.col("j.term").alias("term_j")).agg(F.count(F.lit(1)).alias("d_ij"))
    known = keywords.join(document_counts, "term").select("topic", "term", "rank", "d")
    i = known.select("topic", F.col("term").alias("term_i"), F.col("rank").alias("rank_i"))
    j = known.select("topic", F.col("term").alias("term_j"), F.col("rank").alias("rank_j"), F.col("d").alias("d_j"))
    pairs = i.join(j, "topic").where("rank_i > rank_j").join(both, ["topic", "term_i", "term_j"], "left").crossJoin(F.broadcast(total))
    return pairs.select("topic", "term_i", "term_j", F.log((F.coalesce("d_ij", F.lit(0)) / F.col("n_docs") + epsilon) / (F.col("d_j") / F.col("n_docs"))).alias("score"))


def coherence_umass(pairs: DataFrame, keywords: DataFrame, min_keyword_score: float | None = None) -> DataFrame:
    """(topic, measure, score): the mean of a topic's pairs; with under two usable keywords null, or ``min_keyword_score``."""
    scored = keywords.select("topic").distinct().join(pairs.groupBy("topic").agg(F.avg("score").alias("score")), "topic", "left")
    fallback = F.lit(None).cast("double") if min_keyword_score is None else F.lit(min_keyword_score)
    return scored.select("topic", F.lit("u_mass").alias("measure"), F.coalesce("score", fallback).alias("score"))


def _checked(words: DataFrame) -> DataFrame:
    """A table of keywords that may be broadcast; more than ``MOST_KEYWORDS`` fail."""
    if words.limit(MOST_KEYWORDS + 1).count() > MOST_KEYWORDS:
        raise ValueError(f"over {MOST_KEYWORDS} keywords")
    return words


def _shared_windows(window: int):
    """(term, other, c): in how many windows the keywords of one topic stand together, each with itself included; summed by task."""

    def ranges(places: list[int], last: int) -> list[tuple[int, int]]:
        """The starts of the windows that hold one of the places, as ranges without overlap."""
        out: list[tuple[int, int]] = []
        for p in sorted(places):
            a, b = max(p - window + 1, 0), min(p, last)
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def common(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> int:
        i = j = n = 0
        while i < len(x) and j < len(y):
            n += max(0, min(x[i][1], y[j][1]) - max(x[i][0], y[j][0]) + 1)
            if x[i][1] < y[j][1]:
                i += 1
            else:
                j += 1
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for windows, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at: dict[str, list[int]] = {}
                topics: dict[str, set] = {}
                for c in places:
                    at.setdefault(c["term"], []).append(c["p"])
                    topics[c["term"]] = set(c["topics"])
                spans = {term: ranges(p, windows - 1) for term, p in at.items()}
                terms = sorted(spans)
                for k, a in enumerate(terms):
                    for b in terms[k:]:
                        if topics[a] & topics[b]:
                            n = common(spans[a], spans[b])
                            if n:
                                total[a, b] += n
                                if a != b:
                                    total[b, a] += n
        rows = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["term", "other", "c"])

    return run


def coherence_cv(tokens: DataFrame, keywords: DataFrame, key: str, window: int = 110, epsilon: float = 1e-12, min_keyword_score: float | None = None) -> DataFrame:
    """(topic, measure, score) by context vectors of normalised pointwise mutual information over sliding windows.

    Only the places of keywords are exploded and gathered by document: a keyword
    at place p lies in the windows that start in (p - window, p], and how many
    windows hold a keyword, or two of one topic, is read off these ranges.
    """
    length = F.size("tokens")
    words = keywords.groupBy("term").agg(F.collect_set("topic").alias("topics"))
    placed = tokens.where(length > 0).select(F.col(key).alias("_k"), F.greatest(length - window + 1, F.lit(1)).alias("windows"), F.posexplode("tokens").alias("p", "term"))
    kept = placed.join(F.broadcast(_checked(words)), "term").groupBy("_k", "windows").agg(F.collect_list(F.struct("term", "p", "topics")).alias("places"))
    total = tokens.where(length > 0).agg(F.sum(F.greatest(length - window + 1, F.lit(1))).alias("total"))
    counts = materialize(kept.select("windows", "places").mapInArrow(_shared_windows(window), "term string, other string, c bigint").groupBy("term", "other").agg(F.sum("c").alias("c")), "windows")
    single = counts.where("term = other").select("term", "c")
    both = counts.select("term", "other", F.col("c").alias("c_both"))
    pairs = keywords.select("topic", "term").alias("x").join(keywords.select(F.col("topic"), F.col("term").alias("other")).alias("y"), "topic")
    wanted = pairs.select("term", "other").distinct()
    counted = wanted.join(both, ["term", "other"], "left").join(single, "term").join(single.select(F.col("term").alias("other"), F.col("c").alias("c_other")), "other").crossJoin(F.broadcast(total))
    p = F.coalesce("c_both", F.lit(0)) / F.col("total")
    npmi = F.log((p + epsilon) / (F.col("c") / F.col("total") * F.col("c_other") / F.col("total"))) / -F.log(p + epsilon)
    cells = pairs.join(counted.select("term", "other", npmi.alias("v")), ["term", "other"])
    sums = cells.groupBy("topic", "other").agg(F.sum("v").alias("t"))
    joined = cells.join(sums, ["topic", "other"])
    cosine = F.sum(F.col("v") * F.col("t")) / F.nullif(F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("t") * F.col("t"))), F.lit(0.0))
    per_word = joined.groupBy("topic", "term").agg(cosine.alias("cosine"))
    usable = per_word.groupBy("topic").agg(F.avg("cosine").alias("score"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    fallback = F.lit(None).cast("double") if min_keyword_score is None else F.lit(min_keyword_score)
    return keywords.select("topic").distinct().join(usable, "topic", "left").select("topic", F.lit("c_v").alias("measure"), F.coalesce("score", fallback).alias("score"))


def coherence_statistics(scores: DataFrame) -> DataFrame:
    """(measure, mean, median, std) over the topics with a score."""
    return scores.groupBy("measure").agg(F.avg("score").alias("mean"), F.median("score").alias("median"), F.stddev_samp("score").alias("std"))


def topic_similarity(weights: DataFrame) -> DataFrame:
    """(a, b, cosine) with a < b, of topics by their term weights; joined on terms, at most topics squared rows come out."""
    norms = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scaled = weights.join(norms, "topic").where("norm > 0").select("topic", "term", (F.col("weight") / F.col("norm")).alias("w"))
    other = scaled.select(F.col("topic").alias("b"), "term", F.col("w").alias("w2"))
    return scaled.select(F.col("topic").alias("a"), "term", "w").join(other, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("w") * F.col("w2")).alias("cosine"))


def _few(topics: DataFrame) -> list:
    """The distinct topics, which the driver may hold; more than ``MOST_TOPICS`` fail."""
    names = [r[0] for r in topics.select("topic").distinct().limit(MOST_TOPICS + 1).collect()]
    if len(names) > MOST_TOPICS:
        raise ValueError(f"over {MOST_TOPICS} topics")
    return sorted(names)


def _roots(names: list):
    parent = {t: t for t in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return parent, root


def merged_topics(similarity: DataFrame, topics: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(topic, merged): like topics share the smallest number of their group; at most ``MOST_TOPICS``, so the driver joins them."""
    names = _few(topics)
    parent, root = _roots(names)
    for a, b in sorted((r["a"], r["b"]) for r in similarity.where(F.col("cosine") > threshold).collect()):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    kind = topics.schema["topic"].dataType.simpleString()
    return topics.sparkSession.createDataFrame([(t, root(t)) for t in names], f"topic {kind}, merged {kind}")


def without_small(assigned: DataFrame, similarity: DataFrame, min_size: int) -> DataFrame:
    """(topic, merged): topics of fewer documents than ``min_size`` go to the most similar large one; the largest where none is similar."""
    sizes = {r["topic"]: r["n"] for r in assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) > MOST_TOPICS:
        raise ValueError(f"over {MOST_TOPICS} topics")
    near = {(r["a"], r["b"]): r["cosine"] for r in similarity.collect()}
    large = sorted((t for t, n in sizes.items() if n >= min_size), key=lambda t: (-sizes[t], t)) or sorted(sizes, key=lambda t: (-sizes[t], t))[:1]
    rows = [(t, t if n >= min_size or t in large else max(large, key=lambda u: (near.get((min(t, u), max(t, u)), 0.0), -large.index(u)))) for t, n in sorted(sizes.items())]
    kind = assigned.schema["topic"].dataType.simpleString()
    return assigned.sparkSession.createDataFrame(rows, f"topic {kind}, merged {kind}")


def topic_hierarchy(similarity: DataFrame, topics: DataFrame) -> DataFrame:
    """(step, a, b, distance): single-linkage merges of the topics by cosine distance, on the driver (at most ``MOST_TOPICS``)."""
    names = _few(topics)
    near = {(r["a"], r["b"]): 1 - r["cosine"] for r in similarity.collect()}
    pairs = sorted((near.get((a, b), 1.0), a, b) for i, a in enumerate(names) for b in names[i + 1:])
    parent, root = _roots(names)
    steps = []
    for d, a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            steps.append((len(steps) + 1, min(ra, rb), max(ra, rb), float(d)))
            parent[max(ra, rb)] = min(ra, rb)
    kind = topics.schema["topic"].dataType.simpleString()
    return topics.sparkSession.createDataFrame(steps, f"step int, a {kind}, b {kind}, distance double")
