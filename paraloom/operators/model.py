"""A guided topic model from its parts: embed, guide, project, cluster, describe, merge.

Projection and clustering stand in for what needs packages or models that are
not here: principal components for non-linear projections, k-means for the
clusters, top terms for language-model labels.  Each part can be given instead
(``embedder``, ``labeler``).  Documents are assigned once and the assignment is
a table; every analysis reads it.  The fitted stages are kept, so that further
documents are assigned as the first ones were, also after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import IDF, PCA, HashingTF, IDFModel, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.functions.stopwords import enhanced_stopwords
from paraloom.functions.text import letter_tokens
from paraloom.operators import topics, vectors
from paraloom.session import materialize

Embedder = Callable[[DataFrame], DataFrame]
Labeler = Callable[[DataFrame], DataFrame]
TABLES = ("doc_topic", "topic_terms", "topic_info", "centroids", "merged")
FLOOR = 0.3  # cosine from which a document is pulled towards a seed
SHARPNESS = 10.0  # of the probabilities: cosines to the clusters' centres are weighed by exp(SHARPNESS * cosine)


def tokenized(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens) without stop words; null texts have no tokens."""
    rows = df.select(F.col(key), F.coalesce(letter_tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    return topics.without_stopwords(rows, enhanced_stopwords())


@dataclass
class HashedEmbedding:
    """(key, tokens) -> (key, embedding): TF-IDF over hashed terms on its principal components; documents without tokens have none."""

    key: str
    features: int
    idf: IDFModel
    pca: PCAModel

    @classmethod
    def fit(cls, tokens: DataFrame, key: str, features: int = 1 << 10, size: int = 32) -> HashedEmbedding:
        """The covariance that the projection needs has features x features cells, whatever the number of rows."""
        counted = cls._counted(tokens, features)
        idf = IDF(inputCol="_tf", outputCol="_w").fit(counted)
        return cls(key, features, idf, PCA(k=size, inputCol="_w", outputCol="_p").fit(idf.transform(counted)))

    @staticmethod
    def _counted(tokens: DataFrame, features: int) -> DataFrame:
        return HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=features).transform(tokens.where(F.size("tokens") > 0))

    def __call__(self, tokens: DataFrame) -> DataFrame:
        weighted = self.idf.transform(self._counted(tokens, self.features))
        return self.pca.transform(weighted).select(self.key, vector_to_array("_p").alias("embedding"))

    def save(self, path: str) -> None:
        self.idf.write().overwrite().save(f"{path}/idf")
        self.pca.write().overwrite().save(f"{path}/embedding")

    @classmethod
    def load(cls, path: str, key: str, features: int) -> HashedEmbedding:
        return cls(key, features, IDFModel.load(f"{path}/idf"), PCAModel.load(f"{path}/embedding"))


def hashed_embedding(tokens: DataFrame, key: str, features: int = 1 << 10, size: int = 32) -> DataFrame:
    """(key, embedding) of the documents that the embedding is fitted on."""
    return HashedEmbedding.fit(tokens, key, features, size)(tokens)


def seed_centroids(tokens: DataFrame, embedded: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(seed_id, centroid): the mean embedding of the documents that hold a word of a seed's terms, weighted by how many."""
    words = seeds.select("seed_id", F.explode("terms").alias("t")).select("seed_id", F.explode(letter_tokens(F.col("t"))).alias("term")).distinct()
    hits = tokens.select(key, F.explode(F.array_distinct("tokens")).alias("term")).join(words, "term").groupBy(key, "seed_id").agg(F.count(F.lit(1)).alias("n"))
    parts = hits.where("n >= 2").join(embedded, key).select("seed_id", "n", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("seed_id", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"))
    return means.groupBy("seed_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("centroid"))


@dataclass
class Stages:
    """What assigns documents: an embedding, seeds that pull, a projection, clusters."""

    key: str
    embedder: Embedder
    seeds: DataFrame | None = None
    projection: PCAModel | None = None
    clusters: KMeansModel | None = None

    def embed(self, tokens: DataFrame) -> DataFrame:
        out = self.embedder(tokens)
        if self.seeds is None:
            return out
        return vectors.guided(out, vectors.seed_affinity(out, self.seeds, self.key), self.seeds, self.key, floor=FLOOR)

    def flatten(self, embedded: DataFrame) -> DataFrame:
        return vectors.project(embedded, self.key, fitted=self.projection).withColumnRenamed("coordinates", "embedding")

    def assign(self, flat: DataFrame, merged: DataFrame | None) -> DataFrame:
        """(key, topic, prob): the topic of the nearest cluster, and the share of all clusters' weight that lies on its topic."""
        centres = [c.tolist() for c in self.clusters.clusterCenters()]
        to = {r["topic"]: r["merged"] for r in merged.collect()} if merged is not None else {}
        known = F.array(*[F.struct(F.lit(to.get(i, i)).alias("topic"), F.array(*map(F.lit, c)).alias("c"), F.lit(float(sum(x * x for x in c)) ** 0.5).alias("n")) for i, c in enumerate(centres)])
        named = F.create_map(*[F.lit(x) for i in range(len(centres)) for x in (i, to.get(i, i))])
        rows = flat.join(vectors.cluster(flat, self.key, fitted=self.clusters), self.key)
        v = F.col("_v")
        weights = F.transform(known, lambda c: F.struct(
            c["topic"].alias("topic"), F.exp(SHARPNESS * F.coalesce(vectors.dot(v, c["c"]) / F.nullif(c["n"], F.lit(0.0)), F.lit(0.0))).alias("w")))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x["w"])
        placed = rows.select(self.key, F.element_at(named, F.col("topic")).alias("topic"), vectors.unit(F.col("embedding")).alias("_v")).withColumn("_w", weights)
        return placed.select(self.key, "topic", (total(F.filter("_w", lambda x: x["topic"] == F.col("topic"))) / total(F.col("_w"))).alias("prob"))


@dataclass
class TopicModel:
    key: str
    doc_topic: DataFrame  # key, topic, prob
    topic_terms: DataFrame  # topic, rank, term, weight
    topic_info: DataFrame  # topic, count, name, representation
    centroids: DataFrame  # topic, centroid
    merged: DataFrame  # topic (of the clusters), merged
    stages: Stages = field(repr=False, default=None)

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(key, topic, prob) of documents, new or old; those without a token or vector get no topic, and none has one in a model of nothing."""
        if self.stages is None:
            return df.where(F.lit(False)).select(self.key, F.lit(0).alias("topic"), F.lit(0.0).alias("prob"))
        tokens = tokenized(df, self.key, text)
        return self.stages.assign(self.stages.flatten(self.stages.embed(tokens)), self.merged)

    def save(self, path: str) -> None:
        """Tables and fitted stages; a given embedder is no part of it and is given again at ``load``."""
        if self.stages is None:
            raise ValueError("a model of no documents has nothing to keep")
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        own = isinstance(self.stages.embedder, HashedEmbedding)
        if own:
            self.stages.embedder.save(f"{path}/stages")
        self.stages.projection.write().overwrite().save(f"{path}/stages/projection")
        self.stages.clusters.write().overwrite().save(f"{path}/stages/clusters")
        if self.stages.seeds is not None:
            self.stages.seeds.write.mode("overwrite").parquet(f"{path}/stages/seeds")
        about = {"key": self.key, "features": self.stages.embedder.features if own else None, "seeds": self.stages.seeds is not None}
        spark = self.doc_topic.sparkSession
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None) -> TopicModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        key = about["key"]
        if embedder is None and about["features"] is None:
            raise ValueError("this model was fitted with an embedder of its own, which must be given again")
        stages = Stages(key, embedder or HashedEmbedding.load(f"{path}/stages", key, about["features"]),
                        spark.read.parquet(f"{path}/stages/seeds") if about["seeds"] else None,
                        PCAModel.load(f"{path}/stages/projection"), KMeansModel.load(f"{path}/stages/clusters"))
        return cls(key, *(spark.read.parquet(f"{path}/{name}") for name in TABLES), stages)


def describe(doc_topic: DataFrame, tokens: DataFrame, key: str, labeler: Labeler = topics.default_labels, n: int = 10, upto: int = 1,
             min_topics: int = 1, max_share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(topic_terms, topic_info) of an assignment, with runs of up to ``upto`` words as terms; ``labeler`` turns topic_terms into (topic, name)."""
    counts = topics.term_counts(topics.n_grams(tokens.join(doc_topic.select(key, "topic"), key), upto))
    if min_topics > 1 or max_share < 1.0:
        counts = topics.vocabulary_filter(counts, min_topics, max_share)
    terms = topics.top_terms(topics.class_tf_idf(counts), n)
    sizes = doc_topic.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    listed = terms.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    info = sizes.join(labeler(terms), "topic", "left").join(listed, "topic", "left").select(
        "topic", "count", "name", F.transform("t", lambda x: x["term"]).alias("representation"))
    return terms, info


def fit(df: DataFrame, key: str, text: str = "text", k: int = 50, seeds: DataFrame | None = None, embedder: Embedder | None = None,
        labeler: Labeler = topics.default_labels, components: int = 5, merge_above: float | None = 0.95, min_topic_size: int = 1,
        upto: int = 3, min_topics: int = 1, max_share: float = 1.0, seed: int = 42) -> TopicModel:
    """``embedder`` takes (key, tokens) and gives (key, embedding); documents without a token or vector get no topic.

    Topics alike above ``merge_above`` become one; those of fewer documents than
    ``min_topic_size`` go to the most similar of the others.  Terms are runs of
    up to ``upto`` words.  Without any document that has a token all tables are empty.
    """
    # every stage is read several times (fits, iterations, joins), so each is a table in the shared folder
    tokens = materialize(tokenized(df, key, text), "tokens")
    if tokens.where(F.size("tokens") > 0).isEmpty():
        return _nothing(tokens, key)
    stages = Stages(key, embedder or HashedEmbedding.fit(tokens, key))
    embedded = materialize(stages.embed(tokens), "embedding")
    if seeds is not None:
        stages.seeds = materialize(seed_centroids(tokens, embedded, seeds, key), "seeds")
        embedded = materialize(stages.embed(tokens), "guided")
    stages.projection = vectors.fit_projection(embedded, components)
    flat = materialize(stages.flatten(embedded), "projected")
    stages.clusters = vectors.fit_clusters(flat, k, seed=seed)
    first = materialize(vectors.cluster(flat, key, fitted=stages.clusters), "clusters")
    merged = first.select("topic", F.col("topic").alias("merged")).distinct()
    if merge_above is not None:
        weights = materialize(topics.class_tf_idf(topics.term_counts(tokens.join(first, key))), "weights")
        merged = _after(merged, topics.merged_topics(topics.topic_similarity(weights), first.select("topic"), merge_above))
    if min_topic_size > 1:
        joined = materialize(first.join(F.broadcast(merged), "topic").select(key, F.col("merged").alias("topic")), "merged")
        weights = materialize(topics.class_tf_idf(topics.term_counts(tokens.join(joined, key))), "weights")
        merged = _after(merged, topics.without_small(joined, topics.topic_similarity(weights), min_topic_size))
    merged = materialize(merged, "topics")  # at most as many rows as clusters
    assigned = materialize(stages.assign(flat, merged), "doc-topic")
    terms, info = describe(assigned, tokens, key, labeler, upto=upto, min_topics=min_topics, max_share=max_share)
    centres = vectors.centroids(embedded.join(assigned, key), "topic")
    return TopicModel(key, assigned, terms, info, centres, merged, stages)


def _nothing(tokens: DataFrame, key: str) -> TopicModel:
    empty = lambda schema: tokens.sparkSession.createDataFrame([], schema)
    return TopicModel(
        key, tokens.where(F.lit(False)).select(key, F.lit(0).alias("topic"), F.lit(0.0).alias("prob")), empty("topic int, rank int, term string, weight double"),
        empty("topic int, count bigint, name string, representation array<string>"), empty("topic int, centroid array<double>"), empty("topic int, merged int"), None)


def _after(merged: DataFrame, further: DataFrame) -> DataFrame:
    """One step of merging after another."""
    step = further.select(F.col("topic").alias("merged"), F.col("merged").alias("_to"))
    return merged.join(step, "merged", "left").select("topic", F.coalesce("_to", "merged").alias("merged"))
