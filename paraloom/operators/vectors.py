"""Vectors: similarity of groups, balanced samples, seeds, projection, clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, Normalizer, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """The unit vector; a zero vector stays zero, a null vector null."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda _: F.lit(0.0)))


def similarity_summary(df: DataFrame, left: str, right: str, vector: str = "embedding", diagonal: str = "n2") -> DataFrame:
    """One row: mean cosine within each group and between them, from sums of unit vectors; linear in the rows.

    ``diagonal``: ``n2`` divides the off-diagonal sum by n*n, ``pairs`` by n*(n-1).
    """
    kept = df.where(F.col("grp").isin(left, right) & F.col(vector).isNotNull())
    units = kept.withColumn("_u", unit(F.col(vector)))
    sums = units.select("grp", F.posexplode("_u").alias("i", "x")).groupBy("grp", "i").agg(F.sum("x").alias("s"))
    sizes = units.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(norm(F.col("_u")) > 0).alias("filled"))
    wide = sums.groupBy("i").agg(F.sum(F.when(F.col("grp") == left, F.col("s"))).alias("a"), F.sum(F.when(F.col("grp") == right, F.col("s"))).alias("b"))
    total = wide.agg(F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    n = sizes.agg(*[F.coalesce(F.max(F.when(F.col("grp") == g, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for g, k in ((left, "a"), (right, "b")) for c in ("n", "filled")])

    def within(square: str, k: str) -> Column:
        pairs = F.col(f"n_{k}") * (F.col(f"n_{k}") if diagonal == "n2" else F.col(f"n_{k}") - 1)
        return (F.col(square) - F.col(f"filled_{k}")) / F.nullif(pairs, F.lit(0))

    return total.crossJoin(n).where((F.col("n_a") > 0) & (F.col("n_b") > 0)).select(
        within("aa", "a").alias(f"within_{left}"), within("bb", "b").alias(f"within_{right}"),
        (F.col("ab") / (F.col("n_a") * F.col("n_b"))).alias("between"), F.col("n_a").alias(f"{left}_documents"), F.col("n_b").alias(f"{right}_documents"))


def balanced_sample(df: DataFrame, key: str, groups: tuple[str, ...], size: int = 2000, seed: int = 42) -> DataFrame:
    """At most ``size`` rows, as many of each group, in the order of md5(seed|key); all rows of these groups if they are fewer."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    each = size // len(groups)
    # the first rows of each slice of the digests, then of the group: no task ranks a whole group
    sliced = df.where(F.col("grp").isin(*groups)).withColumns({"_d": digest, "_s": F.substring(digest, 32, 1)})
    first = sliced.withColumn("_n", F.row_number().over(Window.partitionBy("grp", "_s").orderBy("_d", key))).where(F.col("_n") <= each)
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy("_d", key))).where(F.col("_n") <= each).drop("_d", "_s", "_n")


def centroids(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, centroid): the mean vector of each group, summed dimension by dimension."""
    parts = df.where(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("centroid"))


MOST_SEEDS = 10_000


def _packed(seeds: DataFrame, seed_key: str) -> DataFrame:
    """All seeds in one row, so that they ride along with every partition; more than ``MOST_SEEDS`` fail."""
    listed = seeds.agg(F.collect_list(F.struct(F.col(seed_key).alias("seed"), F.col("centroid"), norm(F.col("centroid")).alias("norm"))).alias("_seeds"))
    too_many = F.raise_error(F.lit(f"over {MOST_SEEDS} seeds")).cast(listed.schema["_seeds"].dataType)
    return listed.select(F.when(F.size("_seeds") > MOST_SEEDS, too_many).otherwise(F.col("_seeds")).alias("_seeds"))


def seed_affinity(df: DataFrame, seeds: DataFrame, key: str, vector: str = "embedding", seed_key: str = "seed_id") -> DataFrame:
    """(key, seed, cosine): the nearest seed of every vector, the smaller one on ties; no row is shuffled."""
    n = norm(F.col("_v"))
    scored = F.transform("_seeds", lambda s: F.struct(
        F.coalesce(dot(F.col("_v"), s["centroid"]) / F.nullif(F.col("_n") * s["norm"], F.lit(0.0)), F.lit(0.0)).alias("cosine"), (-s["seed"]).alias("neg")))
    best = df.select(key, F.col(vector).alias("_v")).withColumn("_n", n).crossJoin(F.broadcast(_packed(seeds, seed_key))).select(key, F.array_max(scored).alias("_b"))
    return best.where("_b is not null").select(key, (-F.col("_b.neg")).alias("seed"), F.col("_b.cosine").alias("cosine"))


def guided(df: DataFrame, affinity: DataFrame, seeds: DataFrame, key: str, vector: str = "embedding", floor: float = 0.0, weight: float = 0.25, seed_key: str = "seed_id") -> DataFrame:
    """Pull every vector that has a seed over ``floor`` towards it: (1 - weight) of itself and ``weight`` of the seed."""
    chosen = F.element_at(F.filter("_seeds", lambda s: s["seed"] == F.col("seed")), 1)["centroid"]
    near = affinity.where(F.col("cosine") > floor).crossJoin(F.broadcast(_packed(seeds, seed_key))).select(key, chosen.alias("centroid"))
    pulled = F.zip_with(vector, "centroid", lambda x, c: x.cast("double") * (1 - weight) + c * weight)
    return df.join(near, key, "left").withColumn(vector, F.when(F.col("centroid").isNotNull(), pulled).otherwise(F.transform(vector, lambda x: x.cast("double")))).drop("centroid")


def _as_vectors(df: DataFrame, vector: str) -> DataFrame:
    plain = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return Normalizer(inputCol="_v", outputCol="_u", p=2.0).transform(plain)


def fit_projection(df: DataFrame, k: int = 2, vector: str = "embedding") -> PCAModel:
    return PCA(k=k, inputCol="_u", outputCol="_p").fit(_as_vectors(df, vector))


def project(df: DataFrame, key: str, k: int = 2, vector: str = "embedding", fitted: PCAModel | None = None) -> DataFrame:
    """(key, coordinates): principal components of the unit vectors; stands in for non-linear projections.  No vectors, no rows."""
    if fitted is None and df.where(F.col(vector).isNotNull()).isEmpty():
        return df.where(F.lit(False)).select(key, F.array().cast("array<double>").alias("coordinates"))
    model = fitted or fit_projection(df, k, vector)
    return model.transform(_as_vectors(df, vector)).select(key, vector_to_array("_p").alias("coordinates"))


def fit_clusters(df: DataFrame, k: int = 50, vector: str = "embedding", seed: int = 42) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="_u", predictionCol="topic").fit(_as_vectors(df, vector))


def cluster(df: DataFrame, key: str, k: int = 50, vector: str = "embedding", seed: int = 42, fitted: KMeansModel | None = None) -> DataFrame:
    """(key, topic): k-means of the unit vectors.  No vectors, no rows."""
    if fitted is None and df.where(F.col(vector).isNotNull()).isEmpty():
        return df.where(F.lit(False)).select(key, F.lit(0).alias("topic"))
    model = fitted or fit_clusters(df, k, vector, seed)
    return model.transform(_as_vectors(df, vector)).select(key, "topic")
