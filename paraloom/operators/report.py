"""A Markdown summary of computed facts; sections without data are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO_LIMIT = 1.1


def _top(df: DataFrame, by: str, n: int, *ties: str):
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n).collect()


def summary(significance: DataFrame | None = None, coherence: DataFrame | None = None, similarity: DataFrame | None = None,
            shift: DataFrame | None = None, spikes: DataFrame | None = None, volatility: DataFrame | None = None) -> str:
    """At most five rows of each table reach the driver."""
    out = ["# Summary"]
    if significance is not None:
        n, k = significance.agg(F.count(F.lit(1)), F.count_if("significant")).first()
        out += ["", "## Significance", f"{k} of {n} topics differ significantly between the groups."]
        out += [f"- topic {r['topic']}: p = {r['p_value']:.4f}" for r in significance.orderBy("p_value", "topic").limit(5).collect()]
    if coherence is not None:
        out += ["", "## Coherence"]
        out += [f"- mean {r['measure']}: {r['mean']:.4f}" for r in coherence.groupBy("measure").agg(F.avg("score").alias("mean")).where("mean is not null").orderBy("measure").collect()]
        out += [f"- topic {r['topic']}: {r['score']:.4f}" for r in _top(coherence.where("measure = 'c_v' and score is not null"), "score", 5, "topic")]
    row = similarity.first() if similarity is not None else None
    if row is not None:
        a, b, between = row[0], row[1], row["between"]
        ratio = ((a + b) / 2) / between if between > 0 else float("inf")
        out += ["", "## Similarity", f"- within: {a:.4f} and {b:.4f}", f"- between: {between:.4f}", f"- ratio: {ratio:.2f}",
                "- the groups differ in content" if ratio > RATIO_LIMIT else "- the groups are alike in content"]
    for title, df, by, n in (("Largest differences", shift, "difference", 5), ("Spikes", spikes, "z", 5), ("Most volatile periods", volatility, "volatility", 3)):
        if df is None:
            continue
        key = "label" if "label" in df.columns else "topic" if "topic" in df.columns else "period"
        out += ["", f"## {title}"]
        out += [f"- {r[key]}" + (f", {r['period']}" if key != "period" and "period" in df.columns else "") + f": {r[by]:.4f}" for r in _top(df, by, n, key)]
    return "\n".join(out)
