"""Feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posteria.functions.shape import melt, named
from posteria.operators.evaluation import auc
from posteria.operators.sampling import kfold
from posteria.operators.sets import concat


def variance_filter(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (feature, variance, kept); constant features are not kept."""
    stats = melt(df, [], cols).groupBy("place").agg(
        F.var_pop("v").alias("variance"), (F.max("v") > F.min("v")).alias("varied")
    )
    kept = F.coalesce(F.col("varied") & (F.col("variance") > 0), F.lit(False))
    return stats.select(named("place", cols).alias("feature"), "variance", kept.alias("kept"))


def f_score(df: DataFrame, feats: Sequence[str], target: str) -> DataFrame:
    """Rows (feature, score): F statistic of a linear regression on each feature."""
    stats = melt(df, [F.col(target).alias("y")], feats).groupBy("place").agg(
        F.count(F.lit(1)).alias("n"), F.corr("v", "y").alias("r")
    )
    r = F.col("r")
    return stats.select(
        named("place", feats).alias("feature"), (F.try_divide(r * r, 1.0 - r * r) * (F.col("n") - 2)).alias("score")
    )


def _limits(df: DataFrame, cols: Sequence[str]) -> tuple[Column, Column]:
    """Literal arrays with the minimum and maximum of every column."""
    ends = {
        r["place"]: (r["lo"], r["hi"])
        for r in melt(df, [], cols).groupBy("place").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    }
    pick = lambda side: F.array(*[F.lit(ends.get(i, (None, None))[side]).cast("double") for i in range(len(cols))])
    return pick(0), pick(1)


def mutual_information(df: DataFrame, feats: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Rows (feature, score): mutual information in nats on equal-width bins.

    Features and a numeric target are cut into ``bins``; a text target is used
    as it is. After the map-side count there are at most bins x labels rows
    per feature.
    """
    text = df.schema[target].dataType.typeName() == "string"
    names = [*feats] + ([] if text else [target])
    lows, highs = _limits(df, names)

    def cell(value: Column, place: Column) -> Column:
        low, high = F.get(lows, place), F.get(highs, place)
        inside = F.floor((value - low) / (high - low) * F.lit(float(bins)))
        return F.when(high > low, F.least(inside, F.lit(bins - 1))).when(value.isNotNull(), F.lit(0))

    label = F.col(target) if text else cell(F.col(target).cast("double"), F.lit(len(feats)))
    joint = (
        melt(df.withColumn("_y", label), ["_y"], feats)
        .withColumn("x", cell(F.col("v"), F.col("place")))
        .filter(F.col("x").isNotNull() & F.col("_y").isNotNull())
        .groupBy("place", "x", F.col("_y").alias("y"))
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    over = lambda *by: F.sum("c").over(Window.partitionBy(*by))
    parts = joint.select(
        "place", "c", over("place").alias("n"), over("place", "x").alias("cx"), over("place", "y").alias("cy")
    )
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    scores = parts.groupBy("place").agg(F.sum(term).alias("score"))
    return scores.select(named("place", feats).alias("feature"), "score")


def select_k(scores: DataFrame, n_features: int, k: int | None = None) -> DataFrame:
    """The k best features, by default two thirds of them."""
    k = 2 * n_features // 3 if k is None else k
    return scores.orderBy(F.col("score").desc_nulls_last(), "feature").limit(k).select("feature")


def union_selected(df: DataFrame, feats: Sequence[str], targets: Sequence[str], bins: int = 10) -> DataFrame:
    """Features chosen by either test for any target but the last."""
    chosen = None
    for t in list(targets)[:-1]:
        for scores in (f_score(df, feats, t), mutual_information(df, feats, t, bins)):
            best = select_k(scores, len(feats))
            chosen = best if chosen is None else chosen.unionByName(best)
    if chosen is None:
        raise ValueError("needs at least two targets")
    return chosen.distinct()


def rfe_cv(
    df: DataFrame, key: str | Sequence[str], feats: Sequence[str], label: str, folds: int = 5, step: int = 1,
    least: int = 1, trees: int = 32, depth: int = 5, seed: int = 42,
) -> DataFrame:
    """Recursive elimination by forest importance, scored by cross-validated AUC.

    ``label`` is 0/1. Rows (n_features, mean_auc, std_auc, features, dropped,
    best): one per set size. Features are eliminated anew on the training rows
    of every fold, so the rows that score a set had no say in it; ``features``
    is the set that all rows together leave at that size. Every fit and score
    is a Spark job.
    """
    keys = [key] if isinstance(key, str) else list(key)
    folded = kfold(df.select(*keys, label, *feats), keys, folds, 1, label, seed).drop("repeat").persist()

    def eliminate(rows: DataFrame, held: DataFrame | None):
        """(features, dropped, scored held-out rows) for falling set sizes."""
        left = list(feats)
        while True:
            assembler = VectorAssembler(inputCols=left, outputCol="_x", handleInvalid="keep")
            forest = RandomForestClassifier(
                featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False
            )
            model = forest.fit(assembler.transform(rows))
            scored = None
            if held is not None:
                score = vector_to_array("probability")[1].alias("score")
                scored = model.transform(assembler.transform(held)).select("fold", label, score)
            weights = model.featureImportances.toArray()
            ranked = [c for _, c in sorted(zip(weights, left), key=lambda t: (t[0], t[1]))]
            drop = ranked[: max(min(step, len(left) - least), 0)]
            yield list(left), drop, scored
            if not drop:
                return
            left = [c for c in left if c not in drop]

    paths = [list(eliminate(folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f))) for f in range(folds)]
    out = []
    for place, (left, drop, _) in enumerate(eliminate(folded, None)):
        scored = concat([path[place][2] for path in paths])
        areas = [r["auc"] for r in auc(scored, label, "score", ["fold"]).collect() if r["auc"] is not None]
        mean = sum(areas) / len(areas)
        std = (sum((a - mean) ** 2 for a in areas) / len(areas)) ** 0.5
        out.append((len(left), float(mean), float(std), left, drop))
    folded.unpersist()
    best = max(out, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in out],
        "n_features int, mean_auc double, std_auc double, features array<string>, dropped array<string>, best boolean",
    )
