"""Calibration and learned models with Spark ML; fits are distributed, reports are tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.operators.quantiles import grouped_quantiles
from kickframe.session import cut_lineage


def fit_isotonic(df: DataFrame, prob: str, label: str, out: str = "p_cal", weight: str | None = None):
    """Monotone calibration curve; rows of equal probability collapse to one weighted row before the fit."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = F.sum(F.col(label) * w) / F.sum(F.when(F.col(label).isNotNull(), w)) if weight else F.avg(label)
    binned = df.groupBy(F.col(prob).cast("double").alias(prob)).agg(mean.alias(label), F.sum(w).alias("w"))
    return IsotonicRegression(featuresCol=prob, labelCol=label, weightCol="w", predictionCol=out).fit(binned)


def fit_platt(df: DataFrame, prob: str, label: str):
    """Logistic calibration on the probability, without a penalty."""
    va = VectorAssembler(inputCols=[prob], outputCol="_x")
    lr = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l", tol=1e-10, maxIter=200)
    return Pipeline(stages=[va, lr]).fit(df)


def apply_platt(model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_l")


def calibrate_three_way(early: DataFrame, df: DataFrame, probs: dict[str, str]) -> DataFrame:
    """Each class calibrated on the early rows, then applied and renormalised; probs[column] = label column."""
    for p, y in probs.items():
        df = apply_platt(fit_platt(early, p, y), df, f"{p}_one")
    total = sum((F.col(f"{p}_one") for p in probs), F.lit(0.0))
    return df.withColumns({f"{p}_cal": F.col(f"{p}_one") / total for p in probs})


def is_degenerate(model, prob: str, spark, limit: float = 0.01, points: int = 25) -> DataFrame:
    """Whether a calibrator is flat over (0, 1)."""
    grid = spark.range(points).select(((F.col("id") + 0.5) / points).alias(prob))
    out = model.getPredictionCol()
    return model.transform(grid).agg(F.stddev_pop(out).alias("spread")).withColumn("degenerate", F.col("spread") < limit)


def count_trees(df: DataFrame, features: Sequence[str], label: str, ts: str, share: float = 0.8, iters: int = 10) -> DataFrame:
    """Boosted trees for a count with a time split, RMSE and Poisson log likelihood of the later part.

    The split point is the exact quantile of time, from counted values; nothing is sorted globally.
    """
    cut = grouped_quantiles(df.select(F.unix_timestamp(F.col(ts).cast("timestamp")).alias("_at")), [], "_at", {"c": share}).first()[0]
    tagged = df.withColumn("_late", F.unix_timestamp(F.col(ts).cast("timestamp")) > cut)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=label, maxIter=iters, maxDepth=3, seed=7)])
    pred = model.fit(tagged.filter("NOT _late")).transform(tagged.filter("_late"))
    mu, y = F.greatest("prediction", F.lit(1e-6)), F.col(label)
    base = tagged.filter("NOT _late").agg(F.avg(label).alias("m")).select("m").scalar()
    return pred.agg(F.count(F.lit(1)).alias("rows"), F.sqrt(F.avg((mu - y) * (mu - y))).alias("rmse"), F.avg(y * F.ln(mu) - mu).alias("loglik"), F.sqrt(F.avg((y - base) * (y - base))).alias("rmse_mean"))


def ridge_combiner(early: DataFrame, df: DataFrame, groups: dict[str, Sequence[str]], label: str, reg: float = 1.0, prior: float = 120.0, min_rows: int = 80) -> DataFrame:
    """``df`` with ``mu``: base mean, ridge on z-scored group means, and a league shift, all learnt from the early rows.

    The ridge solves ``sum((y - base - z b)^2) / 2n + reg / 2 |b|^2`` from one aggregate of products (groups squared). Leagues
    with ``min_rows`` early rows are shifted by their mean residual, shrunk by ``n / (n + prior)``.
    """
    names = list(groups)
    means = {f"_g_{g}": sum((F.col(c).cast("double") for c in cols), F.lit(0.0)) / len(cols) for g, cols in groups.items()}
    early = early.withColumns(means)
    spread = early.agg(F.avg(label).alias("base"), *[F.avg(f"_g_{g}").alias(f"m_{g}") for g in names], *[F.stddev_pop(f"_g_{g}").alias(f"s_{g}") for g in names]).first()
    z = {g: (F.col(f"_g_{g}") - spread[f"m_{g}"]) / (spread[f"s_{g}"] or 1.0) for g in names}
    early = early.withColumns({f"_z_{g}": c for g, c in z.items()})
    got = early.agg(
        *[F.avg(F.col(f"_z_{g}") * F.col(f"_z_{h}")).alias(f"{i}_{j}") for i, g in enumerate(names) for j, h in enumerate(names)],
        *[F.avg(F.col(f"_z_{g}") * (F.col(label) - spread["base"])).alias(f"y_{i}") for i, g in enumerate(names)],
    ).first()
    k = range(len(names))
    b = np.linalg.solve(np.array([[got[f"{i}_{j}"] for j in k] for i in k]) + reg * np.eye(len(names)), np.array([got[f"y_{i}"] for i in k]))
    fitted = F.lit(float(spread["base"])) + sum((F.col(f"_z_{g}") * float(b[i]) for i, g in enumerate(names)), F.lit(0.0))
    res = early.withColumn("_global", fitted).groupBy("league").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(label) - F.col("_global")).alias("_r"))
    res = res.select("league", F.when(F.col("_n") >= min_rows, F.col("_r") * F.col("_n") / (F.col("_n") + prior)).otherwise(0.0).alias("_shift"))
    out = df.withColumns(means).withColumns({f"_z_{g}": c for g, c in z.items()}).withColumn("mu_global", fitted).join(res, "league", "left")
    out = out.withColumns({"league_shift": F.coalesce("_shift", F.lit(0.0)), **{f"pull_{g}": F.lit(float(reg * b[i])) for i, g in enumerate(names)}})
    return out.withColumn("mu", F.col("mu_global") + F.col("league_shift")).withColumnsRenamed({f"_z_{g}": f"z_{g}" for g in names}).drop("_shift", *[f"_g_{g}" for g in names])


def weighed_cells(sides: DataFrame, as_of: Column, tau_days: float = 180.0) -> DataFrame:
    """(team, opp, venue, rows, w, wy): weights exp(-age / tau) and weighted goals of all scored rows before ``as_of``, per pairing."""
    age = F.datediff(as_of, F.to_date("kickoff"))
    rows = sides.filter(F.col("gf").isNotNull() & (age > 0)).withColumn("_w", F.exp(-age / tau_days))
    return rows.groupBy("team", "opp", "venue").agg(F.count(F.lit(1)).alias("rows"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("gf")).alias("wy"))


def decayed_strengths(cells: DataFrame, tol: float = 1e-10, rounds: int = 500) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(team, attack), (opp, defence) and a factor per venue of a weighted Poisson model: mu = venue x attack x defence.

    Proportional fitting: each factor in turn becomes weighted goals over summed expectation, which zeroes the score
    equation of every team, every opponent and every venue, until nothing moves by more than ``tol`` of itself. A round is one join and
    one aggregate per side over the pairings; there are no columns per team. Not settling is an error. Goals of no team at
    all give strength 0. Strengths are scaled to mean defence 1 over the rows' weights.
    """
    cells = cut_lineage(cells)
    venue = {r["venue"]: 1.0 for r in cells.select("venue").distinct().collect()}  # two venues
    defence = cut_lineage(cells.select("opp").distinct().withColumn("defence", F.lit(1.0)))
    attack: DataFrame | None = None

    def at(v: dict[str, float]) -> Column:
        out = F.lit(1.0)
        for name, x in v.items():
            out = F.when(F.col("venue") == name, F.lit(float(x))).otherwise(out)
        return out

    def fitted(df: DataFrame, own: str, name: str, other: DataFrame, key: str, strength: str) -> DataFrame:
        met = df.join(other, key)
        return met.groupBy(own).agg(F.coalesce(F.try_divide(F.sum("wy"), F.sum(F.col("w") * at(venue) * F.col(strength))), F.lit(0.0)).alias(name))

    for _ in range(rounds):
        was = defence
        attack = cut_lineage(fitted(cells, "team", "attack", defence, "opp", "defence"))
        defence = cut_lineage(fitted(cells, "opp", "defence", attack, "team", "attack"))
        both = cells.join(attack, "team").join(defence, "opp")
        got = both.groupBy("venue").agg(F.sum("wy").alias("y"), F.sum(F.col("w") * at(venue) * F.col("attack") * F.col("defence")).alias("m")).collect()
        step = {r["venue"]: (r["y"] / r["m"] if r["m"] else 1.0) for r in got}
        moved = was.withColumnRenamed("defence", "_old").join(defence, "opp").agg(F.max(F.abs(F.coalesce(F.try_divide(F.col("defence"), F.col("_old")), F.lit(1.0)) - 1.0)).alias("m")).first()["m"] or 0.0
        venue = {v: x * step.get(v, 1.0) for v, x in venue.items()}
        if max([moved, *[abs(x - 1.0) for x in step.values()]]) < tol:
            break
    else:
        raise RuntimeError("strengths did not settle; give more rounds")
    scale = cells.join(defence, "opp").agg((F.sum(F.col("w") * F.col("defence")) / F.sum("w")).alias("s")).first()["s"] or 1.0
    return attack.withColumn("attack", F.col("attack") * scale), defence.withColumn("defence", F.col("defence") / scale), venue


def strength_means(rows: DataFrame, attack: DataFrame, defence: DataFrame, venue: dict[str, float]) -> DataFrame:
    """``rows`` with ``mu`` of the fitted strengths; a team that was never seen counts as an average one."""
    mean = lambda df, c: df.agg(F.avg(c)).first()[0] or 0.0
    a, d = mean(attack, "attack"), mean(defence, "defence")
    factor = F.lit(1.0)
    for name, x in venue.items():
        factor = F.when(F.col("venue") == name, F.lit(float(x))).otherwise(factor)
    out = rows.join(attack, "team", "left").join(defence, "opp", "left")
    return out.withColumn("mu", factor * F.coalesce("attack", F.lit(a)) * F.coalesce("defence", F.lit(d)))


#: Bins of a numeric feature: as many as Spark's trees make of one.
BINS = 32
#: Rows of a table that goes to every task.
CELLS = 200_000


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS, points: int = 4096) -> dict[str, list[float]]:
    """Borders that part each column into at most ``bins`` bins: between all values of one with few, else at quantiles of all rows."""
    sketch = [F.percentile_approx(F.col(c).cast("double"), [i / points for i in range(points + 1)], 10_000).alias(c) for c in columns]
    got, out = df.agg(*sketch).first(), {}
    for c in columns:
        at = np.array(got[c] or [], float)
        values = np.unique(at[~np.isnan(at)])
        few = len(values) <= bins
        out[c] = ((values[1:] + values[:-1]) / 2 if few else np.unique(at[[round(i * points / bins) for i in range(1, bins)]])).tolist()
    return out


def in_bin(c: str, edges: Sequence[float]) -> Column:
    """Number of the bin of a value; null and NaN stay."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), x).otherwise(sum(((x > e).cast("double") for e in edges), x * 0.0))


def shot_classifier(early: DataFrame, middle: DataFrame, df: DataFrame, numeric: Sequence[str], categories: Sequence[str], label: str, iters: int = 10) -> DataFrame:
    """Goal probability of a shot from geometry and one-hot labels: trees on the early rows, isotonic curve on the middle ones.

    Trees split a number between its bins only, so rows that agree in bins, categories and label are one cell weighing as
    many rows: every row counts, in one pass, and the rounds of the fit run over cells. All rows of a cell have one score.
    """
    edges = bin_edges(early, numeric)
    bins = {f"_b_{c}": in_bin(c, e) for c, e in edges.items()}
    keys = [*bins, *categories]
    cells = lambda d: d.withColumns(bins).groupBy(*keys, label).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    learnt = cut_lineage(cells(early))
    labels = [[r[0] for r in learnt.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("c")).agg(F.sum("_w").alias("n")).orderBy(F.desc("n"), "c").collect()] for c in categories]  # as StringIndexer
    idx = StringIndexerModel.from_arrays_of_labels(labels, inputCols=list(categories), outputCols=[f"_i_{c}" for c in categories], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_h_{c}" for c in categories])
    va = VectorAssembler(inputCols=[*bins, *[f"_h_{c}" for c in categories]], outputCol="_x")
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=iters, maxDepth=3, seed=7)
    trees = Pipeline(stages=[idx, hot, va, gbt]).fit(learnt)
    raw = lambda d: trees.transform(d).withColumn("p_raw", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction", *[f"_{k}_{c}" for k in "ih" for c in categories])
    curve = fit_isotonic(raw(cut_lineage(cells(middle))), "p_raw", label, "p_goal", "_w")
    asked = df.withColumns(bins)
    scored = cut_lineage(curve.transform(raw(asked.select(*keys).distinct())).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "p_raw", "p_goal"))
    if scored.count() <= CELLS:
        scored = F.broadcast(scored)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return asked.join(scored, same).select(*df.columns, "p_raw", "p_goal")


def line_classifier(df: DataFrame, features: Sequence[str], count: Column, line: float, late: Column, iters: int = 10) -> DataFrame:
    """Accuracy, area under the curve and base rate of an over-line classifier on the later rows."""
    d = df.withColumns({"_y": (count > line).cast("double"), "_late": late})
    va = VectorAssembler(inputCols=list(features), outputCol="_x")
    gbt = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=iters, maxDepth=3, seed=7)
    pred = Pipeline(stages=[va, gbt]).fit(d.filter("NOT _late")).transform(d.filter("_late"))
    auc = BinaryClassificationEvaluator(labelCol="_y").evaluate(pred)
    return pred.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy"), F.lit(float(auc)).alias("auc"), F.avg("_y").alias("base_rate"))


def select_features(df: DataFrame, features: Sequence[str], min_var: float = 1e-6, max_corr: float = 0.95) -> DataFrame:
    """Features with enough variance, one per group of rank-correlated ones (the first listed stays)."""
    spread = df.agg(*[F.var_samp(c).alias(c) for c in features]).first()
    alive = [c for c in features if (spread[c] or 0.0) > min_var]
    x = VectorAssembler(inputCols=alive, outputCol="_x", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double").alias(c) for c in alive]))
    corr = Correlation.corr(x, "_x", "spearman").first()[0].toArray()
    kept: list[str] = []
    for i, c in enumerate(alive):
        if all(abs(corr[i, alive.index(k)]) < max_corr for k in kept):
            kept.append(c)
    rows = [(c, float(spread[c] or 0.0), c in kept) for c in features]
    return df.sparkSession.createDataFrame(rows, "feature string, variance double, kept boolean")


#: Settings tried for each model of the ensemble.
GRIDS = {"rf": {"maxDepth": [3, 5]}, "gbt": {"maxDepth": [2, 3]}, "lr": {"regParam": [0.0, 0.1]}}


def ensemble(early: DataFrame, df: DataFrame, features: Sequence[str], label: str, folds: int = 2, grids: dict[str, dict[str, list]] | None = None) -> DataFrame:
    """Forest, boosted trees and logistic regression, each cross-validated on the early rows; ``df`` with their mean probability."""
    va = VectorAssembler(inputCols=list(features), outputCol="_x")
    base = va.transform(early.withColumn("_y", F.col(label).cast("double")))
    args = {"featuresCol": "_x", "labelCol": "_y"}
    kinds = {"rf": RandomForestClassifier(numTrees=10, seed=7, **args), "gbt": GBTClassifier(maxIter=5, seed=7, **args), "lr": LogisticRegression(**args)}
    judge = BinaryClassificationEvaluator(labelCol="_y")
    out = va.transform(df)
    for name, est in kinds.items():
        grid = ParamGridBuilder()
        for param, values in (grids or GRIDS)[name].items():
            grid = grid.addGrid(est.getParam(param), values)
        best = CrossValidator(estimator=est, estimatorParamMaps=grid.build(), evaluator=judge, numFolds=folds, seed=7).fit(base).bestModel
        best.setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_r_{name}").setPredictionCol(f"_l_{name}")
        out = best.transform(out)
    ps = [vector_to_array(f"_p_{n}")[1] for n in kinds]
    return out.withColumn("p", sum(ps, F.lit(0.0)) / len(ps)).drop("_x", *[f"_{k}_{n}" for n in kinds for k in "prl"])
