"""Default models on Spark ML, their interpretation and their validation."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.functions.buckets import risk_band
from loanweave.functions.keys import case_id
from loanweave.functions.numeric import logit
from loanweave.operators import evaluation as ev
from loanweave.operators import features as ft
from loanweave.operators import many_fits
from loanweave.operators.drift import rank_stability
from loanweave.session import settle

LABEL, ID = "y", "id"


# --- fitting ---------------------------------------------------------------------------


def preprocessing(features: Sequence[str]) -> list:
    """Median imputation and standardisation."""
    filled = [f"{f}__filled" for f in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled,
                relativeError=0.001),
        VectorAssembler(inputCols=filled, outputCol="_vector", handleInvalid="keep"),
        StandardScaler(inputCol="_vector", outputCol="features", withMean=True, withStd=True),
    ]


def estimator(kind: str, n_rows: int, strength: float = 1.0, weight: str | None = None):
    """`strength` is the inverse regularisation of the logistic model."""
    extra = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        return LogisticRegression(labelCol=LABEL, regParam=1.0 / (strength * max(n_rows, 1)),
                                  elasticNetParam=0.0, standardization=False, maxIter=200, **extra)
    if kind == "boosted":
        return GBTClassifier(labelCol=LABEL, maxDepth=3, maxIter=20, stepSize=0.1, seed=7, **extra)
    raise ValueError(f"unknown model {kind!r}")


def fit(train: DataFrame, features: Sequence[str], kind: str = "logistic",
        strength: float = 1.0, weight: str | None = None) -> PipelineModel:
    ft.check_training_columns(features, LABEL, (ID,), features)
    n = train.count()
    return Pipeline(stages=[*preprocessing(features), estimator(kind, n, strength, weight)]).fit(
        train)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = (ID, LABEL)) -> DataFrame:
    """Kept columns and p, the probability of default."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias("p"))


def score_batch(model: PipelineModel, df: DataFrame, ident: str, version: str,
                cuts: Sequence[float] = (0.1, 0.25, 0.5)) -> DataFrame:
    """Pseudonymous scores with risk band and version; never the raw id."""
    return score(model, df, [ident]).select(
        case_id(ident).alias("record"), "p", risk_band("p", cuts).alias("risk_band"),
        F.lit(version).alias("model_version"),
    )


def prior_scores(train: DataFrame, df: DataFrame) -> DataFrame:
    """Baseline: everyone gets the prevalence of the training rows."""
    rate = float(train.agg(F.avg(F.col(LABEL).cast("double"))).first()[0])
    return df.select(ID, LABEL, F.lit(rate).alias("p"))


def rule_scores(train: DataFrame, df: DataFrame, feature: str) -> DataFrame:
    """Baseline: monotone fit on one feature. Equal values are pooled before the fit."""
    pooled = train.groupBy(F.col(feature).alias("_f")).agg(
        F.avg(F.col(LABEL).cast("double")).alias("label"),
        F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="_f", labelCol="label", weightCol="weight",
                               predictionCol="p").fit(pooled)
    return model.transform(df.withColumn("_f", F.col(feature).cast("double"))).select(
        ID, LABEL, "p")


def grid_search(train: DataFrame, features: Sequence[str], strengths: Sequence[float],
                k: int = 3) -> tuple[float, DataFrame]:
    """Best inverse regularisation by cross-validated average precision."""
    n = train.count()
    prepared = Pipeline(stages=preprocessing(features)).fit(train).transform(train)
    folded = ft.folds(prepared, ID, LABEL, k).select(ID, LABEL, "features", "fold")
    lr = LogisticRegression(labelCol=LABEL, elasticNetParam=0.0, standardization=False)
    regs = [1.0 / (s * max(n, 1)) for s in strengths]
    grid = ParamGridBuilder().addGrid(lr.regParam, regs).build()
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=grid, numFolds=k, foldCol="fold", parallelism=2,
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderPR"),
    ).fit(folded)
    rows = [(float(s), float(m)) for s, m in zip(strengths, cv.avgMetrics)]
    best = max(rows, key=lambda r: r[1])[0]
    table = train.sparkSession.createDataFrame(rows, "strength double, average_precision double")
    return best, table


# --- calibration -----------------------------------------------------------------------

BRIER_GAIN = 1e-4


def calibrated(train_scores: DataFrame, df: DataFrame, method: str) -> DataFrame:
    """Scores mapped by a calibrator that was fitted on the training scores."""
    if method == "none":
        return df.select(ID, LABEL, "p")
    if method == "sigmoid":
        def lifted(x: DataFrame) -> DataFrame:
            return VectorAssembler(inputCols=["_z"], outputCol="_v").transform(
                x.withColumn("_z", logit("p")))

        model = LogisticRegression(featuresCol="_v", labelCol=LABEL, regParam=0.0,
                                   probabilityCol="_p", rawPredictionCol="_r",
                                   predictionCol="_c").fit(lifted(train_scores))
        return model.transform(lifted(df)).select(ID, LABEL, vector_to_array("_p")[1].alias("p"))
    if method == "isotonic":
        pooled = train_scores.groupBy("p").agg(
            F.avg(F.col(LABEL).cast("double")).alias("label"),
            F.count(F.lit(1)).cast("double").alias("weight"))
        model = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight",
                                   predictionCol="_p").fit(pooled)
        return model.transform(df).select(ID, LABEL, F.col("_p").alias("p"))
    raise ValueError(f"unknown calibrator {method!r}")


def choose_calibrator(train_scores: DataFrame, validation: DataFrame,
                      methods: Sequence[str] = ("none", "sigmoid", "isotonic")) -> DataFrame:
    """Brier and ECE per method and which one is kept: a method must improve the Brier score
    by 1e-4 without a worse calibration error."""
    parts = []
    for m in methods:
        s = calibrated(train_scores, validation, m)
        b, e = ev.calibration_errors(s), ev.ece_equal_width(s)
        parts.append(ev._join(b, e, []).select(F.lit(m).alias("method"), "brier_score",
                                               "log_loss", "ece"))
    rows = reduce(lambda a, b: a.unionByName(b), parts).collect()
    none = next(r for r in rows if r["method"] == "none")
    best = min(rows, key=lambda r: r["brier_score"])
    better = (best["brier_score"] < none["brier_score"] - BRIER_GAIN
              and best["ece"] <= none["ece"])
    kept = best["method"] if better else "none"
    return validation.sparkSession.createDataFrame(
        [(r["method"], r["brier_score"], r["log_loss"], r["ece"], r["method"] == kept)
         for r in rows],
        "method string, brier_score double, log_loss double, ece double, selected boolean")


# --- interpretation --------------------------------------------------------------------


def coefficients(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Coefficients and odds ratios in standardised units, by size."""
    values = [float(v) for v in model.stages[-1].coefficients]
    rows = [(f, v, math.exp(v), i + 1) for i, (f, v) in enumerate(
        sorted(zip(features, values), key=lambda r: -abs(r[1])))]
    return spark.createDataFrame(
        rows, "feature string, coefficient double, odds_ratio double, rank int")


def reason_codes(model: PipelineModel, df: DataFrame, features: Sequence[str],
                 tiers: Mapping[str, str], k: int = 3) -> DataFrame:
    """Top k contributions (coefficient x standardised value) per row among the features
    whose tier is allowed or conditional; one row per case and rank."""
    weights = [float(v) for v in model.stages[-1].coefficients]
    z = vector_to_array("features")
    pairs = F.array(*[
        F.struct((-F.abs(w * z[i])).alias("order"), F.lit(f).alias("feature"),
                 (z[i] * w).alias("contribution"), F.lit(tiers[f]).alias("tier"))
        for i, (f, w) in enumerate(zip(features, weights))
        if tiers.get(f) in ("allowed", "conditional")
    ])
    top = F.slice(F.array_sort(pairs), 1, k)
    return model.transform(df).select(case_id(ID).alias("case"), F.posexplode(top)).select(
        "case", (F.col("pos") + 1).alias("rank"), "col.feature", "col.contribution", "col.tier")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str],
                           repeats: int = 3) -> DataFrame:
    """Mean and spread of the loss in average precision when one feature is shuffled."""
    base = ev.discrimination(score(model, df)).first()["pr_auc"]
    # Features share one hash order per repeat; each shuffled copy is scored and tagged.
    moved = settle(reduce(lambda a, b: a.unionByName(b), [
        score(model, ft.shuffle_column(df, ID, f, 100 + r)).withColumns(
            {"feature": F.lit(f), "repeat": F.lit(r)})
        for f in features for r in range(repeats)
    ]))
    per = ev.discrimination(moved, ["feature", "repeat"])
    return per.withColumn("drop", F.lit(base) - F.col("pr_auc")).groupBy("feature").agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("spread"))


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, points: int = 20
                       ) -> DataFrame:
    """Average score with the feature set to each value of an even grid."""
    lo, hi = df.agg(F.min(feature), F.max(feature)).first()
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    grid = F.explode(F.array(*[F.lit(float(lo + i * step)) for i in range(points)]))
    copies = df.drop(feature).withColumn(feature, grid)
    return score(model, copies, [feature]).groupBy(F.col(feature).alias("value")).agg(
        F.avg("p").alias("average_score")).select(F.lit(feature).alias("feature"), "value",
                                                  "average_score")


def representative_cases(scored: DataFrame, threshold: float) -> DataFrame:
    """Extreme hits and misses, the highest, lowest and median score, as pseudonyms."""
    hit, y = F.col("p") >= threshold, F.col(LABEL) == 1
    up, down = F.struct("p", F.col(ID)), F.struct(-F.col("p"), F.col(ID))

    def top(when: Column, order: Column) -> Column:
        return F.max_by(F.struct(ID, "p"), F.when(when, order))

    yes = F.lit(True)
    picks = {
        "true_positive": top(hit & y, up), "false_positive": top(hit & ~y, up),
        "true_negative": top(~hit & ~y, down), "false_negative": top(~hit & y, down),
        "highest": top(yes, up), "lowest": top(yes, down),
    }
    wide = scored.agg(*[c.alias(n) for n, c in picks.items()])
    extremes = wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("kind"), F.col(n).alias("c")) for n in picks])).alias("r")
    ).select("r.kind", F.col(f"r.c.{ID}").alias(ID), F.col("r.c.p").alias("p"))
    placed = ft.positions(scored, [], "p", ID, "_pos", "_size")
    middle = placed.filter(F.col("_pos") == F.floor(F.col("_size") / 2) + 1).select(
        F.lit("median").alias("kind"), ID, "p")
    return extremes.unionByName(middle).filter(F.col(ID).isNotNull()).select(
        "kind", case_id(ID).alias("case"), "p")


# --- collinearity ----------------------------------------------------------------------


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """k x k Pearson matrix from one distributed pass; only the matrix reaches the driver."""
    v = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip")
    return Correlation.corr(v.transform(df), "_v").first()[0].toArray()


def correlated_pairs(df: DataFrame, features: Sequence[str], least: float) -> DataFrame:
    """Pairs with |r| at or above `least`, all pairs in one aggregate."""
    names = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(names)])
    tidy = wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(names)])).alias("c")).select("c.*")
    return tidy.filter(F.abs("r") >= least)


def _vif(corr: np.ndarray) -> list[float]:
    """Diagonal of the inverse correlation matrix; infinite for exact linear dependence."""
    out = []
    k = corr.shape[0]
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        if not rest:
            out.append(1.0)
            continue
        block, cross = corr[np.ix_(rest, rest)], corr[rest, i]
        weights, *_ = np.linalg.lstsq(block, cross, rcond=1e-10)
        r2 = float(cross @ weights)
        out.append(math.inf if r2 >= 1 - 1e-9 else 1.0 / (1.0 - r2))
    return out


def vif_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = list(zip(features, _vif(correlation_matrix(df, features))))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def condition_number(df: DataFrame, features: Sequence[str]) -> float:
    """Ratio of the singular values of the standardised columns."""
    eig = np.linalg.eigvalsh(correlation_matrix(df, features))
    return math.inf if eig[0] <= 1e-12 else math.sqrt(eig[-1] / eig[0])


def reduce_by_vif(df: DataFrame, features: Sequence[str], limit: float = 10.0, keep: int = 6
                  ) -> DataFrame:
    """Drops the worst feature until all are below the limit or `keep` are left; the data is
    read once, the loop runs on the k x k matrix."""
    corr = correlation_matrix(df, features)
    left, rows, step = list(range(len(features))), [], 0
    while len(left) > keep:
        values = _vif(corr[np.ix_(left, left)])
        worst = max(range(len(left)), key=lambda i: values[i])
        if values[worst] < limit:
            break
        step += 1
        rows.append((features[left[worst]], step, float(values[worst])))
        left.pop(worst)
    final = _vif(corr[np.ix_(left, left)])
    rows += [(features[j], 0, float(v)) for j, v in zip(left, final)]
    return df.sparkSession.createDataFrame(rows, "feature string, removed_at int, vif double")


# --- stability -------------------------------------------------------------------------


def split_stability(df: DataFrame, features: Sequence[str], seeds: Sequence[int],
                    shares: Mapping[str, float] | None = None) -> DataFrame:
    """Refit on several splits: mean and sample spread of the test metrics."""
    shares = shares or {"train": 0.6, "validation": 0.2, "test": 0.2}
    scored = []
    for seed in seeds:
        split = settle(ft.stratified_split(df, ID, LABEL, shares, seed))
        model = fit(split.filter(F.col("split") == "train"), features)
        scored.append(score(model, split.filter(F.col("split") == "test")).withColumn(
            "seed", F.lit(seed)))
    together = settle(reduce(lambda a, b: a.unionByName(b), scored))
    wide = ev.discrimination(together, ["seed"]).join(
        ev.calibration_errors(together, ["seed"]), "seed")
    tidy = wide.select("seed", "roc_auc", "pr_auc", "brier_score").unpivot(
        ["seed"], ["roc_auc", "pr_auc", "brier_score"], "metric", "value")
    return tidy.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("fits"))


def _matrix(train: DataFrame, features: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """Imputation and scaling fitted on the training rows, and the rows as x, h, y, id."""
    made = Pipeline(stages=preprocessing(features)).fit(train)
    return made, many_fits.prepared(made.transform(train), ID, LABEL)


def coefficient_stability(
    train: DataFrame, features: Sequence[str], replicates: int = 200, k: int = 5,
    strengths: Sequence[float] = (0.01, 0.1, 1.0, 10.0), flip_limit: float = 0.05,
    vif_limit: float = 10.0, small: tuple[float, float] = (0.95, 1.05),
) -> DataFrame:
    """Sign flips over bootstrap weights, folds and regularisation, and a class per feature.

    All fits run together, a pass over the rows for each Newton step. Missing values have the
    medians of the training rows in every fit; scaling is that of the fit's own rows.
    """
    spark = train.sparkSession
    base = fit(train, features)
    _, rows = _matrix(train, features)
    folded = settle(rows.join(ft.folds(train, ID, LABEL, k).select(F.col(ID).alias("id"), "fold"), "id"))
    numbers = np.arange(replicates)

    def draw(h: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.concatenate([
            many_fits.poisson_weights(h, numbers, 31),
            (fold[:, None] != np.arange(k)[None, :]).astype(np.float64),
            np.ones((len(h), len(strengths)))], axis=1)
        return w, np.broadcast_to(y[:, None], w.shape)

    force = np.array([1.0] * (replicates + k) + [float(s) for s in strengths])
    found = many_fits.fit_many(folded, ["h", "y", "fold"], draw, force).coefficients
    source = ["bootstrap"] * replicates + ["cv"] * k + ["grid"] * len(strengths)
    rows = [(s, i, f, float(v)) for i, (s, line) in enumerate(zip(source, found)) for f, v in zip(features, line)]
    fits = spark.createDataFrame(rows, "source string, run int, feature string, value double")
    c = F.col
    original = coefficients(base, features, spark).join(vif_table(train, features), "feature")
    sign = F.when(c("coefficient") >= 0, 1.0).otherwise(-1.0)
    flips = fits.join(original, "feature").withColumn(
        "flip", (F.when(c("value") == 0, sign).otherwise(F.signum("value")) != sign)
        .cast("double"))

    def rate(source: str) -> Column:
        return F.avg(F.when(c("source") == source, c("flip")))

    per = flips.groupBy("feature").agg(
        rate("bootstrap").alias("bootstrap_flip_rate"), rate("cv").alias("cv_flip_rate"),
        (F.min(F.when(c("source") == "grid", c("flip")))
         != F.max(F.when(c("source") == "grid", c("flip")))).alias("grid_sign_changes"))
    label = (
        F.when(c("bootstrap_flip_rate") > flip_limit, "unstable_direction")
        .when(c("vif") >= vif_limit, "redundant")
        .when(c("grid_sign_changes"), "sensitive_to_regularization")
        .when(c("odds_ratio").between(*small), "low_magnitude")
        .when((c("bootstrap_flip_rate") > 0) | (c("cv_flip_rate") > 0),
              "not_interpretable_individually")
        .otherwise("stable_direction"))
    return original.join(per, "feature").withColumn("category", label)


def retrain_null(df: DataFrame, features: Sequence[str], fits: int = 100, seed: int = 1000) -> DataFrame:
    """Refits on shuffled targets: what the test AUC looks like when nothing can be learned.

    A shuffle hands the positives to the training rows with the smallest hashes, exactly as many
    as there are. All fits run together, the real one among them.
    """
    split = settle(ft.stratified_split(df, ID, LABEL, {"train": 0.7, "test": 0.3}))
    train, test = (split.filter(F.col("split") == s) for s in ("train", "test"))
    made, rows = _matrix(train, features)
    positives = int(rows.agg(F.sum("y")).first()[0] or 0)
    numbers = np.arange(fits)
    cuts = many_fits.label_cuts(rows, positives, fits, seed)

    def draw(h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shuffled = many_fits.hashes(h, numbers, seed) <= cuts[None, :]
        labels = np.concatenate([shuffled.astype(np.float64), y[:, None]], axis=1)
        return np.ones(labels.shape), labels

    weights = many_fits.fit_many(rows, ["h", "y"], draw, np.ones(fits + 1)).weights
    tested = many_fits.prepared(made.transform(test), ID, LABEL)
    lines = F.array(*[F.struct(F.lit(i).alias("fit"), F.lit(float(w[0])).alias("start"),
                               F.array(*[F.lit(float(v)) for v in w[1:]]).alias("w"))
                      for i, w in enumerate(weights)])
    z = F.col("e.start") + F.aggregate(F.zip_with("x", "e.w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = tested.withColumn("e", F.explode(lines)).select(
        F.col("e.fit").alias("fit"), "y", (1 / (1 + F.exp(-z))).alias("p"))
    found = settle(ev.discrimination(scored, ["fit"]))
    real = found.where(F.col("fit") == fits).select(F.col("roc_auc").alias("real_auc"))
    c = F.col
    null = ev.with_one_row(found.where(c("fit") < fits).select("roc_auc"), real)
    return null.agg(
        F.max("real_auc").alias("real_auc"), F.count("roc_auc").alias("fits"),
        F.avg("roc_auc").alias("null_mean"), F.stddev_samp("roc_auc").alias("null_std"),
        ((F.count_if(c("roc_auc") >= c("real_auc")) + 1) / (F.count("roc_auc") + 1)).alias("p_value"))


def stress_suite(model: PipelineModel, raw: DataFrame, features: Sequence[str],
                 edits: Mapping[str, float], engineer: Callable[[DataFrame], DataFrame]
                 ) -> DataFrame:
    """Metrics after each stress edit and the rank agreement with the unedited scores."""
    keys = ["edit", "strength"]
    clean = score(model, engineer(raw)).select(ID, F.col("p").alias("p0"))
    edited = settle(reduce(lambda a, b: a.unionByName(b), [
        score(model, engineer(ft.perturb(raw, kind, ID, strength, LABEL))).withColumns(
            {"edit": F.lit(kind), "strength": F.lit(float(strength))})
        for kind, strength in edits.items()
    ]).join(clean, ID))
    wide = ev.discrimination(edited, keys).join(ev.calibration_errors(edited, keys), keys)
    rank = rank_stability(edited, "p", "p0", keys)
    return wide.join(rank, keys).select(*keys, "n", "roc_auc", "pr_auc", "brier_score",
                                        "rank_stability")


# --- comparison and gates --------------------------------------------------------------


def compare_models(scores: Mapping[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """One row per axis: every model's value, and the better model where an order exists."""
    # All models are measured together, grouped by model.
    together = settle(reduce(lambda a, b: a.unionByName(b), [
        df.select(ID, LABEL, "p", F.lit(n).alias("model")) for n, df in scores.items()]))
    tidy = ev.all_metrics(together, threshold, ["model"])
    lower = F.col("metric").isin("brier_score", "log_loss", "ece")
    best = tidy.filter(~F.col("metric").isin("prevalence", "calibration_intercept",
                                             "calibration_slope")).groupBy("metric").agg(
        F.max_by("model", F.struct(F.when(lower, -F.col("value")).otherwise(F.col("value")),
                                   "model")).alias("preferred"))
    wide = tidy.groupBy("metric").pivot("model", sorted(scores)).agg(F.first("value"))
    return wide.join(best, "metric", "left")


GATE_SCHEMA = "name string, value double, limit double, direction string, blocking boolean"


def gate_results(gates: DataFrame) -> DataFrame:
    """Adds `passed` to (name, value, limit, direction 'min'|'max', blocking)."""
    ok = F.when(F.col("direction") == "min", F.col("value") >= F.col("limit")).otherwise(
        F.col("value") <= F.col("limit"))
    return gates.withColumn("passed", F.coalesce(ok, F.lit(False)))


def decision(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Failed when a blocking gate fails; passed with limitations when another does."""
    bad = ~F.col("passed")
    flags = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("gates"),
        F.count_if(bad & F.col("blocking")).alias("blocking_failures"),
        F.count_if(bad & ~F.col("blocking")).alias("limitations"))
    return flags.withColumn(
        "decision",
        F.when(F.col("blocking_failures") > 0, "validation_failed")
        .when(F.col("limitations") > 0, "validation_passed_with_limitations")
        .otherwise("validation_passed"))
