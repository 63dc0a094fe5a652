"""Training and applying models with ``pyspark.ml`` on feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats as st

# Estimators a specification may name, and how its parameters translate.
ESTIMATORS = {
    "DecisionTreeClassifier": DecisionTreeClassifier,
    "GradientBoostingClassifier": GBTClassifier,
    "LinearSVC": LinearSVC,
    "LogisticRegression": LogisticRegression,
    "RandomForestClassifier": RandomForestClassifier,
    "RandomForestRegressor": RandomForestRegressor,
    "DecisionTreeRegressor": DecisionTreeRegressor,
}
PARAMETERS = {
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "learning_rate": "stepSize",
    "max_iter": "maxIter",
    "fit_intercept": "fitIntercept",
    "random_state": "seed",
}
# parameters without a counterpart: they steer the single-node implementation or are implied here
IGNORED = {"presort", "dual", "bootstrap", "oob_score", "loss", "scoring", "n_jobs", "min_samples_split", "class_weight"}
SCORER_NAMES = {
    "f1_score": "f1", "f1": "f1", "accuracy_score": "accuracy", "accuracy": "accuracy", "roc_auc_score": "roc_auc", "roc_auc": "roc_auc",
    "mse": "mse", "mean_squared_error": "mse", "r2_score": "r2", "r2": "r2", "kendall_tau": "kendall", "kendall_tau_score": "kendall",
}


# ---------------------------------------------------------------- scoring


def score_table(df: DataFrame, scorer: str, truth: str, pred: str = "prediction", prob: str | None = None, weight: str | None = None) -> float:
    """One score of predictions; larger is better, so squared errors come out negative."""
    kind = SCORER_NAMES.get(scorer)
    if kind is None:
        raise ValueError(f"unknown scorer: {scorer}")
    if kind == "f1":
        out = st.f1_macro(df, truth, pred, weight)
    elif kind == "accuracy":
        out = st.accuracy(df, truth, pred, weight)
    elif kind == "roc_auc":
        out = st.roc_auc(df, truth, prob or pred, weight)
    elif kind == "mse":
        out = st.mean_squared_error(df, truth, pred, weight).select((-F.col("score")).alias("score"))
    elif kind == "r2":
        out = st.r2(df, truth, pred, weight)
    else:
        out = st.kendall_tau(df.withColumn("_k", F.lit(1)), ["_k"], truth, pred).select(F.col("stat").alias("score"))
    value = out.first()["score"]
    return float("nan") if value is None else float(value)


class TableEvaluator(Evaluator):
    """Cross validation scored by ``score_table``."""

    def __init__(self, scorer: str, truth: str, weight: str | None = None):
        super().__init__()
        self.scorer, self.truth, self.weight = scorer, truth, weight

    def _evaluate(self, dataset: DataFrame) -> float:
        prob = None
        if "probability" in dataset.columns and SCORER_NAMES[self.scorer] == "roc_auc":
            dataset, prob = dataset.withColumn("_p1", F.element_at(vector_to_array("probability"), 2)), "_p1"
        return score_table(dataset, self.scorer, self.truth, prob=prob, weight=self.weight)

    def isLargerBetter(self) -> bool:
        return True


def choose_scoring(asked: str, metadata: dict) -> str:
    """Scoring method: as asked, else as stored with the model, else as used in training."""
    stored = metadata.get("model_info", {}).get("scoring") or metadata.get("training_info", {}).get("scoring")
    if asked or stored:
        return asked or stored
    raise KeyError("no scoring method given and none in the model metadata")


# ---------------------------------------------------------------- preprocessing


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Mean and population standard deviation per column; a constant column gets scale 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    n = range(len(columns))
    return {"columns": list(columns), "mean_": [row[f"m{i}"] for i in n], "scale_": [row[f"s{i}"] or 1.0 for i in n]}


def scale(df: DataFrame, scaler: dict[str, list]) -> DataFrame:
    scaled = {c: (F.col(c) - m) / s for c, m, s in zip(scaler["columns"], scaler["mean_"], scaler["scale_"])}
    return df.withColumns(scaled)


def check_predictors(df: DataFrame, columns: Sequence[str]) -> None:
    bad = df.select(*columns).filter(" or ".join(f"`{c}` is null" for c in columns))
    if not bad.isEmpty():
        raise ValueError("null values among the predictors")


def balanced_weights(df: DataFrame, target: str, base: str | None = None) -> DataFrame:
    """Weight column that gives every class the same total."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("all"), F.count(F.lit(1)).alias("k")).first()
    weight = F.lit(total["all"] / total["k"]) / F.col("_n")
    weight = weight * F.col(base) if base else weight
    return df.join(counts, target).withColumn("_wt", weight).drop("_n")


# ---------------------------------------------------------------- training


def _params_for(name: str, values: dict, n_rows: int) -> dict:
    """Translate one parameter set to the estimator's names."""
    out: dict = {}
    for key, value in values.items():
        if key in IGNORED:
            continue
        if key == "n_estimators":
            out["maxIter" if name == "GradientBoostingClassifier" else "numTrees"] = value
        elif key == "C":
            # the penalty of the mean loss instead of the summed one
            out["regParam"] = 1.0 / (value * max(1, n_rows))
        elif key == "penalty":
            if name == "LogisticRegression":
                out["elasticNetParam"] = {"l1": 1.0, "l2": 0.0}[value]
        elif key in PARAMETERS:
            out[PARAMETERS[key]] = value
        else:
            raise ValueError(f"parameter {key} of {name} has no counterpart")
    return out


def make_estimator(spec: dict, features: Sequence[str], target: str, weight: str | None, params: dict, n_rows: int) -> Pipeline:
    """Pipeline of vector assembly and the whitelisted estimator a specification names."""
    name = spec["model_name"]
    if name not in ESTIMATORS:
        raise ValueError(f"model {name} is not available; known are {sorted(ESTIMATORS)}")
    args = {"featuresCol": "features", "labelCol": target, **_params_for(name, params, n_rows)}
    if weight:
        args["weightCol"] = weight
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), ESTIMATORS[name](**args)])


def _fold_column(df: DataFrame, target: str, folds: int, seed: int, stratify: bool) -> DataFrame:
    """Fold number per row from a seeded hash; hashing spreads every class evenly over the folds."""
    key = [F.col(c) for c in df.columns if not c.startswith("_")]
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(folds)).cast("int"))


def train(
    df: DataFrame,
    spec: dict,
    features: Sequence[str],
    target: str,
    *,
    weight: str | None = None,
    tune: bool = True,
    folds: int = 10,
    seed: int = 0,
    parallelism: int = 2,
) -> tuple[PipelineModel, dict]:
    """Fit with default parameters, or search the grid by cross validation and refit the best."""
    n_rows = df.count()
    default = spec.get("default", {})
    grid = {k: v for k, v in spec.get("cvtune", {}).items() if k != "scoring"}
    if (default if not tune else {k: v[0] for k, v in grid.items()}).get("class_weight") == "balanced":
        df = balanced_weights(df, target, weight)
        weight = "_wt"
    if not tune:
        model = make_estimator(spec, features, target, weight, default, n_rows).fit(df)
        return model, {"model_info": {"params": default, "tuned": False}, "training_info": {}}

    scoring = spec["cvtune"]["scoring"]
    pipeline = make_estimator(spec, features, target, weight, {}, n_rows)
    estimator = pipeline.getStages()[-1]
    choices = [dict(zip(grid, values)) for values in product(*grid.values())]
    translated, kept = [], []
    for choice in choices:
        args = _params_for(spec["model_name"], choice, n_rows)
        if args not in translated:
            translated.append(args)
            kept.append(choice)
    maps = [{estimator.getParam(k): v for k, v in args.items()} for args in translated] or ParamGridBuilder().build()
    folded = _fold_column(df, target, folds, seed, spec["model_type"] == "classifier")
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=maps, evaluator=TableEvaluator(scoring, target, weight),
        numFolds=folds, foldCol="_fold", seed=seed, parallelism=parallelism,
    )
    fitted = search.fit(folded)
    best = max(range(len(maps)), key=lambda i: fitted.avgMetrics[i])
    info = {
        "model_info": {"params": kept[best], "tuned": True},
        "training_info": {
            "cv_scores": {
                "params": [{"index": i, **c} for i, c in enumerate(kept)],
                "mean_test_score": [float(x) for x in fitted.avgMetrics],
                "std_test_score": [float(x) for x in fitted.stdMetrics],
            },
            "best_score": float(fitted.avgMetrics[best]),
            "best_index": best,
            "scoring": scoring,
        },
    }
    return fitted.bestModel, info


def out_of_fold_weights(
    df: DataFrame, spec: dict, features: Sequence[str], target: str, name: str, folds: int, seed: int = 0
) -> DataFrame:
    """``name, weight``: 1 - probability of the true class, predicted by a model that has not seen the row."""
    folded = _fold_column(df, target, folds, seed, True)
    parts = None
    for k in range(folds):
        pipeline = make_estimator(spec, features, target, None, spec.get("default", {}), 1)
        model = pipeline.fit(folded.filter(F.col("_fold") != k))
        held = model.transform(folded.filter(F.col("_fold") == k))
        p = F.element_at(vector_to_array("probability"), F.col(target).cast("int") + 1)
        part = held.select(F.col(name).alias("name"), (1 - p).alias("weight"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def model_attributes(model: PipelineModel, names: Sequence[str], features: Sequence[str]) -> dict:
    """Requested attributes of the fitted estimator; those without a counterpart are left out."""
    fitted: Model = model.stages[-1]
    out: dict = {}
    for name in names:
        if name == "feature_importances_" and hasattr(fitted, "featureImportances"):
            out[name] = [float(x) for x in fitted.featureImportances.toArray()]
        elif name == "coef_" and hasattr(fitted, "coefficients"):
            out[name] = [float(x) for x in fitted.coefficients.toArray()]
        elif name == "intercept_" and hasattr(fitted, "intercept"):
            out[name] = float(fitted.intercept)
    return out


# ---------------------------------------------------------------- applying


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions, with class probabilities as an array where the model has them."""
    out = model.transform(df)
    if "probability" in out.columns:
        probs = vector_to_array("probability")
        out = out.withColumn("class_probs", probs).withColumn("pred_prob", F.element_at("class_probs", F.col("prediction").cast("int") + 1))
    return out.drop("features", "rawPrediction", "probability")


def estimate_signal(model: PipelineModel, windows: DataFrame) -> DataFrame:
    """Predictions for feature windows as a signal track; silent windows are left out."""
    out = predict(model, windows)
    return out.select("chrom", "start", "end", F.col("prediction").alias("value")).filter("value != 0")


def permuted(df: DataFrame, truth: str, turn: int, seed: int, group_size: int = 1 << 20) -> DataFrame:
    """Rows with the truth column shuffled: two seeded orders of the rows are joined by place.

    Places come from prefix counts over hash tiles, so no task sorts the whole table.
    """
    from .scan import prefix_scan

    def placed(salt: int, columns: list[str]) -> DataFrame:
        hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(turn), F.lit(salt), F.col("_row")))
        scanned = prefix_scan(
            hashed.withColumn("_f", F.lit(0)), ["_f"], "_h", F.shiftright("_h", 52), {"_place": ("sum", F.lit(1).cast("bigint"))}
        )
        return scanned.select("_place", *columns)

    rest = [c for c in df.columns if c not in (truth, "_row")]
    return placed(0, rest).join(placed(1, [truth]), "_place").drop("_place")


def permutation_test(
    predictions: DataFrame, truth: str, scorers: Sequence[str], count: int, seed: int = 0, prob: str | None = None
) -> dict[str, dict[str, float]]:
    """Score statistics over ``count`` shuffles of the truth, per scorer.

    Predictions do not depend on the truth, so only scores are recomputed.
    """
    spark = predictions.sparkSession
    keep = [truth, "prediction", *([prob] if prob else [])]
    rows = predictions.select(*keep).withColumn("_row", F.monotonically_increasing_id())
    from ..session import cut_lineage

    rows = cut_lineage(rows)
    scores = []
    for turn in range(count):
        shuffled = cut_lineage(permuted(rows, truth, turn, seed))
        scores += [(s, score_table(shuffled, s, truth, prob=prob)) for s in scorers]
    table = spark.createDataFrame(scores, "scorer string, score double")
    return {s: st.permutation_summary(table.filter(F.col("scorer") == s)).first().asDict() for s in scorers}


def merge_positive_windows(predicted: DataFrame, wanted: int, name: str) -> DataFrame:
    """Windows predicted as one class, merged where they overlap, with the mean class probability."""
    from .intervals import island_members

    hits = predicted.filter(F.col("prediction") == wanted)
    p = F.element_at("class_probs", wanted + 1)
    rows = island_members(hits.select("chrom", "start", "end", F.col(name).alias("name"), p.alias("p")))
    return rows.groupBy("chrom", F.col("island_start").alias("start")).agg(
        F.max("island_end").alias("end"), F.min("name").alias("name"), F.avg("p").alias("class_prob")
    )
