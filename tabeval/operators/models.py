"""Learners: build, fit, score, calibrate, on MLlib where it has them.

A learner is fitted on a frame whose features stand in columns ``_x0 .. _xn`` (positions, so
feature names may hold anything), the label in ``_label`` and a unique integer in ``_id``; it scores any
frame with those feature columns, giving ``score`` = P(class 1) and ``pred``. Preparation, selection,
search and the flows are in ``workflow``.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import named
from . import boosting as bs
from . import forest as fo
from . import neighbors as nb
from .ordered import freeze
from .sample import kfold_stratified

LABEL, FEATURES, ID = "_label", "_features", "_id"

#: algorithm names -> learner family
ALIASES = {"rf": "rf", "dt": "dt", "gbt": "gbt", "gb": "gbt", "xgb": "gbt", "cat": "gbt", "lgbm": "gbt",
           "lr": "lr", "lr_l2": "lr", "sgd_elastic": "sgd_elastic", "sgd_l2": "sgd_l2", "svm": "svm",
           "mlp": "mlp", "nb": "nb", "knn": "knn", "hist": "hist", "hist_gbt": "hist"}

#: the parameters each family takes; any other is refused
PARAMETERS = {
    "rf": {"n_estimators", "max_depth", "min_samples_leaf", "max_features", "max_bins"},
    "dt": {"max_depth", "min_samples_leaf", "max_bins"},
    "gbt": {"n_estimators", "max_depth", "learning_rate", "subsample", "max_bins"},
    "lr": {"C", "reg", "l1_ratio", "max_iter"},
    "sgd_elastic": {"alpha", "l1_ratio", "max_iter"}, "sgd_l2": {"alpha", "max_iter"},
    "svm": {"C", "max_iter", "calibration_folds"},
    "mlp": {"hidden_layer_sizes", "max_iter", "learning_rate_init", "batch_size"},
    "nb": {"var_smoothing"}, "knn": {"n_neighbors", "weights", "metric"},
    "hist": {"n_estimators", "max_depth", "learning_rate", "reg_lambda", "gamma", "min_child_weight", "colsample_bytree", "max_bins"},
}

#: a search space for every family, over the parameters of the learners used here
SEARCH_SPACES: dict[str, dict[str, list]] = {
    "rf": {"n_estimators": [50, 100, 200], "max_depth": [4, 6, 8, 10], "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2"]},
    "dt": {"max_depth": [2, 4, 6, 8, 10], "min_samples_leaf": [1, 2, 4, 8]},
    "gbt": {"n_estimators": [20, 50, 100], "max_depth": [2, 3, 4], "learning_rate": [0.05, 0.1, 0.2], "subsample": [0.7, 1.0]},
    "lr": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "l1_ratio": [0.0, 0.5, 1.0]},
    "sgd_elastic": {"alpha": [1e-5, 1e-4, 1e-3, 1e-2], "l1_ratio": [0.1, 0.3, 0.5, 0.7]},
    "sgd_l2": {"alpha": [1e-5, 1e-4, 1e-3, 1e-2]},
    "svm": {"C": [0.01, 0.1, 1.0, 10.0]},
    "mlp": {"hidden_layer_sizes": [(8,), (16,), (16, 8)], "max_iter": [100, 200]},
    "hist": {"n_estimators": [20, 50, 100], "max_depth": [2, 3, 4], "learning_rate": [0.05, 0.1, 0.2], "reg_lambda": [0.0, 1.0, 10.0],
             "gamma": [0.0, 0.1], "colsample_bytree": [0.5, 1.0]},
    "nb": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]}, "knn": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
}


def family(alg: str) -> str:
    if alg not in ALIASES:
        raise ValueError(f"unknown algorithm {alg}; known: {sorted(ALIASES)}")
    return ALIASES[alg]


def check_parameters(alg: str, params: dict | None) -> dict:
    p, allowed = dict(params or {}), PARAMETERS[family(alg)]
    if unknown := sorted(set(p) - allowed):
        raise ValueError(f"{alg} takes {sorted(allowed)}, not {unknown}")
    return p


def build_classifier(alg: str, params: dict | None, n_features: int, n_rows: int, seed: int = 1000):
    """MLlib estimator with translated parameters. ``C`` is the inverse strength of a penalty summed
    over rows: regParam = 1 / (C n) on unstandardised features."""
    p, fam = check_parameters(alg, params), family(alg)
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    bins = {"maxBins": int(p["max_bins"])} if "max_bins" in p else {}
    if fam == "rf":
        return RandomForestClassifier(**common, **bins, seed=seed, numTrees=int(p.get("n_estimators", 100)),
                                      maxDepth=int(p.get("max_depth", 5)), minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                      featureSubsetStrategy=_subset(p.get("max_features", "sqrt")))
    if fam == "dt":
        return DecisionTreeClassifier(**common, **bins, seed=seed, maxDepth=int(p.get("max_depth", 5)),
                                      minInstancesPerNode=int(p.get("min_samples_leaf", 1)))
    if fam == "gbt":
        return GBTClassifier(**common, **bins, seed=seed, maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 3)),
                             stepSize=float(p.get("learning_rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)))
    if fam == "lr":
        if "reg" in p and "C" in p:
            raise ValueError("give C or reg, not both")
        reg = float(p["reg"]) if "reg" in p else 1.0 / (float(p.get("C", 1.0)) * max(n_rows, 1))
        return LogisticRegression(**common, regParam=reg, elasticNetParam=float(p.get("l1_ratio", 0.0)),
                                  maxIter=int(p.get("max_iter", 100)), standardization=False)
    if fam in ("sgd_elastic", "sgd_l2"):
        return LogisticRegression(**common, regParam=float(p.get("alpha", 1e-4)),
                                  elasticNetParam=float(p.get("l1_ratio", 0.15)) if fam == "sgd_elastic" else 0.0,
                                  maxIter=int(p.get("max_iter", 100)), standardization=False)
    if fam == "svm":
        return LinearSVC(**common, regParam=1.0 / (float(p.get("C", 1.0)) * max(n_rows, 1)), maxIter=int(p.get("max_iter", 100)),
                         standardization=False)
    if fam == "mlp":
        size = {"blockSize": int(p["batch_size"])} if "batch_size" in p else {}
        return MultilayerPerceptronClassifier(**common, **size, seed=seed, layers=[n_features, *p.get("hidden_layer_sizes", (16,)), 2],
                                              maxIter=int(p.get("max_iter", 100)), stepSize=float(p.get("learning_rate_init", 0.03)))
    raise ValueError(f"{alg} has no MLlib estimator")


def _subset(v) -> str:
    if v not in (None, "None", "auto", "all", "sqrt", "log2"):
        raise ValueError(f"max_features must be sqrt, log2 or None, not {v}")
    return {None: "all", "None": "all", "auto": "sqrt"}.get(v, v)


def inputs(n: int) -> list[str]:
    return [f"_x{i}" for i in range(n)]


def with_label(df: DataFrame, y: str) -> DataFrame:
    return df.withColumn(LABEL, named(y).cast("double"))


# ----------------------------------------------------------------- learners
class SparkLearner:
    """An MLlib classifier; margins of a support vector machine become probabilities by a logistic
    curve fitted on margins of rows that the machine hadn't seen."""

    def __init__(self, model: PipelineModel, platt: tuple[float, float] | None = None):
        self.model, self.platt = model, platt

    @classmethod
    def fit(cls, frame: DataFrame, n: int, alg: str, params: dict, seed: int = 1000) -> "SparkLearner":
        params = dict(params)
        folds = int(params.pop("calibration_folds", 3)) if family(alg) == "svm" else 0
        model = cls._pipeline(frame, n, alg, params, seed)
        if not folds:
            return cls(model)
        parts = freeze(kfold_stratified(frame, LABEL, ID, folds, seed, out="_fold"), "calibration")
        margins = None
        for f in range(folds):
            part = cls(cls._pipeline(parts.where(F.col("_fold") != f), n, alg, params, seed))
            m = part.transform(parts.where(F.col("_fold") == f)).select(vector_to_array("rawPrediction")[1].alias("margin"), LABEL)
            margins = m if margins is None else margins.unionByName(m)
        a = VectorAssembler(inputCols=["margin"], outputCol=FEATURES)
        curve = Pipeline(stages=[a, LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0)]).fit(margins).stages[-1]
        return cls(model, (float(curve.coefficients[0]), float(curve.intercept)))

    @staticmethod
    def _pipeline(frame: DataFrame, n: int, alg: str, params: dict, seed: int) -> PipelineModel:
        stages = [VectorAssembler(inputCols=inputs(n), outputCol=FEATURES, handleInvalid="keep"),
                  build_classifier(alg, params, n, frame.count(), seed)]
        return Pipeline(stages=stages).fit(frame)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        out = self.transform(df)
        if self.platt:
            a, b = self.platt
            s = 1.0 / (1.0 + F.exp(-(vector_to_array("rawPrediction")[1] * a + b)))
        else:
            s = vector_to_array("probability")[1]
        return out.select(*keep, s.alias("score"), F.col("prediction").cast("int").alias("pred"))

    def weights(self) -> list[float]:
        """Size of each feature's coefficient or importance, for eliminating features."""
        last = self.model.stages[-1]
        if hasattr(last, "featureImportances"):
            return [float(x) for x in last.featureImportances.toArray()]
        if hasattr(last, "coefficients"):
            return [abs(float(x)) for x in last.coefficients.toArray()]
        raise ValueError("this learner has no feature weights")

    def save(self, path: str) -> dict:
        self.model.write().overwrite().save(f"{path}/model")
        return {"platt": self.platt}

    @classmethod
    def load(cls, path: str, meta: dict) -> "SparkLearner":
        return cls(PipelineModel.load(f"{path}/model"), tuple(meta["platt"]) if meta["platt"] else None)


class LogisticCurve:
    """A fitted logistic regression as a column expression."""

    def __init__(self, coefficients: Sequence[float], intercept: float):
        self.coefficients, self.intercept = list(coefficients), intercept

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        margin = F.lit(self.intercept)
        for c, w in zip(inputs(len(self.coefficients)), self.coefficients):
            margin = margin + F.coalesce(F.col(c), F.lit(float("nan"))) * F.lit(w)
        out = df.select(*keep, margin.alias("_margin"))
        return out.withColumns({"score": 1.0 / (1.0 + F.exp(-F.col("_margin"))), "pred": (~F.isnan("_margin") & (F.col("_margin") > 0)).cast("int")}).drop("_margin")

    def weights(self) -> list[float]:
        return [abs(w) for w in self.coefficients]


class NaiveBayes:
    """Gaussian naive Bayes as column expressions."""

    def __init__(self, model: dict):
        self.model = model

    @classmethod
    def fit(cls, frame: DataFrame, n: int, alg: str, params: dict, seed: int = 0) -> "NaiveBayes":
        return cls(fit_gaussian_nb(frame, inputs(n), LABEL, **check_parameters(alg, params)))

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        return predict_gaussian_nb(self.model, df).select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("pred"))

    def weights(self) -> list[float]:
        raise ValueError("naive Bayes has no feature weights")

    def save(self, path: str) -> dict:
        by_class = lambda k: [self.model[k][c] for c in self.model["classes"]]
        return {"features": self.model["features"], "classes": self.model["classes"], **{k: by_class(k) for k in ("prior", "mean", "var")}}

    @classmethod
    def load(cls, path: str, meta: dict) -> "NaiveBayes":
        by_class = lambda k: dict(zip(meta["classes"], meta[k], strict=True))
        return cls({"features": meta["features"], "classes": meta["classes"], **{k: by_class(k) for k in ("prior", "mean", "var")}})


class Neighbours:
    """k nearest training rows; the model is the training table."""

    def __init__(self, train: DataFrame, n: int, params: dict):
        self.train, self.n, self.params = train, n, params

    @classmethod
    def fit(cls, frame: DataFrame, n: int, alg: str, params: dict, seed: int = 0) -> "Neighbours":
        vec = F.array(*[F.col(c).cast("double") for c in inputs(n)])
        return cls(freeze(frame.select(F.monotonically_increasing_id().alias("id"), vec.alias("vec"), F.col(LABEL).alias("y")), "knn-train"),
                   n, check_parameters(alg, params))

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        vec = F.array(*[F.col(c).cast("double") for c in inputs(self.n)])
        rows = freeze(df.select(*[(k if not isinstance(k, str) else named(k)) for k in keep], vec.alias("_vec"),
                                F.monotonically_increasing_id().alias("_qid")), "knn-rows")
        scores = nb.knn_classifier(self.train, rows.select(F.col("_qid").alias("id"), F.col("_vec").alias("vec")), int(self.params.get("n_neighbors", 5)),
                                   self.params.get("weights", "uniform"), metric=self.params.get("metric", "euclidean"))
        out = rows.join(scores.withColumnRenamed("id", "_qid"), "_qid", "left")
        return out.drop("_vec", "_qid").withColumn("pred", (F.col("score") >= 0.5).cast("int"))

    def weights(self) -> list[float]:
        raise ValueError("nearest neighbours have no feature weights")

    def save(self, path: str) -> dict:
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        return {"n": self.n, "params": self.params}

    @classmethod
    def load(cls, path: str, meta: dict) -> "Neighbours":
        return cls(SparkSession.getActiveSession().read.parquet(f"{path}/train"), meta["n"], meta["params"])


class HistogramBoosting:
    """Second-order boosted trees; a missing value takes the side that its split has learned for it."""

    def __init__(self, trees: list[bs.Tree], n: int):
        self.trees, self.n = trees, n

    @classmethod
    def fit(cls, frame: DataFrame, n: int, alg: str, params: dict, seed: int = 1000) -> "HistogramBoosting":
        return cls(bs.fit_trees(frame, inputs(n), LABEL, bs.Settings(**check_parameters(alg, params), seed=seed)), n)

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        s = 1.0 / (1.0 + F.exp(-bs.margin(self.trees, inputs(self.n))))
        return df.select(*keep, s.alias("score")).withColumn("pred", (F.col("score") >= 0.5).cast("int"))

    def weights(self) -> list[float]:
        """Each feature's share of the gains."""
        gains = [0.0] * self.n
        for t in self.trees:
            for f, _, _, gain in t.splits.values():
                gains[f] += gain
        return [g / (sum(gains) or 1.0) for g in gains]

    def save(self, path: str) -> dict:
        return {"n": self.n, "trees": [{"splits": [[k, *v] for k, v in t.splits.items()], "leaves": [[k, v] for k, v in t.leaves.items()]}
                                       for t in self.trees]}

    @classmethod
    def load(cls, path: str, meta: dict) -> "HistogramBoosting":
        return cls([bs.Tree({k: tuple(v) for k, *v in t["splits"]}, dict(t["leaves"])) for t in meta["trees"]], meta["n"])


class RandomForest:
    """A forest grown from counts of binned rows; MLlib's where counting doesn't pay (``forest.count_cells``)."""

    def __init__(self, edges: list[np.ndarray], nodes: np.ndarray):
        self.edges, self.nodes, self.table = edges, nodes, fo.shares(nodes, edges)

    @classmethod
    def fit(cls, frame: DataFrame, n: int, alg: str, params: dict, seed: int = 1000) -> "RandomForest | SparkLearner":
        p = check_parameters(alg, params)
        s = fo.Settings(**{k: _subset(v) if k == "max_features" else int(v) for k, v in p.items()}, seed=seed)
        cells = fo.count_cells(frame, inputs(n), LABEL, ID, s)
        return SparkLearner.fit(frame, n, alg, params, seed) if cells is None else cls(cells.edges, fo.grow_trees(frame.sparkSession, cells, s))

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        s = fo.score(self.table, self.edges, [F.col(c) for c in inputs(len(self.edges))])
        return df.select(*keep, s.alias("score")).withColumn("pred", (F.col("score") > 0.5).cast("int"))

    def weights(self) -> list[float]:
        return fo.importances(self.nodes, len(self.edges))

    def save(self, path: str) -> dict:
        rows = [(*map(int, r[:4]), *map(float, r[4:])) for r in self.nodes]
        SparkSession.getActiveSession().createDataFrame(rows, fo.NODES).write.mode("overwrite").parquet(f"{path}/trees")
        return {"edges": [e.tolist() for e in self.edges]}

    @classmethod
    def load(cls, path: str, meta: dict) -> "RandomForest | SparkLearner":
        if "edges" not in meta:
            return SparkLearner.load(path, meta)
        rows = SparkSession.getActiveSession().read.parquet(f"{path}/trees").collect()  # the trees' nodes
        return cls([np.array(e, float) for e in meta["edges"]], np.array(sorted(map(tuple, rows)), float))


LEARNERS = {"nb": NaiveBayes, "knn": Neighbours, "hist": HistogramBoosting, "rf": RandomForest}


def learner_class(alg: str):
    return LEARNERS.get(family(alg), SparkLearner)


# ------------------------------------------------------------------- search
def param_grid(grid: dict[str, list]) -> list[dict]:
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])] or [{}]


def sample_grid(combos: list[dict], n_iter: int, seed: int = 256) -> list[dict]:
    """Hash-ordered sample of the grid (deterministic, no driver RNG)."""
    keyed = sorted(range(len(combos)), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return [combos[i] for i in sorted(keyed[:n_iter])]


def candidates(alg: str, grid: dict[str, list] | None, strategy: str, n_iter: int, seed: int = 256) -> list[dict]:
    """The combinations that a search tries: all of the grid, or a hash sample of ``n_iter``."""
    if strategy not in ("grid", "random"):
        raise ValueError(f"unknown search {strategy}; known: grid, random")
    combos = param_grid(SEARCH_SPACES[family(alg)] if grid is None else grid)
    for c in combos:
        check_parameters(alg, c)
    return combos if strategy == "grid" else sample_grid(combos, n_iter, seed)


def as_json(params: dict) -> str:
    return json.dumps(params, default=str, sort_keys=True)


# -------------------------------------------------------------- calibration
def calibrate_sigmoid(scores: DataFrame, y: str = "y", score_col: str = "score"):
    """Platt scaling: a one-feature logistic regression on (out-of-fold) scores.
    Returns a function DataFrame -> DataFrame adding ``calibrated``."""
    a = VectorAssembler(inputCols=[score_col], outputCol=FEATURES)
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0)
    m = Pipeline(stages=[a, lr]).fit(with_label(scores, y))

    def apply(df: DataFrame) -> DataFrame:
        out = m.transform(df)
        return out.select(*map(named, df.columns), vector_to_array("probability")[1].alias("calibrated"))
    return apply


# ------------------------------------------------------------ gaussian NB
def fit_gaussian_nb(df: DataFrame, features: Sequence[str], y: str, var_smoothing: float = 1e-9) -> dict:
    """Class priors, per-class means and population variances (+ var_smoothing x
    the largest feature variance) from one grouped aggregate; the fitted model
    is classes x features numbers."""
    features = list(features)
    if df.select(named(y)).distinct().limit(3).count() != 2:
        raise ValueError(f"{y} must have exactly two values")
    g = df.groupBy(named(y).alias("_c")).agg(F.count(F.lit(1)).alias("_n"), *[
        a for i, f in enumerate(features) for a in (F.avg(named(f).cast("double")).alias(f"m_{i}"), F.var_pop(named(f).cast("double")).alias(f"v_{i}"))]).collect()
    allv = df.agg(*[F.var_pop(named(f).cast("double")).alias(f"v_{i}") for i, f in enumerate(features)]).first()
    eps = var_smoothing * max(float(v or 0.0) for v in allv)
    n = sum(r["_n"] for r in g)
    by = {r["_c"]: r for r in g}  # two rows
    classes = sorted(by)
    return {"features": features, "classes": classes, "prior": {c: by[c]["_n"] / n for c in classes},
            "mean": {c: {f: by[c][f"m_{i}"] for i, f in enumerate(features)} for c in classes},
            "var": {c: {f: by[c][f"v_{i}"] + eps for i, f in enumerate(features)} for c in classes}}


def predict_gaussian_nb(model: dict, df: DataFrame) -> DataFrame:
    """Adds ``score`` = P(last class) from the joint log-likelihoods (binary)."""
    def jll(c):
        e = F.lit(math.log(model["prior"][c]))
        for f in model["features"]:
            v, m = model["var"][c][f], model["mean"][c][f]
            x = named(f).cast("double")
            e = e - F.lit(0.5 * math.log(2 * math.pi * v)) - 0.5 * (x - F.lit(m)) * (x - F.lit(m)) / F.lit(v)
        return e
    c0, c1 = model["classes"][0], model["classes"][-1]
    dlt = F.least(F.greatest(jll(c0) - jll(c1), F.lit(-700.0)), F.lit(700.0))
    return df.withColumn("score", 1.0 / (1.0 + F.exp(dlt)))
