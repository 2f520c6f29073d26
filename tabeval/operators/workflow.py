"""The training / testing flow as Spark jobs.

Table level (fit on the training table, reused on any test table):
    one-hot -> drop sparse rows -> +-inf -> outliers -> quantile transform
Per training part (a split or a fold; fit on that part only, Q5), shared by all learners:
    impute -> scale -> normalise rows -> rebalance -> select features
Per learner: (RFECV with that learner) -> search -> fit. Score path for new data: the same fitted
stages, then the model.

Every fitted stage is a small parameter set (category lists, means, quantile arrays, selected names)
and every apply is a column expression; rebalancing and selection are the distributed operators of
this package. This is the only flow: single fits, splits, cross-validation, holdout selection and
stacking all go through ``FoldModel``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import named
from ..functions.scalar import coerce_numeric, log_large_values, replace_inf
from . import batch as bt
from . import clean as cl
from . import encode as en
from . import evaluate as ev
from . import models as md
from . import neighbors as nb
from . import sample as sp
from . import select as sl
from .concurrency import run_bounded, union_all
from .ordered import freeze


@dataclass
class Options:
    """Typed form of the flow's options (booleans are real booleans); unknown choices raise."""
    one_hot: bool = True
    cut_missing_rows: bool = True
    missing_threshold: float = 0.75
    inf: str | None = "replace with null"          # or "replace with zero" / None
    outliers: str | None = None                    # "remove rows" / "log" / None
    outliers_n: float = 20000.0
    quantile: bool = False
    impute: str | None = "mean"                    # mean / median / most_frequent / constant / None
    scaling: str | None = None                     # StandardScaler / MinMaxScaler / RobustScaler / MaxAbsScaler
    normalize: bool = False
    rebalance: str | None = None                   # RandomUnderSampler / RandomOverSampler / SMOTE / ADASYN
    sampling_strategy: str = "auto"
    sampling_ratio: float | None = None
    k_neighbors: int = 5
    feature_selection: str | None = None           # see SELECTIONS
    n_features: int = 20
    percentile: float = 10.0
    selection_folds: int = 5                       # of RFECV
    search: str | None = None                      # None / "grid" / "random"
    grids: dict | None = None                      # algorithm -> grid; None: the family's search space
    n_iter: int = 50
    search_folds: int = 10
    search_repeats: int = 1
    scoring: str = "roc_auc"                       # or "accuracy"
    min_positives: int = 10
    test_size: float = 0.2
    seed: int = 42

    def __post_init__(self):
        for name, allowed in (("inf", (None, "replace with null", "replace with zero")), ("outliers", (None, "remove rows", "log")),
                              ("impute", (None, "mean", "median", "most_frequent", "constant")), ("scaling", (None, *en.SCALERS)),
                              ("rebalance", (None, "RandomUnderSampler", "RandomOverSampler", "SMOTE", "ADASYN")),
                              ("feature_selection", (None, *SELECTIONS)), ("search", (None, "grid", "random")),
                              ("scoring", ("roc_auc", "accuracy"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")


SELECTIONS = ("SelectKBest-f_classif", "SelectKBest-chi2", "SelectPercentile-f_classif", "SelectPercentile-chi2", "VarianceThreshold",
              "MRMR", "RFECV")


# ------------------------------------------------------------- table level
@dataclass
class TablePrep:
    numeric: list[str]
    categorical: list[str]
    options: Options
    encoder: en.OneHot | None = None
    quantiles: en.QuantileNormal | None = None
    inputs: list[str] = field(default_factory=list)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        o = self.options
        df = cl.clean_categoricals(df, self.categorical)
        inputs = list(self.numeric) + list(self.categorical)
        if o.one_hot and self.categorical:
            self.encoder = en.OneHot().fit(df, self.categorical)
            df = self.encoder.transform(df)
            inputs = list(self.numeric) + self.encoder.names()
        self.inputs = inputs
        df = self._rows(df)
        if o.quantile and self.numeric:
            self.quantiles = en.QuantileNormal().fit(df, self.numeric)
            df = self.quantiles.transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """Score path: the fitted encoder and quantiles, non-numeric values coerced."""
        df = cl.clean_categoricals(df, self.categorical)
        if self.encoder is not None:
            df = self.encoder.transform(df)
        df = df.select(*[coerce_numeric(named(c).cast("string")).alias(c) if c in self.numeric else named(c)
                         for c in df.columns])
        df = self._rows(df)
        if self.quantiles is not None:
            df = self.quantiles.transform(df)
        return df

    def to_dict(self) -> dict:
        return {"numeric": self.numeric, "categorical": self.categorical, "options": asdict(self.options),
                "inputs": self.inputs,
                "categories": None if self.encoder is None else self.encoder.categories,
                "quantiles": None if self.quantiles is None else {"references": self.quantiles.references,
                                                                  "quantiles": self.quantiles.quantiles}}

    @staticmethod
    def from_dict(d: dict) -> "TablePrep":
        tp = TablePrep(d["numeric"], d["categorical"], Options(**d["options"]), inputs=d["inputs"])
        if d["categories"] is not None:
            tp.encoder = en.OneHot(categories=d["categories"])
        if d["quantiles"] is not None:
            q = en.QuantileNormal(quantiles=d["quantiles"]["quantiles"])
            q.references = d["quantiles"]["references"]
            tp.quantiles = q
        return tp

    def _rows(self, df: DataFrame) -> DataFrame:
        o = self.options
        if o.cut_missing_rows:
            df = cl.drop_sparse_rows(df, self.inputs, o.missing_threshold)
        if o.inf:
            mode = "zero" if o.inf == "replace with zero" else "null"
            df = df.select(*[replace_inf(c, mode).alias(c) if c in self.numeric else named(c) for c in df.columns])
        if o.outliers == "remove rows":
            df = cl.filter_outlier_rows(df, self.numeric, o.outliers_n)
        elif o.outliers == "log":
            df = df.select(*[log_large_values(c, o.outliers_n).alias(c) if c in self.numeric else named(c)
                             for c in df.columns])
        return df


# ---------------------------------------------------------- training part
@dataclass
class Preparation:
    """Impute, scale, normalise, rebalance and select, fitted on one training part."""
    features: list[str]
    y: str
    options: Options
    imputer: en.Imputer | None = None
    scaler: en.Scaler | None = None
    selected: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame, row_id: str) -> DataFrame:
        """The prepared training rows, frozen: the features, the label and a unique integer ``_id``."""
        o, feats = self.options, list(self.features)
        df = train.where(named(self.y).isNotNull())
        if o.impute:
            self.imputer = en.Imputer(o.impute).fit(df, feats)
            df = self.imputer.transform(df)
        if o.scaling:
            self.scaler = en.Scaler(o.scaling).fit(df, feats)
            df = self.scaler.transform(df)
        if o.normalize:
            df = en.normalize_rows(df, feats)
        df = rebalance(df, feats, self.y, row_id, o)
        df = freeze(df.select(*map(named, feats), named(self.y), F.monotonically_increasing_id().alias(md.ID)), "train-part")
        self.selected = select(df, feats, self.y, o)
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        if self.imputer is not None:
            df = self.imputer.transform(df)
        if self.scaler is not None:
            df = self.scaler.transform(df)
        if self.options.normalize:
            df = en.normalize_rows(df, self.features)
        return df


def rebalance(df: DataFrame, feats: list[str], y: str, row_id: str, o: Options) -> DataFrame:
    if not o.rebalance:
        return df
    ratio = o.sampling_ratio if o.sampling_strategy == "ratio" else None
    if o.rebalance == "RandomUnderSampler":
        return sp.undersample(df, y, row_id, o.sampling_strategy, ratio, o.seed)
    if o.rebalance == "RandomOverSampler":
        return sp.oversample(df, y, row_id, o.sampling_strategy, ratio, o.seed).drop("copy")
    tg = sp.sampling_targets(df, y, "over", o.sampling_strategy, ratio)
    need = [(r[y], int(r["target"] - r["count"])) for r in tg.where("target > count").limit(3).collect()]
    if len(need) > 2:
        raise ValueError(f"{y} must have two values")
    vec = df.select(named(row_id).cast("long").alias("_id"), F.array(*[named(f).cast("double") for f in feats]).alias("_vec"),
                    named(y).alias("_y"))
    out = df.select(*map(named, feats), named(y))
    for label, n_new in need:  # one synthesis job per minority class (binary: one)
        gen = nb.smote if o.rebalance == "SMOTE" else nb.adasyn
        synth = gen(vec, "_id", "_vec", "_y", label, n_new, o.k_neighbors, o.seed)
        out = out.union(synth.select(*[F.col("vec")[i].alias(f) for i, f in enumerate(feats)],
                                     F.lit(label).cast(df.schema[y].dataType).alias(y)))
    return out


def select(df: DataFrame, feats: list[str], y: str, o: Options) -> list[str]:
    """Selected features, in their order (MRMR: in the order chosen). RFECV needs a learner and comes later."""
    m = o.feature_selection
    if not m or m == "RFECV":
        return feats
    if m == "MRMR":
        rows = sl.select_mrmr(df, feats, y, o.n_features).collect()  # names of features
        return [r["feature"] for r in sorted(rows, key=lambda r: r["rank"])]
    if m == "VarianceThreshold":
        rep = sl.select_variance(df, feats, 0.0)
    else:
        method, _, kind = m.partition("-")
        scores = sl.chi2_scores(df, feats, y) if kind == "chi2" else sl.f_scores(df, feats, y)
        rep = sl.select_k_best(scores, feats, o.n_features) if method == "SelectKBest" else sl.select_percentile(scores, feats, o.percentile)
    keep = {r["feature"] for r in rep.where("selected").collect()}  # names of features
    return [f for f in feats if f in keep]


def frame_of(df: DataFrame, selected: Sequence[str], y: str | None = None, keep: Sequence = ()) -> DataFrame:
    """What a learner sees: features by position, ``keep`` beside them, the label if given."""
    label = [named(y).cast("double").alias(md.LABEL)] if y else []
    return df.select(*[(named(k) if isinstance(k, str) else k) for k in keep], *[named(f).cast("double").alias(x)
                                                                             for f, x in zip(selected, md.inputs(len(selected)))], *label)


@dataclass
class FoldModel:
    features: list[str]
    y: str
    alg: str
    params: dict
    options: Options
    preparation: Preparation | None = None
    selected: list[str] = field(default_factory=list)
    learner: object | None = None
    cv_results: DataFrame | None = None

    def fit(self, train: DataFrame, row_id: str) -> "FoldModel":
        prep = Preparation(list(self.features), self.y, self.options)
        return self.fit_prepared(prep, prep.fit(train, row_id))

    def fit_prepared(self, prep: Preparation, frame: DataFrame) -> "FoldModel":
        """Fit on a prepared training part, which other learners may share."""
        o = self.options
        md.check_parameters(self.alg, self.params)
        self.preparation, self.selected = prep, list(prep.selected)
        if o.feature_selection == "RFECV":
            steps = eliminate(frame, self.selected, self.y, self.alg, self.params, min(o.n_features, len(self.selected)), o.selection_folds, o.seed)
            self.selected = max(steps, key=lambda r: (r[2], -r[0]))[1]
        if o.search:
            grid = (o.grids or {}).get(self.alg)
            best, self.cv_results = tune(frame, self.selected, self.y, self.alg, grid, o.search, o.n_iter, o.search_folds, o.search_repeats,
                                         o.scoring, self.params)
            self.params = best
        self.learner = md.learner_class(self.alg).fit(frame_of(frame, self.selected, self.y, [md.ID]), len(self.selected), self.alg, self.params)
        return self

    def _rebalance(self, df: DataFrame, feats: list[str], row_id: str) -> DataFrame:
        return rebalance(df, feats, self.y, row_id, self.options)

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        """``keep`` columns (names or Columns of ``df``) with score = P(class 1) and pred."""
        kept = [(named(k).alias(k) if isinstance(k, str) else k) for k in keep]
        names = df.select(*kept).columns
        carried = df.select(*map(named, df.columns), *[c.alias(f"_keep{i}") for i, c in enumerate(kept)])
        frame = frame_of(self.preparation.apply(carried), self.selected, None, [f"_keep{i}" for i in range(len(names))])
        out = self.learner.score(frame, [f"_keep{i}" for i in range(len(names))])
        return out.select(*[F.col(f"_keep{i}").alias(n) for i, n in enumerate(names)], "score", "pred")

    def save(self, path: str) -> None:
        """The learner's files, the fitted parameters as JSON beside them."""
        p = self.preparation
        meta = {"features": self.features, "y": self.y, "alg": self.alg, "params": self.params, "options": asdict(self.options),
                "selected": self.selected, "learner": self.learner.save(path),
                "imputer": None if p.imputer is None else {"strategy": p.imputer.strategy, "values": p.imputer.values},
                "scaler": None if p.scaler is None else {"method": p.scaler.method, "params": p.scaler.params}}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta, default=str),)], "meta string") \
            .coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(path: str) -> "FoldModel":
        meta = json.loads(SparkSession.getActiveSession().read.json(f"{path}/meta").first()["meta"])
        options = Options(**meta["options"])
        prep = Preparation(meta["features"], meta["y"], options, selected=meta["selected"])
        if meta["imputer"]:
            prep.imputer = en.Imputer(meta["imputer"]["strategy"], values=meta["imputer"]["values"])
        if meta["scaler"]:
            prep.scaler = en.Scaler(meta["scaler"]["method"], params={k: tuple(v) for k, v in meta["scaler"]["params"].items()})
        learner = md.learner_class(meta["alg"]).load(path, meta["learner"])
        return FoldModel(meta["features"], meta["y"], meta["alg"], meta["params"], options, prep, meta["selected"], learner)


# ---------------------------------------------------------- search, selection
#: fits whose predictions are evaluated in one job
EVALUATED_AT_ONCE = 40


def cross_scores(frame: DataFrame, y: str, jobs: Sequence[tuple[int, str, dict, list[str]]], k: int, repeats: int, scoring: str,
                 seed: int = 42) -> list[tuple]:
    """(job, repeat, fold, split, score) of every job (number, algorithm, parameters, features) on every
    fold of repeated stratified folds: ROC AUC (exact) or accuracy, on the test and the training rows.

    All logistic regressions are fitted and scored together, trees that differ in their depth only share a fit
    (``batch``); other learners are fitted one by one."""
    folds = {r: freeze(sp.kfold_stratified(frame, y, md.ID, k, seed + r, out="_fold"), "folds") for r in range(repeats)}
    out, g, tasks = [], ["job", "repeat", "fold", "split"], []

    def task(job, alg, params, feats, r, f):
        def run():
            rows = folds[r]
            data = frame_of(rows, feats, y, [md.ID, "_fold"])
            learner = md.learner_class(alg).fit(data.where(F.col("_fold") != f).drop("_fold"), len(feats), alg, params)
            split = F.when(F.col("_fold") == f, F.lit("test")).otherwise(F.lit("train"))
            return learner.score(data, [F.lit(job).alias("job"), F.lit(r).alias("repeat"), F.lit(f).alias("fold"), split.alias("split"),
                                        F.col(md.LABEL).cast("int").alias("y")])
        return run
    kinds: dict[tuple, list] = {}
    for j in jobs:
        kind = "logistic" if bt.logistic(j[1], j[2]) else "trees" if md.family(j[1]) == "dt" else "others"
        kinds.setdefault((kind, tuple(j[3])), []).append(j)
    for (kind, feats), some in kinds.items():
        for r in range(repeats):
            data, got = frame_of(folds[r], feats, y, [md.ID, "_fold"]), None
            if kind != "others":
                got = (bt.logistic_scores if kind == "logistic" else bt.tree_scores)(data, len(feats), [j[:3] for j in some], k, scoring)
            if got is None:
                tasks += [task(*j, r, f) for j in some for f in range(k)]
            else:
                out += [(job, r, f, split, v) for job, f, split, v in got]
    for at in range(0, len(tasks), EVALUATED_AT_ONCE):
        preds = union_all(run_bounded(tasks[at:at + EVALUATED_AT_ONCE]))
        got = ev.auc_table(ev.score_groups(preds, g), g).select(*g, F.col("auc").alias("value")) if scoring == "roc_auc" else \
            preds.groupBy(*g).agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("value"))
        out += [tuple(r) for r in got.select(*g, "value").collect()]  # one row per fit and split
    return out


def tune(frame: DataFrame, features: Sequence[str], y: str, alg: str, grid: dict[str, list] | None = None, strategy: str = "random",
         n_iter: int = 50, k: int = 10, repeats: int = 1, scoring: str = "roc_auc", fixed: dict | None = None) -> tuple[dict, DataFrame]:
    """Best parameters and the results table of a grid or random search over repeated stratified folds.

    ``frame`` has the features, ``y`` and a unique integer ``_id``. Results: combo, params, mean and std
    of test and train scores, the scores of every fold, and the rank by mean test score (ties: the first).
    """
    spark = frame.sparkSession
    combos = [{**(fixed or {}), **c} for c in md.candidates(alg, grid, strategy, n_iter)]
    scores = cross_scores(frame, y, [(i, alg, c, list(features)) for i, c in enumerate(combos)], k, repeats, scoring)
    by: dict = {}
    for job, r, f, split, v in sorted(scores, key=lambda s: s[:4]):
        by.setdefault((job, split), []).append(None if v is None else float(v))

    def stats(job: int, split: str):
        v = [x for x in by.get((job, split), []) if x is not None]
        m = sum(v) / len(v) if v else None
        return m, (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5 if v else None
    means = {i: stats(i, "test")[0] for i in range(len(combos))}
    order = sorted(means, key=lambda i: (-(means[i] if means[i] is not None else -1.0), i))
    rows = [(i, md.as_json(c), *stats(i, "test"), *stats(i, "train"), by.get((i, "test"), []), by.get((i, "train"), []), order.index(i) + 1)
            for i, c in enumerate(combos)]
    table = spark.createDataFrame(rows, "combo int, params string, mean_test_score double, std_test_score double, mean_train_score double, "
                                        "std_train_score double, split_test_scores array<double>, split_train_scores array<double>, rank_test_score int")
    return combos[order[0]], table


def eliminate(frame: DataFrame, features: Sequence[str], y: str, alg: str, params: dict, least: int, k: int, seed: int = 42) -> list[tuple]:
    """Recursive feature elimination with the given learner: (number, features, mean fold AUC) from all
    features down to ``least``, dropping the smallest weight (the last on ties) each time."""
    cur, rows = list(features), []
    while True:
        scores = cross_scores(frame, y, [(0, alg, params, cur)], k, 1, "roc_auc", seed)
        test = [s[-1] for s in scores if s[3] == "test" and s[-1] is not None]
        rows.append((len(cur), list(cur), sum(test) / len(test) if test else float("-inf")))
        if len(cur) <= max(1, least):
            return rows
        learner = md.learner_class(alg).fit(frame_of(frame, cur, y, [md.ID]), len(cur), alg, params)
        w = learner.weights()
        weakest = min(range(len(cur)), key=lambda i: (w[i], -i))
        cur = cur[:weakest] + cur[weakest + 1:]


def select_rfecv(df: DataFrame, features: Sequence[str], y: str, row_id: str, alg: str = "lr", params: dict | None = None,
                 min_features: int = 1, k: int = 5, options: Options | None = None, seed: int = 42) -> DataFrame:
    """(n_features, features, mean_auc, selected) of the elimination path; the best mean AUC is selected
    (the fewest features on ties)."""
    prep = Preparation(list(features), y, options or Options(impute="mean", scaling="StandardScaler"))
    steps = eliminate(prep.fit(df, row_id), features, y, alg, params or {}, min_features, k, seed)
    best = max(steps, key=lambda r: (r[2], -r[0]))
    return df.sparkSession.createDataFrame([(n, json.dumps(f), a, n == best[0]) for n, f, a in steps],
                                           "n_features int, features string, mean_auc double, selected boolean")


# ------------------------------------------------------------------ flows
def fit(df: DataFrame, features: Sequence[str], y: str, row_id: str, alg: str, params: dict | None = None,
        options: Options | None = None) -> FoldModel:
    """One learner on all rows with a label."""
    return FoldModel(list(features), y, alg, dict(params or {}), options or Options()).fit(df, row_id)


def train_whole(df: DataFrame, features: Sequence[str], outcomes: Sequence[str], row_id: str, alg: str, params: dict | None = None,
                options: Options | None = None) -> dict[str, FoldModel]:
    """One model per outcome on all rows (rows with a missing outcome dropped)."""
    return dict(zip(outcomes, run_bounded([lambda o=o: fit(df, features, o, row_id, alg, params, options) for o in outcomes])))


def outcomes_with_positives(df: DataFrame, outcomes: Sequence[str], min_positives: int) -> tuple[list[str], DataFrame]:
    rep = cl.outcome_positives(df, outcomes, min_positives)
    kept = [r["outcome"] for r in rep.where("kept").collect()]  # outcome names
    return [o for o in outcomes if o in kept], rep.where(~F.col("kept"))


def train_test_flow(df: DataFrame, features: Sequence[str], outcomes: Sequence[str], row_id: str,
                    algorithms: dict[str, dict], options: Options, parallelism: int = 4) -> DataFrame:
    """Per outcome with enough positives: stratified split, the training part prepared once, then every
    algorithm fitted on it; train and test predictions: (outcome, algorithm, split, row_id, y, score,
    pred) — feed ``results_table``. Fits run from a bounded thread pool."""
    kept, _ = outcomes_with_positives(df, outcomes, options.min_positives)
    splits = {o: freeze(sp.split_stratified(df.where(named(o).isNotNull()), o, row_id, options.test_size, options.seed), "split") for o in kept}

    def prepare(o):
        prep = Preparation(list(features), o, options)
        return prep, prep.fit(splits[o].where(F.col("split") == "train"), row_id)
    prepared = dict(zip(kept, run_bounded([lambda o=o: prepare(o) for o in kept], parallelism)))

    def task(o, alg, params):
        def run():
            fm = FoldModel(list(features), o, alg, params, options).fit_prepared(*prepared[o])
            return fm.score(splits[o], [F.lit(o).alias("outcome"), F.lit(alg).alias("algorithm"), "split", row_id, named(o).alias("y")])
        return run
    return union_all(run_bounded([task(o, a, p) for o in kept for a, p in algorithms.items()], parallelism))


def train_test(df: DataFrame, features: Sequence[str], y: str, row_id: str, alg: str, params: dict | None = None,
               options: Options | None = None) -> DataFrame:
    """Train and test predictions of one learner for one outcome: (split, row_id, y, score, pred)."""
    preds = train_test_flow(df, features, [y], row_id, {alg: dict(params or {})}, options or Options(min_positives=1))
    return preds.drop("outcome", "algorithm")


#: rows from which the folds' training parts are prepared and fitted together; smaller tables are left to MLlib, fold by fold
SHARED_ROWS = 100_000


def shared_folds(folds: DataFrame, features: list[str], y: str, row_id: str, algorithms: dict[str, dict], o: Options,
                 k: int) -> list[tuple[Preparation, dict[str, md.LogisticCurve]]] | None:
    """Every fold's preparation and learners, fitted on the other folds' rows of ``folds`` (frozen, with ``_fold``) in a few passes for all
    folds: the imputers' and scalers' numbers, one ranking of the rows that oversampling copies, and the logistic regressions
    of all folds by Newton's method. None where the flow asks for anything else."""
    if o.normalize or o.rebalance not in (None, "RandomOverSampler") or o.feature_selection or o.search:
        return None
    if not all(bt.logistic(a, p) for a, p in algorithms.items()) or folds.count() < SHARED_ROWS:
        return None
    imputers = en.Imputer.fit_folds(o.impute, folds, features, "_fold", k) if o.impute else [None] * k
    scalers = en.Scaler.fit_folds(o.scaling, folds, features, "_fold", k, imputers) if o.scaling else [None] * k
    preps = [Preparation(list(features), y, o, i, s, list(features)) for i, s in zip(imputers, scalers)]
    if any(s and None in (v for pair in s.params.values() for v in pair) for s in scalers):
        return None
    rows = folds.select(*[named(f).cast("double").alias(x) for f, x in zip(features, md.inputs(len(features)))], named(y).cast("double").alias(md.LABEL),
                        "_fold", named(y).alias("_class_of"), named(row_id).alias("_row"))
    if o.rebalance:
        ratio = o.sampling_ratio if o.sampling_strategy == "ratio" else None
        rows = sp.oversample_folds(rows, "_class_of", "_row", "_fold", k, o.sampling_strategy, ratio, o.seed).drop("_class_of")
    else:
        rows = rows.drop("_class_of", "_row").withColumns({f"_copies{f}": F.lit(0) for f in range(k)})
    prepared = [bt.Prepared([p.imputer.values[f] if p.imputer else None for f in features], [p.scaler.params[f] if p.scaler else (0.0, 1.0) for f in features])
                for p in preps]
    found = bt.fit_folds(freeze(rows, "counted"), len(features), prepared, list(algorithms.items()))
    return found and [(p, {a: md.LogisticCurve(*curve) for a, curve in zip(algorithms, curves)}) for p, curves in zip(preps, found)]


def cross_validate_flow(df: DataFrame, features: Sequence[str], y: str, row_id: str, alg: str | dict[str, dict], params: dict,
                        options: Options, k: int = 10, n_repeats: int = 1, parallelism: int = 4) -> DataFrame:
    """Repeated stratified k-fold; every fold prepares its training rows once and fits every learner on
    them (``alg``: a name with ``params``, or several with theirs): (repeat, fold, split, algorithm,
    row_id, y, score, pred). Logistic regressions on large tables are prepared and fitted for all folds together (``shared_folds``)."""
    algorithms = alg if isinstance(alg, dict) else {alg: params}
    base = df.where(named(y).isNotNull())
    folds = {r: freeze(sp.kfold_stratified(base, y, row_id, k, options.seed + r, out="_fold"), "folds") for r in range(n_repeats)}
    for a, p in algorithms.items():
        md.check_parameters(a, p)
    shared = {r: shared_folds(folds[r], list(features), y, row_id, algorithms, options, k) for r in range(n_repeats)}

    def task(r, f):
        def run():
            fr = folds[r]
            if shared[r]:
                prep, learners = shared[r][f]
                models = [FoldModel(list(features), y, a, p, options, prep, list(features), learners[a]) for a, p in algorithms.items()]
            else:
                prep = Preparation(list(features), y, options)
                frame = prep.fit(fr.where(F.col("_fold") != f), row_id)
                models = [FoldModel(list(features), y, a, p, options).fit_prepared(prep, frame) for a, p in algorithms.items()]
            split = F.when(F.col("_fold") == f, F.lit("test")).otherwise(F.lit("train"))
            return union_all([m.score(
                fr, [F.lit(r).alias("repeat"), F.lit(f).alias("fold"), split.alias("split"), F.lit(a).alias("algorithm"), row_id, named(y).alias("y")])
                for a, m in zip(algorithms, models)])
        return run
    return union_all(run_bounded([task(r, f) for r in range(n_repeats) for f in range(k)], parallelism))


@dataclass(frozen=True)
class Race:
    """Successive halving: candidates are fitted on a sample of the training rows, the best 1 / ``keep`` of them on one
    ``keep`` times as large, and so on; the survivors are fitted on all rows. Samples are nested: a row's hash decides.

    trials: how many fits on all rows the whole race may cost (None: the first sample is 1 / keep^2); the first
    sample is made as small as that asks for, down to the one from which a single candidate is left in the end.
    seconds: once so much time has passed, the next round is the last one, on all rows, with one survivor.
    """
    keep: int = 3
    trials: float | None = None
    seconds: float | None = None

    def shares(self, candidates: int) -> list[float]:
        """The sample of each round before the last one. A round costs its candidates times its share of the rows."""
        rounds = 2
        if self.trials is not None:
            def cost(r: int) -> float:
                return sum(max(1, candidates // self.keep ** k) / self.keep ** (r - k) for k in range(r + 1))
            most = next(r for r in range(64) if self.keep ** r >= candidates)  # after so many one is left
            rounds = next((r for r in range(most + 1) if cost(r) <= self.trials), most)
        return [1.0 / self.keep ** (rounds - k) for k in range(rounds)]

    def run(self, candidates: list, frame: DataFrame, scores_of, seed: int) -> list:
        left, start = list(candidates), time.monotonic()
        spread = F.pmod(F.xxhash64(named(md.ID), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        for share in self.shares(len(left)):
            if len(left) == 1:
                break
            found = {(r["algorithm"], r["combo"]): r["auc"] for r in scores_of(left, frame.where(spread < share)).collect()}  # one row each
            left.sort(key=lambda c: (-(found.get(c[:2]) or 0.0), candidates.index(c)))
            left = left[:max(1, len(left) // self.keep)]
            if self.seconds is not None and time.monotonic() - start > self.seconds:
                return left[:1]
        return left


def auto_select(df: DataFrame, features: Sequence[str], y: str, algorithms: Sequence[str], grids: dict[str, dict] | None = None,
                holdout: float = 0.2, options: Options | None = None, seed: int = 42, row_id: str = "row_id",
                race: Race | None = None) -> tuple[DataFrame, FoldModel | None]:
    """Every learner and grid combination fitted on the training part of a hash-stratified holdout split;
    all candidates' holdout predictions are evaluated in ONE grouped job. Returns (leaderboard
    (algorithm, params, score_val, rank) with rank 1 = best, best model refitted on all rows).

    With ``race`` weak candidates are dropped on smaller samples first (see ``Race``), so the board lists the
    learners that reached the last round only; without it every candidate is fitted on all rows.
    """
    spark, o = df.sparkSession, options or Options()
    data = df.where(named(y).isNotNull())
    s = freeze(sp.split_stratified(data, y, row_id, holdout, seed), "holdout")
    hold = s.where(F.col("split") == "test")
    prep = Preparation(list(features), y, o)
    frame = prep.fit(s.where(F.col("split") == "train"), row_id)
    cands = [(alg, i, c) for alg in algorithms for i, c in enumerate(md.param_grid((grids or {}).get(alg, {})))]

    def scores_of(some: list, rows: DataFrame) -> DataFrame:
        def task(alg, i, combo):
            def run():
                m = FoldModel(list(features), y, alg, combo, o).fit_prepared(prep, rows)
                return m.score(hold, [F.lit(alg).alias("algorithm"), F.lit(i).alias("combo"), named(y).alias("y")])
            return run
        preds = union_all(run_bounded([task(*c) for c in some]))
        return ev.auc_table(ev.score_groups(preds, ["algorithm", "combo"]), ["algorithm", "combo"])

    racing = cands if race is None else race.run(cands, frame, scores_of, seed)
    aucs = scores_of(racing, frame)
    meta = spark.createDataFrame([(a, i, md.as_json(c)) for a, i, c in cands], "algorithm string, combo int, params string")
    per_alg = aucs.join(meta, ["algorithm", "combo"])
    w = Window.partitionBy("algorithm").orderBy(F.col("auc").desc_nulls_last(), F.col("combo"))
    best = per_alg.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    wr = Window.orderBy(F.col("score_val").desc_nulls_last(), F.col("algorithm"))  # one row per learner
    board = freeze(best.select("algorithm", "combo", "params", F.col("auc").alias("score_val")).withColumn("rank", F.row_number().over(wr)), "board")
    top = board.where(F.col("rank") == 1).first()
    model = fit(data, features, y, row_id, top["algorithm"], {(a, i): c for a, i, c in cands}[top["algorithm"], top["combo"]], o) if top else None
    return board.drop("combo"), model


def stack_oof(oof: DataFrame, row_id: str = "row_id", algorithm: str = "algorithm", levels: Sequence[dict[str, dict]] = ({"lr": {}},),
              k: int = 5, seed: int = 42) -> DataFrame:
    """Stack out-of-fold scores: (row_id, y, score).

    Scores of one learner for one row from several bags (repeats) are averaged. Each level fits its
    learners on the scores of the level before, fold by fold, and every row is scored by models that
    haven't seen it. The last level's learners are averaged to the final score.
    """
    algs = sorted(r[0] for r in oof.select(algorithm).distinct().collect())  # learner names: a handful
    numbers = F.create_map(*[F.lit(x) for i, a in enumerate(algs) for x in (a, f"s{i}")])
    cur = oof.withColumn("_s", numbers[F.col(algorithm)]).groupBy(row_id, "y").pivot("_s", [f"s{i}" for i in range(len(algs))]).agg(F.avg("score"))
    n = len(algs)
    cur = freeze(sp.kfold_stratified(cur.withColumn(md.ID, F.monotonically_increasing_id()), "y", row_id, k, seed, out="_fold"), "stack")
    for learners in levels:
        feats = [f"s{i}" for i in range(n)]

        def task(f, alg, params, i, feats=feats, cur=cur):
            def run():
                data = frame_of(cur, feats, "y", [row_id, md.ID, "_fold"])
                m = md.learner_class(alg).fit(data.where(F.col("_fold") != f), len(feats), alg, params)
                return m.score(data.where(F.col("_fold") == f), [row_id]).select(row_id, F.lit(f"s{i}").alias("_s"), "score")
            return run
        scored = union_all(run_bounded([task(f, a, p, i) for f in range(k) for i, (a, p) in enumerate(learners.items())]))
        n = len(learners)
        wide = scored.groupBy(row_id).pivot("_s", [f"s{i}" for i in range(n)]).agg(F.avg("score"))
        cur = freeze(cur.select(row_id, "y", md.ID, "_fold").join(wide, row_id), "stack")
    final = sum(F.col(f"s{i}") for i in range(n)) / n
    return cur.select(row_id, "y", final.alias("score"))


def calibrate_cv(df: DataFrame, features: Sequence[str], y: str, row_id: str, alg: str, params: dict | None = None,
                 options: Options | None = None, k: int = 5) -> DataFrame:
    """Cross-fitted Platt scaling: out-of-fold scores, each fold's calibrated by a curve fitted on the
    other folds' scores: (fold, row_id, y, score, calibrated)."""
    oof = freeze(cross_validate_flow(df, features, y, row_id, alg, dict(params or {}), options or Options(), k).where(F.col("split") == "test")
                 .select("fold", row_id, "y", "score"), "oof")
    return union_all(run_bounded([lambda f=f: md.calibrate_sigmoid(oof.where(F.col("fold") != f))(oof.where(F.col("fold") == f)) for f in range(k)]))


# ------------------------------------------------------------------ bundles
def save_bundle(path: str, prep: TablePrep, models: dict[tuple[str, str], "FoldModel"]) -> None:
    """Everything needed to score new data: the table-level preparation and one
    fitted training-part flow per (algorithm, outcome)."""
    spark = SparkSession.getActiveSession()
    keys = []
    for i, ((alg, outcome), fm) in enumerate(sorted(models.items())):
        fm.save(f"{path}/model-{i}")
        keys.append((alg, outcome, i))
    meta = {"prep": prep.to_dict(), "models": keys}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/bundle")


def score_bundle(path: str, df: DataFrame, row_id: str, outcomes_present: bool = True) -> DataFrame:
    """Re-apply a saved bundle to a new table: encoder -> rows -> inf ->
    outliers -> coerce -> quantile -> impute -> scale -> normalise -> model,
    for every saved (algorithm, outcome); outcomes without positives in the
    new table are skipped (nothing to evaluate). Returns a predictions table
    (algorithm, outcome, row_id, y, score, pred)."""
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(f"{path}/bundle").first()["meta"])
    prep = TablePrep.from_dict(meta["prep"])
    data = prep.transform(df)
    out = None
    for alg, outcome, i in meta["models"]:
        if outcomes_present and outcome in data.columns:
            if data.where(named(outcome) == 1).limit(1).count() == 0:
                continue
        fm = FoldModel.load(f"{path}/model-{i}")
        keep = [F.lit(alg).alias("algorithm"), F.lit(outcome).alias("outcome"), row_id,
                named(outcome).alias("y") if outcome in data.columns else F.lit(None).cast("int").alias("y")]
        p = fm.score(data, keep)
        out = p if out is None else out.unionByName(p)
    return out
