"""Churn models as Spark ML pipelines.

* Preprocess: median imputation (:mod:`churnlens.operators.imputer`) and standardisation
  of the numeric features; categorical features indexed alphabetically with an
  extra bucket for unseen values, one-hot encoded with that bucket dropped
  (unseen -> all-zero vector, no real level lost).
* Logistic regression: L2 with ``C = 1`` on the summed log-loss, i.e.
  ``regParam = 1 / (C * n_train)``, no internal standardisation.
* Gradient-boosted trees as the challenger (seed 42).
* An iterative fit runs hundreds of short jobs of one task per partition, so it reads a cached
  narrow copy in as many partitions as its rows ask for (:func:`packed`), and fits that do not
  depend on each other run at once (:func:`fit_all`).
* Stratified holdout / folds: exact per-label counts in a deterministic hash order
  (``md5(seed | id)``). The rows at the cuts are found by counting hash prefixes (three narrow
  aggregates), and the split is a predicate: no sort, no shuffle or copy of whole rows, the same
  at any parallelism.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions import scratch
from churnlens.functions.columns import fixed, hash_u32
from churnlens.operators import evaluation as EV
from churnlens.operators.imputer import MedianImputer

NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges"]
CATEGORICAL = ["plan", "segment", "region"]
TARGET = "churned"
GBT_ITERATIONS = 100
ROWS_PER_TASK = 50_000
FITS_AT_ONCE = 8


def _prep_stages(numeric, categorical, scale: bool):
    imp = MedianImputer(numeric, [f"{c}__imp" for c in numeric])
    num_vec = VectorAssembler(inputCols=[f"{c}__imp" for c in numeric], outputCol="num__vec")
    stages = [imp, num_vec]
    num_out = "num__vec"
    if scale:
        stages.append(StandardScaler(inputCol="num__vec", outputCol="num__scaled", withMean=True, withStd=True))
        num_out = "num__scaled"
    idx = StringIndexer(inputCols=categorical, outputCols=[f"{c}__idx" for c in categorical],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                        outputCols=[f"{c}__ohe" for c in categorical], dropLast=True)
    feats = VectorAssembler(inputCols=[num_out] + [f"{c}__ohe" for c in categorical], outputCol="features")
    return stages + [idx, ohe, feats]


def lr_pipeline(n_train: int, c: float = 1.0, numeric=NUMERIC, categorical=CATEGORICAL) -> Pipeline:
    lr = LogisticRegression(featuresCol="features", labelCol=TARGET, regParam=1.0 / (c * max(n_train, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-8)
    return Pipeline(stages=_prep_stages(numeric, categorical, scale=True) + [lr])


def _gbt(seed: int, max_iter: int, max_depth: int, step: float, min_instances: int, label: str = TARGET) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol=label, seed=seed, maxIter=max_iter,
                         maxDepth=max_depth, stepSize=step, minInstancesPerNode=min_instances)


def gbt_pipeline(seed: int = C.SEED, max_iter: int = GBT_ITERATIONS, max_depth: int = 5, step: float = 0.1,
                 min_instances: int = 1, numeric=NUMERIC, categorical=CATEGORICAL, label: str = TARGET) -> Pipeline:
    return Pipeline(stages=_prep_stages(numeric, categorical, scale=False) + [_gbt(seed, max_iter, max_depth, step, min_instances, label)])


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, cached in one partition per ``ROWS_PER_TASK`` rows: neither the tasks of a job
    nor what they report to the driver follow the partitions of what ``df`` is made from."""
    rows = df.select(*dict.fromkeys(columns))
    return rows.coalesce(max(1, math.ceil(rows.count() / ROWS_PER_TASK))).persist()


def at_once(spark: SparkSession, work, items: list) -> list:
    """What ``work`` makes of each item, in order; up to ``FITS_AT_ONCE`` run at once."""
    if not items:
        return []
    with ThreadPoolExecutor(min(FITS_AT_ONCE, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def fit_all(fits: list[tuple[Pipeline, DataFrame]]) -> list[PipelineModel]:
    """The models of (pipeline, training rows) pairs, in order."""
    return at_once(fits[0][1].sparkSession, lambda pair: pair[0].fit(pair[1]), fits) if fits else []


def positive_probability(pred: DataFrame, out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability").getItem(1))


def with_probability(df: DataFrame, model: PipelineModel, out: str) -> DataFrame:
    """``df`` with the model's probability as one more column: several models score one scan, without joins."""
    return positive_probability(model.transform(df), out).select(*df.columns, out)


def _split_hash(seed: int, id_col: str):
    return hash_u32(F.lit(f"{seed}|"), F.col(id_col))


def _cuts(df: DataFrame, wanted, seed: int, label: str, id_col: str) -> dict:
    """Per label the (hash, id) of the rows at the places ``wanted(number of rows)`` (from 1,
    ascending) in the order of hash and id. Each step counts narrower hash ranges: at most 65536
    counts per label, then 65536 per place, then the ids that share one hash."""
    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(label).alias("label"), F.col(id_col).alias("id"), _split_hash(seed, id_col).alias("h"))

    def step(rows, group, targets):
        """(label, key) -> places within, for targets ``{label: [(place, ...)]}`` over sorted counts."""
        found = {}
        for lab, places in targets.items():
            counts = sorted((r[group], r["n"]) for r in rows if r["label"] == lab)
            ends, keys = np.cumsum([n for _, n in counts]), [k for k, _ in counts]
            found[lab] = [(keys[k], int(p - (ends[k - 1] if k else 0))) for p in places for k in [int(np.searchsorted(ends, p))]]
        return found

    def count(group, where=None):
        rows = keyed if where is None else keyed.where(where)
        return rows.groupBy("label", *group).agg(F.count(F.lit(1)).alias("n")).collect()

    def inside(column, picked):
        return reduce(lambda a, b: a | b, [F.col("label").eqNullSafe(lab) & column.isin(sorted({k for k, _ in at})) for lab, at in picked.items()])

    prefix = F.shiftright(F.col("h"), 16)
    coarse = count([prefix.alias("prefix")])
    sizes: dict = {}
    for r in coarse:
        sizes[r["label"]] = sizes.get(r["label"], 0) + r["n"]
    places = {lab: wanted(n) for lab, n in sizes.items()}
    if not places:
        return {}
    by_prefix = step(coarse, "prefix", places)
    fine = count(["h"], inside(prefix, by_prefix))
    by_hash = {lab: [step([r for r in fine if r["h"] >> 16 == k], "h", {lab: [place]})[lab][0] for k, place in at] for lab, at in by_prefix.items()}
    ids = count(["h", "id"], inside(F.col("h"), by_hash))
    return {lab: [(h, step([r for r in ids if r["h"] == h], "id", {lab: [place]})[lab][0][0]) for h, place in at] for lab, at in by_hash.items()}


def _upto(cut: tuple, seed: int, id_col: str):
    """Is the row at or before the cut?"""
    h = _split_hash(seed, id_col)
    return F.coalesce((h < cut[0]) | ((h == cut[0]) & (F.col(id_col) <= F.lit(cut[1]))), F.lit(False))


def in_holdout(df: DataFrame, test_frac: float = 0.2, seed: int = C.SEED, label: str = TARGET, id_col: str = "customer_id"):
    """Predicate of an exact per-label holdout of ``ceil(test_frac * n_label)`` rows (rows without
    an id are never in it)."""
    cuts = _cuts(df, lambda n: [math.ceil(test_frac * n)] if test_frac > 0 else [], seed, label, id_col)
    return reduce(lambda a, b: a | b, [F.col(label).eqNullSafe(lab) & _upto(at[0], seed, id_col) for lab, at in cuts.items() if at], F.lit(False))


def fold_of(df: DataFrame, k: int, seed: int = C.SEED, label: str = TARGET, id_col: str = "customer_id"):
    """Stratified fold, 0 to k - 1: fold f of a label ends at its row ``ceil(n_label * (f + 1) / k)`` in
    hash order (rows without an id are in the last)."""
    cuts = _cuts(df, lambda n: [-(-n * f // k) for f in range(1, k)], seed, label, id_col)
    folds = [F.when(F.col(label).eqNullSafe(lab), sum((F.when(_upto(cut, seed, id_col), 0).otherwise(1) for cut in at), F.lit(0)))
             for lab, at in cuts.items()]
    return F.coalesce(*folds, F.lit(k - 1)).cast("int")


def stratified_split(df: DataFrame, test_frac: float = 0.2, seed: int = C.SEED, label: str = TARGET,
                     id_col: str = "customer_id") -> tuple[DataFrame, DataFrame]:
    """(training part, :func:`in_holdout` part)."""
    is_test = in_holdout(df, test_frac, seed, label, id_col)
    return df.where(~is_test), df.where(is_test)


def with_folds(df: DataFrame, k: int, seed: int = C.SEED, label: str = TARGET, id_col: str = "customer_id") -> DataFrame:
    return df.withColumn("fold", fold_of(df, k, seed, label, id_col))


def feature_table(customers: DataFrame, numeric=C.NUMERIC_FEATURES, categorical=C.CATEGORICAL_FEATURES) -> DataFrame:
    """One row per customer: the decision contract's columns, then the model's features; missing
    columns are named in a ``ValueError``."""
    columns = list(dict.fromkeys([*C.CONTRACT_COLUMNS, *numeric, *categorical]))
    missing = [c for c in columns if c not in customers.columns]
    if missing:
        raise ValueError(f"Feature table is missing columns: {missing}")
    return customers.select(*columns)


def train_and_evaluate(df: DataFrame, test_frac: float = 0.2, seed: int = C.SEED, numeric=NUMERIC, categorical=CATEGORICAL):
    """Fit LR on the stratified training part; return ``(model, holdout, metrics)``
    where ``holdout`` has ``churn_probability`` from the model."""
    train, test = stratified_split(df, test_frac, seed)
    train = packed(train, TARGET, *numeric, *categorical)
    model = lr_pipeline(train.count(), numeric=numeric, categorical=categorical).fit(train)
    train.unpersist()
    holdout = positive_probability(model.transform(test), "churn_probability").select(
        "customer_id", TARGET, fixed("churn_probability", 6).alias("churn_probability"), "CLV", "retention_cost")
    auc = EV.roc_auc(holdout).select("roc_auc").scalar()
    metrics = EV.classification_metrics(holdout).withColumn("roc_auc", auc)
    return model, holdout, metrics


def feature_importances(model: PipelineModel, top_n: int = 12, numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Top LR coefficients by absolute value, named ``feature`` / ``col_level``."""
    from pyspark.ml.feature import StringIndexerModel
    from pyspark.sql import SparkSession
    indexer = next(st for st in model.stages if isinstance(st, StringIndexerModel))
    names = list(numeric)
    for col, labels in zip(categorical, indexer.labelsArray):
        names += [f"{col}_{lv}" for lv in labels]
    coefs = model.stages[-1].coefficients.toArray().tolist()  # model-sized (p values)
    return (SparkSession.getActiveSession().createDataFrame(list(zip(names, coefs)), "feature string, coefficient double")
            .orderBy(F.abs("coefficient").desc(), "feature").limit(top_n))


def compare_models(df: DataFrame, k: int = 5, seed: int = C.SEED, gbt_iter: int = GBT_ITERATIONS,
                   numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Stratified k-fold bake-off, LR vs GBT: mean / population-sd AUC and Brier,
    mean accuracy and F1 per model. Fold predictions are scored in one pass."""
    folded = packed(with_folds(df, k, seed), TARGET, *numeric, *categorical, "fold")
    pairs = []
    for f in range(k):
        train = folded.where(F.col("fold") != f)
        pairs += [("Gradient Boosting", f, gbt_pipeline(seed, gbt_iter, numeric=numeric, categorical=categorical), train),
                  ("Logistic Regression", f, lr_pipeline(train.count(), numeric=numeric, categorical=categorical), train)]
    pairs.sort(key=lambda pair: pair[0])  # the long fits start first
    models = fit_all([(pipe, train) for _, _, pipe, train in pairs])
    preds = [positive_probability(m.transform(folded.where(F.col("fold") == f))).select(
        F.lit(name).alias("model"), F.lit(f).alias("fold"), TARGET, fixed("p", 6).alias("churn_probability"))
        for (name, f, _, _), m in zip(pairs, models)]
    allp = reduce(DataFrame.unionByName, preds).persist()
    auc = EV.roc_auc(allp, by=["model", "fold"])
    pred1 = F.col("churn_probability") >= 0.5
    per = allp.groupBy("model", "fold").agg(
        F.avg((F.col("churn_probability") - F.col(TARGET)) ** 2).alias("brier"),
        F.avg(F.when(pred1 == (F.col(TARGET) == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.when(pred1 & (F.col(TARGET) == 1), 1)).alias("tp"),
        F.count(F.when(pred1 & (F.col(TARGET) == 0), 1)).alias("fp"),
        F.count(F.when(~pred1 & (F.col(TARGET) == 1), 1)).alias("fn"))
    per = per.withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                                      2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))
    return (per.join(auc, ["model", "fold"]).groupBy("model")
            .agg(fixed(F.avg("roc_auc"), 6).alias("auc_mean"), fixed(F.stddev_pop("roc_auc"), 6).alias("auc_std"),
                 fixed(F.avg("brier"), 6).alias("brier_mean"), fixed(F.stddev_pop("brier"), 6).alias("brier_std"),
                 fixed(F.avg("accuracy"), 6).alias("accuracy_mean"), fixed(F.avg("f1"), 6).alias("f1_mean")))


def tune_gbm(df: DataFrame, n_trials: int = 20, k: int = 3, seed: int = C.SEED,
             iter_range: tuple[int, int] = (100, 400), numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Seeded random search over GBT step size (log 0.01-0.3), depth (3-6, the
    tree-size knob), min instances per node (10-100) and iterations (100-400),
    maximising mean k-fold AUC. One row per trial, best flagged.

    A fold is prepared once for all trials, and a fit's scores of its fold are written as soon as
    it ends: no more than ``FITS_AT_ONCE`` models are held, and no task gets more than one."""
    rnd, spark = random.Random(seed), df.sparkSession
    folded = packed(with_folds(df, k, seed), TARGET, *numeric, *categorical, "fold")
    trials = [{"step": math.exp(rnd.uniform(math.log(0.01), math.log(0.3))),
               "max_depth": rnd.randint(3, 6), "min_instances": rnd.randint(10, 100),
               "max_iter": rnd.randint(*iter_range)} for _ in range(n_trials)]
    pairs = sorted(((t, f) for t in range(n_trials) for f in range(k)), key=lambda pair: -trials[pair[0]]["max_iter"])  # the long fits start first
    at = scratch.folder(spark, "trial-scores")

    def prepare(f: int) -> DataFrame:
        prep = Pipeline(stages=_prep_stages(numeric, categorical, scale=False)).fit(folded.where(F.col("fold") != f))
        return prep.transform(folded).select(TARGET, "fold", "features").persist()

    def score(pair: tuple[int, int]) -> str:
        (t, f), path = pair, f"{at}/{pair[0]}-{pair[1]}"
        model = _gbt(seed, **trials[t]).fit(prepared[f].where(F.col("fold") != f))
        positive_probability(model.transform(prepared[f].where(F.col("fold") == f))).select(
            F.lit(t).alias("trial"), F.lit(f).alias("fold"), TARGET, fixed("p", 6).alias("churn_probability")).write.parquet(path)
        return path

    prepared = at_once(spark, prepare, list(range(k)))
    try:
        scores = spark.read.parquet(*at_once(spark, score, pairs))
        auc = (EV.roc_auc(scores, by=["trial", "fold"])  # ordered in a checkpoint of its own
               .groupBy("trial").agg(fixed(F.avg("roc_auc"), 6).alias("cv_auc")).persist())
    finally:
        scratch.drop(spark, at)
        for rows in [*prepared, folded]:
            rows.unpersist()
    settings = spark.createDataFrame(
        [(t, round(p["step"], 6), p["max_depth"], p["min_instances"], p["max_iter"]) for t, p in enumerate(trials)],
        "trial int, step_size double, max_depth int, min_instances int, max_iter int")
    out = settings.join(F.broadcast(auc), "trial", "left").orderBy("trial")  # one row per trial
    best = out.select(F.max("cv_auc")).scalar()
    return out.withColumn("best", F.col("cv_auc") == best)


def compare_calibration(df: DataFrame, test_frac: float = 0.2, seed: int = C.SEED, k: int = 3,
                        numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Brier of raw LR vs isotonic and sigmoid recalibration (k-fold calibrated
    ensembles averaged), rounded to 4; ``best`` = minimum."""
    train, frame = stratified_split(df, test_frac, seed)
    train = packed(train, "customer_id", TARGET, *numeric, *categorical)
    folded = packed(with_folds(train, k, seed), TARGET, *numeric, *categorical, "fold")
    frame = with_probability(frame.select(TARGET, *numeric, *categorical),
                             lr_pipeline(train.count(), numeric=numeric, categorical=categorical).fit(train), "p_raw")
    for f in range(k):
        fit_part, cal_part = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        base = lr_pipeline(fit_part.count(), numeric=numeric, categorical=categorical).fit(fit_part)
        cal_in = _calibration_input(base.transform(cal_part))
        iso = IsotonicRegression(featuresCol="cal_x", labelCol=TARGET, predictionCol=f"iso{f}").fit(cal_in)
        sig = LogisticRegression(featuresCol="cal_margin", labelCol=TARGET, regParam=0.0,
                                 standardization=False, maxIter=200).fit(cal_in)
        both = sig.transform(iso.transform(_calibration_input(base.transform(frame))))
        frame = positive_probability(both, f"sig{f}").select(*frame.columns, f"iso{f}", f"sig{f}")
    folded.unpersist()
    train.unpersist()
    members = [("Raw logistic regression", ["p_raw"]), ("Isotonic", [f"iso{f}" for f in range(k)]),
               ("Platt (sigmoid)", [f"sig{f}" for f in range(k)])]
    briers = [fixed(F.avg((sum(F.col(c) for c in cols) / len(cols) - F.col(TARGET)) ** 2), 4).alias(f"b{n}")
              for n, (_, cols) in enumerate(members)]
    rows = [F.struct(F.lit(name).alias("method"), F.col(f"b{n}").alias("brier"),
                     (F.col(f"b{n}") == F.least("b0", "b1", "b2")).alias("best")) for n, (name, _) in enumerate(members)]
    return frame.agg(*briers).select(F.inline(F.array(*rows)))


def _calibration_input(pred: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    p1 = vector_to_array("probability").getItem(1)
    margin = vector_to_array("rawPrediction").getItem(1)
    return (pred.withColumn("cal_x", array_to_vector(F.array(p1)))
            .withColumn("cal_margin", array_to_vector(F.array(margin)))
            .drop("rawPrediction", "probability", "prediction"))
