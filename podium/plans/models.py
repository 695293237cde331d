"""Model fitting, scoring and explanation on Spark ML (ML1-ML14).

Preprocessing statistics (medians, deviations, class counts) are exact
aggregations over the training rows; the models are ``pyspark.ml``
estimators fed by a ``VectorAssembler``.  Scores come out of the probability
vector with ``vector_to_array`` (JVM side, no Python UDF).  Only
per-feature numbers (one per column) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col_ref, inf_to_null
from ..operators.ordering import exact_quantiles, row_positions

FEATURES_VEC = "__features"
WEIGHT = "__weight"


# ---------------------------------------------------------------------------
# ML1 median imputation (exact), ML2 scaling, ML9 class weights
# ---------------------------------------------------------------------------
@dataclass
class MedianImputer:
    """ML1: medians fitted on the training rows only.  Exact (interpolated)
    medians of every column from one unpivot + grouped running counts --
    ``pyspark.ml.feature.Imputer`` uses an approximate quantile (T9).  Columns
    with no value in training are dropped, as scikit-learn does."""
    medians: dict[str, float] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str]) -> "MedianImputer":
        cols = list(cols)
        return MedianImputer.from_table(median_table(df, cols), cols)

    @staticmethod
    def from_table(table: DataFrame, cols: Sequence[str]) -> "MedianImputer":
        got = {r["feature"]: r["median"] for r in table.collect()}  # one row per feature
        med = {c: float(got[c]) for c in cols if got.get(c) is not None}
        return MedianImputer(med, [c for c in cols if c not in med])

    def transform(self, df: DataFrame) -> DataFrame:
        out = [F.coalesce(inf_to_null(c), F.lit(self.medians[c])).alias(c) if c in self.medians else col_ref(c)
               for c in df.columns if c not in self.dropped]
        return df.select(*out)


def median_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, median) for every column, non-finite values ignored."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), inf_to_null(c).alias("value"))
                                         for c in cols])).alias("__fv")).select("__fv.feature", "__fv.value")
    med = exact_quantiles(long, ["feature"], "value", [0.5], ["median"]).drop("n")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(med, "feature", "left")


@dataclass
class Scaler:
    """ML2: divide by the **population** standard deviation (scikit-learn's
    ``StandardScaler``; Spark's divides by the sample one), optionally centre;
    a constant column keeps scale 1.  Fitted with one aggregation."""
    scale: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    with_mean: bool = False

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str], with_mean: bool = False) -> "Scaler":
        cols = list(cols)
        if not cols:
            return Scaler({}, {}, with_mean)
        r = df.agg(*[F.stddev_pop(col_ref(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
                   *[F.avg(col_ref(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        scale = {c: (float(r[f"s{i}"]) if r[f"s{i}"] not in (None, 0.0) else 1.0) for i, c in enumerate(cols)}
        mean = {c: float(r[f"m{i}"] or 0.0) for i, c in enumerate(cols)}
        return Scaler(scale, mean, with_mean)

    def transform(self, df: DataFrame) -> DataFrame:
        def one(c):
            x = col_ref(c).cast("double")
            if self.with_mean:
                x = x - F.lit(self.mean[c])
            return (x / F.lit(self.scale[c])).alias(c)
        return df.select(*[one(c) if c in self.scale else col_ref(c) for c in df.columns])


def scale_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML2 as a table: (feature, mean, scale) from one aggregation."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), col_ref(c).cast("double").alias("v"))
                                         for c in cols])).alias("__fv")).select("__fv.feature", "__fv.v")
    a = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("__s"))
    return a.select("feature", "mean", F.when(F.coalesce(F.col("__s"), F.lit(0.0)) == 0, 1.0)
                    .otherwise(F.col("__s")).alias("scale"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """ML9: ``balanced`` weights n / (2 * n_class) per class (a two-row table)."""
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0)).cast("int")
    c = df.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n_class"))
    n = c.agg(F.sum("n_class")).scalar()  # total rows from the two-row table
    return c.select("y", "n_class", (n / (2.0 * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label_col: str, out_col: str = WEIGHT) -> DataFrame:
    """Attach ML9 weights: those of the classes, as a map in one scalar subquery."""
    w = class_weights(df, label_col).agg(F.map_from_entries(F.collect_list(F.struct("y", "weight")))).scalar()
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0)).cast("int")
    return df.withColumn(out_col, F.element_at(w, y))


# ---------------------------------------------------------------------------
# Model specs (ML3-ML8)
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class ModelSpec:
    """A named model: ``family`` groups models for selection (ML12);
    ``scale`` says whether features are standardised first; ``weighted``
    whether balanced class weights are used."""
    name: str
    family: str
    kind: str
    params: dict = field(default_factory=dict)
    scale: bool = True
    weighted: bool = True


# ---------------------------------------------------------------------------
# The reference's model grid and its hyper-parameters
# ---------------------------------------------------------------------------
LOGREG_C = 1.0
SVM_C = 1.0
SKLEARN_TOL = 1e-4
ELASTICNET_L1_RATIO = 0.2
MODEL_GRID = [
    ModelSpec("logreg_l2", "linear", "logreg", {"C": LOGREG_C, "l1_ratio": 0.0, "max_iter": 1500}),
    ModelSpec("logreg_elasticnet", "linear", "logreg", {"C": LOGREG_C, "l1_ratio": ELASTICNET_L1_RATIO, "max_iter": 1500}),
    ModelSpec("linear_svm_calibrated", "linear", "svm_calibrated", {"folds": 3, "max_iter": 100}),
    ModelSpec("hgb", "tree", "gbt", {"max_iter": 400, "max_depth": 6, "step_size": 0.05}, scale=False, weighted=False),
    ModelSpec("rf", "tree", "rf", {"num_trees": 400, "max_depth": 20, "seed": 0}, scale=False),
]
# further variants used by the studies and the notebooks
EXTRA_MODELS = [
    ModelSpec("logreg_l1", "linear", "logreg", {"C": LOGREG_C, "l1_ratio": 1.0, "max_iter": 1500}),
    # boosting as trained: 600 rounds of depth 4 at 0.05, nine tenths of the rows a round, early end on validation
    ModelSpec("gbt_600", "tree", "gbt", {"max_iter": 600, "max_depth": 4, "step_size": 0.05, "subsample": 0.9,
                                         "features": "0.9", "validation": 0.1}, scale=False, weighted=False),
    ModelSpec("logreg_unweighted", "linear", "logreg", {"C": LOGREG_C, "l1_ratio": 0.0, "max_iter": 1500},
              weighted=False),
]
# ---------------------------------------------------------------------------


def model_grid(names: Sequence[str] | None = None, **overrides) -> list[ModelSpec]:
    """The model grid, optionally restricted to ``names``; ``overrides`` maps
    a model name to parameter changes (for example fewer trees in a test)."""
    out = []
    for m in MODEL_GRID + (EXTRA_MODELS if names is not None else []):
        if names is not None and m.name not in names:
            continue
        p = {**m.params, **overrides.get(m.name, {})}
        out.append(ModelSpec(m.name, m.family, m.kind, p, m.scale, m.weighted))
    return out


def _estimator(spec: ModelSpec, n_weight: float | None, label: str, weight: str | None):
    p = spec.params
    if spec.kind == "logreg":
        # scikit-learn minimises 1/2|w|^2 + C * sum(w_i * loss_i) (plus an l1 part);
        # Spark minimises mean-weighted loss + regParam * penalty, so
        # regParam = 1 / (C * sum of weights), elasticNetParam = l1 ratio, no standardisation
        reg = 1.0 / (p.get("C", LOGREG_C) * max(1.0, n_weight or 1.0))
        return LogisticRegression(featuresCol=FEATURES_VEC, labelCol=label, weightCol=weight or "",
                                  regParam=reg, elasticNetParam=float(p.get("l1_ratio", 0.0)),
                                  standardization=False, maxIter=int(p.get("max_iter", 100)),
                                  tol=float(p.get("tol", SKLEARN_TOL)))
    if spec.kind == "rf":
        return RandomForestClassifier(featuresCol=FEATURES_VEC, labelCol=label, weightCol=weight or "",
                                      numTrees=int(p.get("num_trees", 400)), maxDepth=int(p.get("max_depth", 20)),
                                      featureSubsetStrategy="sqrt", seed=int(p.get("seed", 0)))
    if spec.kind == "gbt":
        held_out = {"validationIndicatorCol": "__held_out"} if p.get("validation") else {}
        return GBTClassifier(featuresCol=FEATURES_VEC, labelCol=label, weightCol=weight or "",
                             maxIter=int(p.get("max_iter", 400)), maxDepth=int(p.get("max_depth", 6)),
                             stepSize=float(p.get("step_size", 0.05)), seed=int(p.get("seed", 0)),
                             subsamplingRate=float(p.get("subsample", 1.0)),
                             featureSubsetStrategy=str(p.get("features", "all")), **held_out)
    raise ValueError(f"no single estimator for kind {spec.kind!r}")


# ---------------------------------------------------------------------------
# Fitted model
# ---------------------------------------------------------------------------
@dataclass
class FittedModel:
    """Preprocessing + fitted Spark ML stages; ``score`` adds a ``score``
    column (probability of class 1, else the margin)."""
    spec: ModelSpec
    features: list[str]
    imputer: MedianImputer
    scaler: Scaler | None
    models: list = field(default_factory=list)        # PipelineModel(s)
    calibrators: list = field(default_factory=list)   # (a, b) per SVC fold

    def prepare(self, df: DataFrame) -> DataFrame:
        x = self.imputer.transform(df)
        if self.scaler is not None:
            x = self.scaler.transform(x)
        return x

    def score(self, df: DataFrame, out_col: str = "score") -> DataFrame:
        keep = [c for c in df.columns]
        x = self.prepare(df)
        if self.spec.kind == "svm_calibrated":
            # fold models applied one after another on the same rows (no join)
            cur = x
            for i, (m, (a, b)) in enumerate(zip(self.models, self.calibrators)):
                t = m.transform(cur)
                z = F.lit(a) * vector_to_array("rawPrediction")[1] + F.lit(b)
                cur = t.select(*[col_ref(c) for c in cur.columns],
                               (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias(f"__p{i}"))
            probs = [F.col(f"__p{i}") for i in range(len(self.models))]
            avg = sum(probs[1:], probs[0]) / float(len(probs))
            return cur.select(*[col_ref(c) for c in keep if c in cur.columns], avg.alias(out_col))
        out = self.models[0].transform(x)
        col = "probability" if "probability" in out.columns else "rawPrediction"
        return out.select(*[col_ref(c) for c in keep if c in out.columns],
                          vector_to_array(col)[1].alias(out_col))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_VEC, handleInvalid="keep")


@dataclass
class Prepared:
    """A training part with what every model fitted on it shares: the columns a fit
    needs, kept in memory or on disk, the medians, and the scale."""
    train: DataFrame
    features: list[str]
    imputer: MedianImputer
    scaler: Scaler
    n_rows: int

    def release(self) -> None:
        self.train.unpersist()


def prepare(train: DataFrame, features: Sequence[str], label_col: str) -> Prepared:
    """Medians and scale of a training part, fitted once for any number of models."""
    features = list(features)
    y = F.coalesce(col_ref(label_col).try_cast("double"), F.lit(0.0))
    # only the columns the fits need, materialised once: the statistics below
    # and every solver iteration read this instead of the upstream plan
    train = train.select(*[col_ref(c) for c in dict.fromkeys(features)], F.when(y > 0, 1.0).otherwise(0.0).alias("__label"))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    imputer = MedianImputer.fit(train, features)
    feats = [f for f in features if f not in imputer.dropped]
    return Prepared(train, feats, imputer, Scaler.fit(imputer.transform(train), feats), train.count())


def fit_model(train: DataFrame, features: Sequence[str], label_col: str, spec: ModelSpec) -> FittedModel:
    """ML10 (one model): medians and scale fitted on ``train``; balanced
    weights (ML9); then the Spark ML fit."""
    p = prepare(train, features, label_col)
    try:
        return fit_prepared(p, spec)
    finally:
        p.release()


def fit_prepared(p: Prepared, spec: ModelSpec) -> FittedModel:
    """One model on a prepared training part."""
    fm = FittedModel(spec, p.features, p.imputer, p.scaler if spec.scale else None)
    x = fm.prepare(p.train)
    weight = n_w = None
    if spec.weighted:
        x = with_class_weights(x, "__label")
        weight = WEIGHT
        n_w = float(p.n_rows)  # balanced weights sum to n
    if spec.kind == "svm_calibrated":
        _fit_svm_calibrated(fm, x, p.features, weight)
        return fm
    if spec.kind == "gbt" and spec.params.get("validation"):
        # held out by the rows' hash, so the same rows in every run
        share = float(spec.params["validation"])
        x = x.withColumn("__held_out", F.pmod(F.xxhash64(*[col_ref(c) for c in x.columns]), F.lit(10_000)) < int(share * 10_000))
    est = _estimator(spec, n_w, "__label", weight)
    fm.models = [Pipeline(stages=[_assembler(p.features), est]).fit(x)]
    return fm


def n_train(rows: DataFrame, weight: str | None) -> float:
    """Sum of the weights (or the rows) of a training part."""
    return float(rows.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0.0)


def _fit_svm_calibrated(fm: FittedModel, x: DataFrame, feats: list[str], weight: str | None) -> None:
    """ML6: ``folds`` linear SVMs, each fitted on the other folds, each with a
    sigmoid (Platt) calibration fitted on its held-out fold; scores average
    the calibrated probabilities.  Folds are stratified: the rows of each class,
    in the order of their hash, are dealt to the folds in turn.  Raises if a class
    has fewer rows than folds.  scikit-learn minimises 1/2|w|^2 + C * sum of
    weighted losses, Spark the mean-weighted loss + regParam/2 * |w|^2, hence
    regParam = 1 / (C * sum of weights) and no standardisation."""
    k = int(fm.spec.params.get("folds", 3))
    few = [r["__label"] for r in x.groupBy("__label").count().collect() if r["count"] < k]  # two classes
    if few:
        raise ValueError(f"class {few[0]} has fewer rows than {k} folds")
    rows = [c for c in x.columns if c != weight]
    ordered = x.withColumn("__h", F.xxhash64(*[col_ref(c) for c in rows]))
    nth = row_positions(ordered, ["__label"], [("__h", True), *[(c, True) for c in rows]], "__nth")
    xf = nth.withColumn("__fold", F.pmod(F.col("__nth"), F.lit(k))).drop("__h", "__nth")
    xf = xf.persist(StorageLevel.MEMORY_AND_DISK)
    for i in range(k):
        tr, ho = xf.where(F.col("__fold") != i), xf.where(F.col("__fold") == i)
        svc = LinearSVC(featuresCol=FEATURES_VEC, labelCol="__label", weightCol=weight or "",
                        maxIter=int(fm.spec.params.get("max_iter", 100)), standardization=False,
                        regParam=1.0 / (float(fm.spec.params.get("C", SVM_C)) * max(1.0, float(n_train(tr, weight)))))
        m = Pipeline(stages=[_assembler(feats), svc]).fit(tr)
        margin = m.transform(ho).select(vector_to_array("rawPrediction")[1].alias("__m"), "__label")
        cal = LogisticRegression(featuresCol="__mv", labelCol="__label", regParam=0.0).fit(
            VectorAssembler(inputCols=["__m"], outputCol="__mv").transform(margin))
        fm.models.append(m)
        fm.calibrators.append((float(cal.coefficients[0]), float(cal.intercept)))
    xf.unpersist()


def linear_coefficients(fm: FittedModel, top_n: int = 20) -> DataFrame:
    """ML14: top ``top_n`` coefficients by absolute value, with sign."""
    stage = fm.models[0].stages[-1]
    if not hasattr(stage, "coefficients"):
        raise ValueError("model has no coefficients")
    rows = sorted(zip(fm.features, [float(v) for v in stage.coefficients.toArray()]), key=lambda t: -abs(t[1]))
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows[:top_n], "feature string, coef double")


def save_model(fm: FittedModel, path: str) -> None:
    """Spark ML stages are saved by path (the manifest/joblib layer of the
    reference is not rebuilt); preprocessing numbers go beside them."""
    import json
    for i, m in enumerate(fm.models):
        m.write().overwrite().save(f"{path}/stage{i}")
    meta = {"spec": fm.spec.__dict__, "features": fm.features, "medians": fm.imputer.medians,
            "dropped": fm.imputer.dropped, "scale": fm.scaler.scale if fm.scaler else None,
            "mean": fm.scaler.mean if fm.scaler else None,
            "with_mean": fm.scaler.with_mean if fm.scaler else False, "calibrators": fm.calibrators}
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str) -> FittedModel:
    import json
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    spec = ModelSpec(**meta["spec"])
    models, i = [], 0
    while True:
        try:
            models.append(PipelineModel.load(f"{path}/stage{i}"))
        except Exception:  # noqa: BLE001 - no more stages
            break
        i += 1
    scaler = Scaler(meta["scale"], meta["mean"], meta["with_mean"]) if meta["scale"] is not None else None
    return FittedModel(spec, meta["features"], MedianImputer(meta["medians"], meta["dropped"]), scaler, models,
                       [tuple(c) for c in meta["calibrators"]])


# ---------------------------------------------------------------------------
# Names of the survey inventory
# ---------------------------------------------------------------------------
def median_impute(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML1: fill NULL / non-finite values of ``cols`` in ``df`` with exact
    medians fitted on ``train``."""
    return MedianImputer.fit(train, cols).transform(df)


def scale(train: DataFrame, df: DataFrame, cols: Sequence[str], with_mean: bool = False) -> DataFrame:
    """ML2: divide by the population std fitted on ``train`` (optionally
    centre)."""
    return Scaler.fit(train, cols, with_mean).transform(df)


def class_weight_balanced(df: DataFrame, label_col: str, out_col: str = WEIGHT) -> DataFrame:
    """ML9: attach balanced class weights."""
    return with_class_weights(df, label_col, out_col)


def _spec(name: str, **params) -> ModelSpec:
    m = model_grid([name])[0]
    return ModelSpec(m.name, m.family, m.kind, {**m.params, **params}, m.scale, m.weighted)


def logreg_l2(**params) -> ModelSpec:
    """ML3: L2 logistic regression, balanced classes."""
    return _spec("logreg_l2", **params)


def logreg_elasticnet(l1_ratio: float = ELASTICNET_L1_RATIO, **params) -> ModelSpec:
    """ML4: elastic-net logistic regression, balanced classes."""
    return _spec("logreg_elasticnet", l1_ratio=l1_ratio, **params)


def logreg_l1(**params) -> ModelSpec:
    """ML4: L1 logistic regression, balanced classes."""
    return _spec("logreg_l1", **params)


def logreg_unweighted(**params) -> ModelSpec:
    """ML5: logistic regression without class weights."""
    return _spec("logreg_unweighted", **params)


def linear_svm_calibrated(**params) -> ModelSpec:
    """ML6: linear SVM with sigmoid calibration over folds."""
    return _spec("linear_svm_calibrated", **params)


def random_forest(**params) -> ModelSpec:
    """ML7: random forest, balanced classes."""
    return _spec("rf", **params)


def gradient_boosting(**params) -> ModelSpec:
    """ML8: gradient-boosted trees."""
    return _spec("hgb", **params)


def score(fm: FittedModel, df: DataFrame, out_col: str = "score") -> DataFrame:
    """ML11: probability of class 1 (or the margin) as a column."""
    return fm.score(df, out_col)
