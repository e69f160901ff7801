"""Feature preparation, classifiers and model selection on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from candlemill.models.boosting import fit_boosted
from candlemill.models.perceptron import fit_perceptron
from candlemill.operators import classification as C
from candlemill.operators.dataset import OUTCOMES
from candlemill.operators.checks import check_features
from candlemill.session import scratch_path
from candlemill.sources.series import number_series, written

MISSING, UNKNOWN = "<MISSING>", "<UNKNOWN>"


def guard(features: Sequence[str], columns: Sequence[str]) -> None:
    problems = check_features(features, columns, OUTCOMES)
    if problems:
        raise ValueError("; ".join(problems))


def median_pipeline(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Median impute with missing indicators, standardise, one-hot (unknown categories ignored).

    Feed it rows from :func:`with_missing_flags`.
    """
    filled = [f"{n}__filled" for n in numeric]
    stages = [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
    ]
    parts = ["_scaled", *[f"missing_{n}" for n in numeric]]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", dropLast=True, handleInvalid="keep")]
        parts.append(f"{c}__v")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def with_missing_flags(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    out = {f"missing_{n}": F.col(n).isNull().cast("double") for n in numeric}
    out |= {n: F.col(n).cast("double") for n in numeric}
    out |= {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}
    return df.withColumns(out)


@dataclass(frozen=True)
class Preparation:
    """Train-only moments and vocabularies; applied as plain column expressions."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    mean: dict[str, float]
    scale: dict[str, float]
    vocabulary: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*[f"z_{n}" for n in self.numeric], *[f"missing_{n}" for n in self.numeric],
                *[f"{c}={v}" for c in self.categorical for v in self.vocabulary[c]]]

    def columns(self) -> dict[str, Column]:
        out = {f"z_{n}": (F.coalesce(F.col(n).cast("double"), F.lit(self.mean[n])) - self.mean[n]) / self.scale[n] for n in self.numeric}
        out |= {f"missing_{n}": F.col(n).isNull().cast("double") for n in self.numeric}
        for c in self.categorical:
            known = self.vocabulary[c]
            token = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            token = F.when(token.isin(known), token).otherwise(F.lit(UNKNOWN))
            out |= {f"{c}={v}": (token == v).cast("double") for v in known}
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        cols = self.columns()
        vector = VectorAssembler(inputCols=self._safe(), outputCol="features", handleInvalid="error")
        x = df.withColumns({s: cols[n] for s, n in zip(self._safe(), self.names)})
        return vector.transform(x).drop(*self._safe())

    def _safe(self) -> list[str]:
        return [f"_f{i}" for i in range(len(self.names))]


def fit_preparation(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_categories: int = 64) -> Preparation:
    """Mean impute, population scale over all rows after imputation, capped vocabulary.

    One aggregate pass gives the moments. Imputing the mean adds nothing to the squared deviations,
    so the scale is sqrt(var_pop * observed / rows). The vocabulary keeps the most frequent values
    (ties by name), with explicit missing and unknown entries inside the cap.
    """
    guard([*numeric, *categorical], train.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for n in numeric:
        v = F.col(n).cast("double")
        aggs += [F.avg(v).alias(f"m_{n}"), F.var_pop(v).alias(f"v_{n}"), F.count(v).alias(f"c_{n}")]
    row = train.agg(*aggs).head()
    if not row["_rows"]:
        raise ValueError("the training split holds no rows")
    mean, scale = {}, {}
    for n in numeric:
        mean[n] = row[f"m_{n}"] or 0.0
        s = ((row[f"v_{n}"] or 0.0) * row[f"c_{n}"] / row["_rows"]) ** 0.5
        scale[n] = s if s > 2.220446049250313e-16 else 1.0
    vocabulary = {}
    for c in categorical:
        top = train.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(max_categories - 2)
        vocabulary[c] = [MISSING, UNKNOWN, *sorted(r["v"] for r in top.collect())]
    return Preparation(tuple(numeric), tuple(categorical), mean, scale, vocabulary)


def logistic(label: str, rows: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, maxIter=100)


def fit_logistic(train: DataFrame, label: str) -> LogisticRegressionModel:
    """The fitted model, read back from its file.

    A model fresh from its fit holds its training summary, and that the session, which its scoring tasks then carry along; a
    session that has had job tags cannot be serialized. What is read back holds the coefficients only.
    """
    path = scratch_path(train.sparkSession, "logistic")
    logistic(label, train.count()).fit(train).write().save(path)
    return LogisticRegressionModel.load(path)


def predict(model, prepared: DataFrame) -> DataFrame:
    """Uniform contract: any classifier gives a ``probability`` in [0, 1] per row."""
    out = model.transform(prepared)
    p = vector_to_array("probability")[1]
    return out.withColumn("_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).drop("probability", "rawPrediction", "prediction").withColumnRenamed("_p", "probability")


def predict_with(frame_predictor: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    """Pluggable predictor: any DataFrame -> DataFrame that adds a probability."""
    out = frame_predictor(rows)
    if "probability" not in out.columns:
        raise ValueError("a predictor must add a probability column")
    return out


def importances(spark, model, names: Sequence[str]) -> DataFrame:
    """Coefficients or split gains, largest first (one row per feature)."""
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    kind = "coefficient" if hasattr(model, "coefficients") else "importance"
    rows = [(n, float(v)) for n, v in zip(names, values.toArray())]
    return spark.createDataFrame(rows, f"feature string, {kind} double").withColumn("magnitude", F.abs(kind)).orderBy(F.desc("magnitude"), "feature")


def permutation_importance(
    model, prep: Preparation, rows: DataFrame, features: Sequence[str], key: str, label: str
) -> DataFrame:
    """Loss of ranking quality when one input is shuffled, over all ``rows`` (pass held-out ones).

    The shuffle gives each row the value of the next row in the order of a hash of its key.
    """
    from pyspark.sql import Window

    drawn = rows.withColumns({"_all": F.lit(0), "_draw": F.md5(F.concat_ws("|", F.lit("p"), F.col(key).cast("string")))})
    base = written(number_series(drawn, "_all", ["_draw", key], step="_r").drop("_all", "_draw"), "shuffled")
    n = base.count()
    scored = lambda df: C.ranking_metrics(predict(model, prep.apply(df)).withColumn("label", F.col(label).cast("long"))).select("roc_auc")
    out = scored(base.drop("_r")).select(F.lit("").alias("feature"), "roc_auc")
    for f in features:
        moved = base.select(((F.col("_r") + 1) % n).alias("_r"), F.col(f).alias("_v"))
        mixed = base.join(moved, "_r").withColumn(f, F.col("_v")).drop("_v", "_r")
        out = out.unionByName(scored(mixed).select(F.lit(f).alias("feature"), "roc_auc"))
    # One row per feature: a report-sized frame.
    whole = F.max(F.when(F.col("feature") == "", F.col("roc_auc"))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("auc_drop", whole - F.col("roc_auc")).filter("feature <> ''").orderBy(F.desc("auc_drop"), "feature")


def fit_models(
    rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, key: str, *, seed: int = 42, rounds: int = 800, epochs: int = 60,
) -> tuple[dict, Preparation]:
    """Preparation and three models of the train split; boosting rounds and perceptron epochs end by the validation loss."""
    part = lambda n: rows.filter(F.col("split") == n)
    prep = fit_preparation(part("train"), numeric, categorical)
    ready = lambda name: written(prep.apply(part(name).withColumn(label, F.col(label).cast("double"))).select(key, label, "features"), f"ready-{name}")
    train, validation = ready("train"), ready("validation")
    fits = {
        "logistic": fit_logistic(train, label),
        "boosted_trees": fit_boosted(train, validation, label, seed=seed, rounds=rounds),
        "perceptron": fit_perceptron(train, validation, label, key, seed=seed, epochs=epochs),
    }
    return fits, prep


def train_and_select(
    rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, thresholds: Sequence[float], key: str,
    *, seed: int = 42, rounds: int = 800, epochs: int = 60,
) -> tuple[DataFrame, dict, Preparation]:
    """Fit three models on train, choose by validation ranking only, and only then read the test split.

    ``rows`` carry ``split``. Returns the comparison table, the fitted models and the preparation.
    """
    part = lambda n: rows.filter(F.col("split") == n)
    fits, prep = fit_models(rows, numeric, categorical, label, key, seed=seed, rounds=rounds, epochs=epochs)

    def table(split: str, prefix: str) -> DataFrame:
        x = prep.apply(part(split).withColumn(label, F.col(label).cast("double")))
        scored = None
        for name, model in fits.items():
            one = predict(model, x).select(F.lit(name).alias("model"), F.col(label).cast("long").alias("label"), "probability")
            scored = one if scored is None else scored.unionByName(one)
        m = C.classification_metrics(scored, thresholds[0], ["model"])
        return m.withColumnsRenamed({c: f"{prefix}_{c}" for c in m.columns if c != "model"})

    chosen = C.choose_primary(table("validation", "validation").withColumns({
        "validation_mean_run_net_return_points": F.lit(None).cast("double"), "uplift_p_value": F.lit(None).cast("double")}))
    return chosen.join(table("test", "test"), "model"), fits, prep
