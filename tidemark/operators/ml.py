"""Classifiers by pyspark.ml: assemble, fit, score, evaluate."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analytics import id_hash, ranking_metrics, threshold_sweep
from .stores import written


def hash_split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """df with is_train, decided by a key's hash: no shuffle, whole groups on one side."""
    return df.withColumn("is_train", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") < int(share * 2**32))


def group_split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """df with is_train: of the distinct keys, in order of hash, the first floor(share * n) are trained on. Rows without key aren't.

    The last key of the share is found by counts of the hashes' first 10 bits (1024 numbers reach the driver) and an order inside one
    such part, so keys are never in one place; rows are then told by comparing hashes, without a join.
    """
    return multi_split(df, key, {"train": share}, seed).withColumn("is_train", F.coalesce(F.col("split") == "train", F.lit(False))).drop("split")


def multi_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """df with split: by order of the keys' hashes, the first name for the first floor(share * n) keys and so on; null beyond and without key."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().select(id_hash(key, seed).alias("h"), F.col(key).cast("string").alias("k"))
    parts = sorted((r["p"], r["n"]) for r in keys.groupBy(F.shiftright("h", 50).alias("p")).agg(F.count("*").alias("n")).collect())
    total, split, so_far = sum(n for _, n in parts), F.lit(None).cast("string"), 0.0
    order = F.struct(id_hash(key, seed).alias("h"), F.col(key).cast("string").alias("k"))
    for name, share in reversed(list(_upto(shares).items())):
        rank, below = int(share * total + 1e-9), 0
        if not rank:
            continue
        for part, n in parts:
            if below + n >= rank:
                break
            below += n
        last = keys.where(F.shiftright("h", 50) == part).orderBy("h", "k").offset(rank - below - 1).limit(1).first()
        split = F.when(order <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).alias("k")), F.lit(name)).otherwise(split)
    return df.withColumn("split", F.when(F.col(key).isNotNull(), split))


def _upto(shares: dict[str, float]) -> dict[str, float]:
    """Each name with the sum of the shares up to it."""
    total, out = 0.0, {}
    for name, share in shares.items():
        total += share
        out[name] = total
    return out


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: classes count equally."""
    p = df.agg(F.avg(label)).first()[0] or 0.0
    return df.withColumn("weight_", F.when(F.col(label) == 1, 0.5 / max(p, 1e-9)).otherwise(0.5 / max(1 - p, 1e-9)))


def models(features: list[str], trees: int = 300) -> dict[str, Pipeline]:
    """The four classifiers as pipelines over the same vector."""
    gather = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip")
    scale = StandardScaler(inputCol="raw", outputCol="vec", withMean=True)
    common = {"labelCol": "label", "weightCol": "weight_", "seed": 42}
    return {
        "logistic_regression": Pipeline(stages=[gather, scale, LogisticRegression(featuresCol="vec", labelCol="label", weightCol="weight_", regParam=1e-3)]),
        "random_forest": Pipeline(stages=[gather, RandomForestClassifier(featuresCol="raw", numTrees=trees, maxDepth=10, minInstancesPerNode=5, **common)]),
        "gradient_boosting": Pipeline(stages=[gather, GBTClassifier(featuresCol="raw", maxIter=max(2, trees // 3), maxDepth=5, stepSize=0.05, subsamplingRate=0.8, **common)]),
        "gradient_boosting_wide": Pipeline(stages=[gather, GBTClassifier(featuresCol="raw", maxIter=max(2, trees // 3), maxDepth=6, stepSize=0.05, featureSubsetStrategy="0.8", **common)]),
    }


def probability(vector: str = "probability") -> Column:
    return vector_to_array(F.col(vector))[1]


def score(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    out = model.transform(df).withColumn("prob", probability())
    return out.withColumn("predicted", (F.col("prob") >= threshold).cast("int")).drop("raw", "vec", "rawPrediction", "probability", "prediction")


def evaluate(scored: DataFrame) -> DataFrame:
    """Best threshold by F1 (the first wins ties), with precision, recall, roc_auc and average precision."""
    best = threshold_sweep(scored).orderBy(F.desc("f1"), "threshold").limit(1)
    return best.crossJoin(F.broadcast(ranking_metrics(scored)))


def at_threshold(scored: DataFrame, threshold: Column | float) -> DataFrame:
    """One row: precision, recall and f1 of prob >= threshold."""
    said, true = F.col("prob") >= threshold, F.col("label") == 1
    c = scored.agg(F.count_if(said & true).alias("tp"), F.count_if(said).alias("said"), F.count_if(true).alias("pos"))
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0))
    return c.select(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def complete(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """The rows that have a label and all features."""
    return df.dropna(subset=[*features, label])


def train_and_evaluate(train: DataFrame, test: DataFrame, features: list[str], trees: int = 20, middle: DataFrame | None = None, into: Registry | None = None) -> DataFrame:
    """A row a model: name and metrics on the test rows, with the threshold that is best there.

    With middle (rows of their own, between training and test) the threshold is also chosen there, and f1_chosen, precision_chosen and
    recall_chosen are what it gives on the test rows: f1 alone is too good, as its threshold has seen them. With a registry each model is saved.
    """
    weighted = class_weight(train).persist()

    def row_of(name: str, pipe: Pipeline) -> DataFrame:
        fitted = pipe.fit(weighted)
        # scores are written, as several metrics read them
        scored = written(score(fitted, test, 0.5).select("prob", "label"), "scored")
        row = evaluate(scored).withColumn("model", F.lit(name))
        if middle is not None:
            best = threshold_sweep(score(fitted, middle, 0.5)).orderBy(F.desc("f1"), "threshold").first()["threshold"]
            chosen = at_threshold(scored, best).withColumnsRenamed({c: f"{c}_chosen" for c in ("f1", "precision", "recall")})
            row = row.crossJoin(F.broadcast(chosen)).withColumn("threshold_chosen", F.lit(best))
        if into is not None:
            into.save(name, fitted)
        return written(row, "metrics")

    # the steps of one model are many short jobs, so the models go side by side
    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(inheritable_thread_target(train.sparkSession)(lambda m: row_of(*m)), models(features, trees).items()))
    weighted.unpersist()
    return reduce(DataFrame.unionByName, rows)


def n_folds(df: DataFrame, key: str = "fixture_id") -> int:
    """Half as many as there are keys, but 2 at least and 5 at most: only the first ten keys are looked for."""
    return min(max(df.select(key).distinct().limit(10).count() // 2, 2), 5)


def with_fold(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """df with fold: of n rows in order of time the last k * (n // (k + 1)) are k folds of equal size, numbered from 1; what comes before is 0.

    Fold i is tested by what was learnt from all rows before it. The folds' first instants are exact ranks of (order, tie), so no row is numbered.
    """
    n = df.count()
    size = n // (k + 1)
    at = F.struct(F.col(order), F.col(tie))
    fold = F.lit(0)
    if size:
        for i, first in enumerate(starts_of(df, order, tie, [n - (k - i) * size for i in range(k)]), 1):
            fold = F.when(at >= F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(first, (order, tie), strict=True))), F.lit(i)).otherwise(fold)
    return df.withColumn("fold", fold)


def starts_of(df: DataFrame, order: str, tie: str, ranks: list[int]) -> list[tuple]:
    """(order, tie) of the rows of some ranks (from 0) in order of time: ranges of time are counted first, then one range a rank is sorted."""
    from .quantiles import split_points

    splits = split_points(df, order)
    part = F.lit(0)
    for x in splits[:: max(1, len(splits) // 64)]:
        part = part + (F.col(order) >= x).cast("int")
    rows = df.select(order, tie, part.alias("_part"))
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    found = []
    for rank in ranks:
        below = 0
        for p, n in counts:
            if below + n > rank:
                break
            below += n
        found.append(tuple(rows.where(F.col("_part") == p).select(order, tie).orderBy(order, tie).offset(rank - below).limit(1).first()))
    return found


def cross_validate(df: DataFrame, features: list[str], order: str = "us", tie: str = "event_id", key: str = "fixture_id", trees: int = 20, only: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each model and fold, with rows, and metrics of the threshold 0.5 and of ranking; each fold is scored by a model of all rows before it.

    Where the rows before a fold don't hold both classes, or the fold has no rows, there is nothing to learn or to score: its metrics are
    null. A fold of one class has a roc_auc of 0. Missing features count as 0. The rows are written once, so what they come from isn't computed for each fold.
    """
    rows = written(df.na.fill(0, features).select(*dict.fromkeys([*features, "label", order, tie, key])), "folds")
    k = n_folds(rows, key)
    rows = with_fold(rows, order, tie, k)
    have = {r["fold"]: (r["pos"] or 0, r["n"]) for r in rows.groupBy("fold").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect()}
    names = ("precision", "recall", "f1", "roc_auc", "average_precision")
    out = None
    for fold in range(1, k + 1):
        pos, n = (sum(have.get(f, (0, 0))[i] for f in range(fold)) for i in (0, 1))
        known = 0 < pos < n and fold in have
        train, test = class_weight(rows.where(F.col("fold") < fold)) if known else None, rows.where(F.col("fold") == fold)
        for name, pipe in models(features, trees).items():
            if only and name not in only:
                continue
            if known:
                scored = written(score(pipe.fit(train), test, 0.5).select("prob", "label"), "scored")
                row = at_threshold(scored, 0.5).crossJoin(F.broadcast(ranking_metrics(scored))).na.fill(0.0, ["roc_auc", "average_precision"]).select(*names)
            else:
                row = df.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(c) for c in names))
            row = row.withColumns({"model": F.lit(name), "fold": F.lit(fold), "folds": F.lit(k), "n_train": F.lit(n), "n_test": F.lit(have.get(fold, (0, 0))[1])})
            out = row if out is None else out.unionByName(row)
    return out


class Registry:
    """Saved models and a history of their metrics, under root in a file system that all machines reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, model: PipelineModel) -> None:
        model.write().overwrite().save(f"{self.root}/models/{name}")

    def load(self, name: str) -> PipelineModel:
        return PipelineModel.load(f"{self.root}/models/{name}")

    def record(self, metrics: DataFrame, run: str) -> None:
        """Append a run's rows (model, metrics) to the history; columns that other runs lack are null there."""
        metrics.withColumns({"run": F.lit(run), "at": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(f"{self.root}/history")

    def history(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/history")

    def best(self, by: str = "f1", run: str | None = None) -> DataFrame:
        """The row of the highest value in the history, or in a run; the earlier run and the smaller name win ties."""
        rows = self.history() if run is None else self.history().where(F.col("run") == run)
        return rows.where(F.col(by).isNotNull()).orderBy(F.desc(by), "at", "model").limit(1)

    def best_model(self, by: str = "f1") -> PipelineModel:
        return self.load(self.best(by).first()["model"])


def best_model(metrics: DataFrame, by: str = "f1") -> DataFrame:
    """metrics with is_best: the model of the highest value; the smaller name wins ties."""
    top = metrics.orderBy(F.desc(by), "model").limit(1).select(F.col("model").alias("_best"))
    return metrics.crossJoin(F.broadcast(top)).withColumn("is_best", F.col("model") == F.col("_best")).drop("_best")


def importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """feature, importance: absolute weights over the largest."""
    last = model.stages[-1]
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    top = max(abs(v) for v in values) or 1.0
    rows = [(f, float(abs(v) / top)) for f, v in zip(features, values, strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
