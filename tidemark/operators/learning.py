"""A linear classifier, what measures it, and its validation by folds and by refits under permuted labels.

Many small models over one table are fitted together: a Newton step is one pass over the rows, in which each Arrow batch
gives every model's sums; the driver has the coefficients of the models and never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardised(rows: DataFrame, features: list[str], train: str) -> DataFrame:
    """Features less their training mean over their training deviation (population; 0 counts as 1); null counts as 0 before."""
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    fit = filled.filter(train).agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features))
    met = filled.crossJoin(F.broadcast(fit))
    scale = lambda c: F.when(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"s_{c}"))
    return met.select(*(c for c in rows.columns if c not in features), *(((F.col(c) - F.coalesce(F.col(f"m_{c}"), F.lit(0.0))) / scale(c)).alias(c) for c in features))


def encoded(rows: DataFrame, numbers: list[str], categories: dict[str, list]) -> DataFrame:
    """rows with numbers as doubles (null as 0, booleans as 0 and 1) and, for each category, a column of 0 and 1 for each of its values.

    A value that is not listed, and null, is 0 in all columns of its category.
    """
    plain = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers})
    hot = {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, values in categories.items() for v in values}
    return plain.withColumns(hot).drop(*categories)


def class_weights(rows: DataFrame, label: str, *keys: str) -> DataFrame:
    """n / (2 n_i) of each class."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n_class"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return counts.withColumn("weight", F.sum("n_class").over(whole) / (2 * F.col("n_class")))


def auc(rows: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Mann-Whitney area with ties per key; null with one class only.

    Equal scores are counted first, so the window has a row for each distinct score.
    """
    per = rows.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = per.withColumn("wins", F.col("p") * (below + F.col("q") / 2))
    return met.groupBy(*keys).agg((F.sum("wins") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def fit_and_score(rows: DataFrame, features: list[str], label: str, train: str, strength: float) -> DataFrame:
    """rows with ``score``: weighted L2 logistic regression of the training rows, the intercept free.

    The optimum is that of any optimiser of this convex loss; the fit is distributed.
    """
    scaled = standardised(rows, features, train)
    weights = class_weights(scaled.filter(train), label).select(label, "weight")
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(scaled.join(F.broadcast(weights), label, "left"))
    model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", regParam=strength, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(vectors.filter(train))
    scored = model.transform(vectors)
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def stratified_folds(rows: DataFrame, label: str, order: str, chunk: str, folds: int) -> DataFrame:
    """rows with ``fold``: the rows of each class are dealt round-robin in order, class 1 from fold 0 on, class 0 from fold 1.

    chunk: a column of which order is a refinement; rows are numbered inside a chunk and chunks by their sizes, so no
    task numbers a whole class.
    """
    sizes = rows.groupBy(label, chunk).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(label).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(label, chunk, F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(label, chunk).orderBy(order)) - 1
    return rows.join(offsets, [label, chunk]).withColumn("fold", ((F.col("__before") + inner + F.when(F.col(label) == 1, 0).otherwise(1)) % folds).cast("int")).drop("__before")


def with_permuted_labels(rows: DataFrame, key: str, label: str, k: int, seed: str = "l") -> DataFrame:
    """rows with ``ys``: the label, then k labels of permutations, each with as many ones.

    The ones of a replica go to the rows with the smallest digests of (seed, replica, key); places are counted by
    the digest's first digits before they are counted inside, so no task ranks all rows.
    """
    ones = rows.agg(F.sum(label).alias("__ones"))
    drawn = rows.select(key, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("replica")).withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("replica").cast("string"), F.col(key).cast("string"))))
    drawn = drawn.withColumn("digits", F.substring("h", 1, 3))
    before = F.sum("size").over(Window.partitionBy("replica").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1))
    sizes = drawn.groupBy("replica", "digits").agg(F.count("*").alias("size")).select("replica", "digits", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("replica", "digits").orderBy("h", key))
    dealt = drawn.join(sizes, ["replica", "digits"]).crossJoin(F.broadcast(ones)).select(key, "replica", (place <= F.col("__ones")).cast("int").alias("y"))
    per = dealt.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("replica", "y"))), lambda x: x["y"]).alias("__drawn"))
    return rows.join(per, key).withColumn("ys", F.concat(F.array(F.col(label).cast("int")), "__drawn")).drop("__drawn")


#: A model: the place of its labels in ys, its penalty, and the fold that it is not trained on (-1: none).
Model = tuple[int, float, int]


def fit_together(rows: DataFrame, models: list[Model], steps: int = 40, near: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (models x features and an intercept last) and whether each model has converged.

    rows: x (array of doubles), ys, fold. Minimised is the mean log loss, weighted so that both classes count alike, and
    half the penalty times the squared coefficients, the intercept free.
    """
    d = rows.select(F.size("x")).first()[0] + 1
    labels = np.asarray([m[0] for m in models])
    lost = np.asarray([m[2] for m in models])
    beta, done = np.zeros((len(models), d)), np.zeros(len(models), bool)
    counts = np.zeros((len(models), 2))

    def sums(beta: np.ndarray, open_models: np.ndarray) -> np.ndarray:
        """Per model: n of each class, gradient of each class, Hessian of each class."""
        width = 2 * (1 + d + d * d)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(open_models), width))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, d - 1)
                x = np.hstack([x, np.ones((len(x), 1))])
                ys = np.asarray(batch.column("ys").flatten()).reshape(batch.num_rows, -1)
                fold = batch.column("fold").to_numpy()
                p = 1 / (1 + np.exp(-np.clip(x @ beta[open_models].T, -500, 500)))
                for j, m in enumerate(open_models):
                    y, used = ys[:, labels[m]], fold != lost[m]
                    for c in (0, 1):
                        own = used & (y == c)
                        z, q = x[own], p[own, j]
                        at = c * (1 + d + d * d)
                        found[j, at] += len(z)
                        found[j, at + 1 : at + 1 + d] += z.T @ (q - c)
                        found[j, at + 1 + d : at + 1 + d + d * d] += ((z.T * (q * (1 - q))) @ z).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(open_models)), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["model", "sums"])

        parts = rows.select("x", "ys", "fold").mapInArrow(run, "model int, sums array<double>")
        each = parts.select("model", F.posexplode("sums").alias("at", "value")).groupBy("model", "at").agg(F.sum("value").alias("value"))
        out = np.zeros((len(open_models), width))
        for r in each.collect():
            out[r.model, r.at] = r.value
        return out

    for _ in range(steps):
        going = np.flatnonzero(~done)
        if not len(going):
            break
        for m, row in zip(going, sums(beta, going), strict=True):
            none, one = np.split(row, 2)
            counts[m] = none[0], one[0]
            if min(counts[m]) == 0:
                continue
            slope, bend = (sum(part[a:b] / (2 * part[0]) for part in (none, one)) for a, b in ((1, 1 + d), (1 + d, None)))
            ridge = np.append(np.full(d - 1, models[m][1]), 0.0)
            step = np.linalg.lstsq(bend.reshape(d, d) + np.diag(ridge), slope + ridge * beta[m], rcond=None)[0]
            beta[m] -= step
            done[m] = np.abs(step).max() < near
    return beta, done & (counts.min(axis=1) > 0)


def scored_together(rows: DataFrame, models: list[Model], beta: np.ndarray, on_lost: bool) -> DataFrame:
    """(model, y, score, loss) of each row and model; with ``on_lost`` only for the fold the model has not seen."""
    labels, lost = [m[0] for m in models], [m[2] for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            ys = np.asarray(batch.column("ys").flatten()).reshape(batch.num_rows, -1)
            fold = batch.column("fold").to_numpy()
            for m in range(len(models)):
                own = fold == lost[m] if on_lost else np.ones(len(x), bool)
                z = np.clip(x[own] @ beta[m, :-1] + beta[m, -1], -500, 500)
                y = ys[own, labels[m]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), m, np.int32)), pa.array(y.astype(np.int32)), pa.array(z), pa.array(np.logaddexp(0, z) - y * z)], ["model", "y", "score", "loss"])

    return rows.select("x", "ys", "fold").mapInArrow(run, "model int, y int, score double, loss double")


def choose_penalties(rows: DataFrame, labels: list[int], penalties: list[float], folds: int) -> DataFrame:
    """(ys_at, penalty, mean_auc, mean_loss, place): how penalties do on left-out folds, for each place of labels; the best has place 1.

    Ranked by mean area, then mean loss, then the penalty itself; a model that has not converged is left out
    of the means, a penalty without an area comes last.
    """
    models = [(y, c, f) for y in labels for c in penalties for f in range(folds)]
    beta, good = fit_together(rows, models)
    scores = scored_together(rows, models, beta, True)
    area = auc(scores, "score", "y", "model").join(scores.groupBy("model").agg(F.avg("loss").alias("loss")), "model")
    named = rows.sparkSession.createDataFrame([(m, y, float(c)) for m, (y, c, _) in enumerate(models) if good[m]], "model int, ys_at int, penalty double")
    means = named.join(area, "model").groupBy("ys_at", "penalty").agg(F.avg("auc").alias("mean_auc"), F.avg("loss").alias("mean_loss"))
    order = Window.partitionBy("ys_at").orderBy(F.col("mean_auc").desc_nulls_last(), "mean_loss", "penalty")
    return means.withColumn("place", F.row_number().over(order))


def sealed_score(rows: DataFrame, features: list[str], key: str, label: str, train: str, chunk: str, penalties: list[float], folds: int = 3, k: int = 100, seed: str = "l") -> DataFrame:
    """One row: penalty, train_auc, holdout_auc, valid (refits that count), exceedances and p = (exceedances + 1) / (valid + 1).

    The penalty is chosen on folds of the training rows, the model refitted on all of them, and the held-out rows are scored
    once. For p the whole procedure, choice included, is repeated under k permutations of the training labels, on
    the folds of the true labels. The features are scaled by the training rows.
    """
    spark = rows.sparkSession
    scaled = standardised(rows, features, train).withColumn("x", F.array(*features))
    seen = stratified_folds(scaled.filter(train), label, key, chunk, folds)
    seen = with_permuted_labels(seen, key, label, k, seed).select("x", "ys", "fold").persist()
    held = scaled.filter(~F.coalesce(F.expr(train), F.lit(False))).select("x", F.array_repeat(F.col(label).cast("int"), k + 1).alias("ys"), F.lit(-1).alias("fold"))
    chosen = {r.ys_at: r.penalty for r in choose_penalties(seen, list(range(k + 1)), penalties, folds).filter("place = 1 and mean_auc is not null").collect()}
    models = [(y, c, -1) for y, c in sorted(chosen.items())]
    beta, good = fit_together(seen, models)
    kept = [m for m in range(len(models)) if good[m]]
    found = auc(scored_together(held, models, beta, False), "score", "y", "model").filter(F.col("model").isin(kept))
    found = found.join(spark.createDataFrame([(m, models[m][0]) for m in kept], "model int, ys_at int"), "model")
    real = [m for m in kept if models[m][0] == 0]
    own = auc(scored_together(seen, [models[m] for m in real], beta[real], False), "score", "y").select(F.col("auc").alias("train_auc"))
    holdout = F.max(F.when(F.col("ys_at") == 0, F.col("auc")))
    sums = found.agg(holdout.alias("holdout_auc"), F.array_agg(F.when(F.col("ys_at") > 0, F.col("auc"))).alias("nulls"))
    valid, more = F.size("nulls"), F.size(F.filter("nulls", lambda x: x >= F.col("holdout_auc") - 1e-12))
    result = sums.crossJoin(own).select(F.lit(chosen.get(0)).alias("penalty"), "train_auc", "holdout_auc", valid.alias("valid"), more.alias("exceedances"), ((more + 1) / (valid + 1)).alias("p"))
    out = spark.createDataFrame(result.collect(), result.schema)  # one row; the training rows need not be kept
    seen.unpersist()
    return out
