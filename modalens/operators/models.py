"""Preprocessing and models fitted strictly inside training folds."""

from __future__ import annotations

import contextlib
import functools
import math
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalens.functions import rank
from modalens.functions.rank import average_ranks, numbered, ranged, running_counts
from modalens.operators import splits
from modalens.operators.batch import centred, fold_moments
from modalens.operators.bootstrap import uniform
from modalens.storage import dropped, noted, unlent, written

#: Nodes that the trees of a forest which are fitted together can have.
PART_NODES = 1 << 17
#: Numbers of the samples' columns that a task holds as a table.
SLICE = 1 << 20
#: Share of the training cells on either side of a median that are put in order, and folds times features that are told it at once.
NEAR, MIDDLES = 0.0005, 1 << 16


def fold_medians(cells: DataFrame, folds: DataFrame, only: list | None = None) -> DataFrame:
    """(outer_fold, modality, feature, median) over the training cells of every fold (or of those named), interpolated.

    A feature's values are put in order once for all folds: a fold's place of a value is the number of cells up to it
    which are not the fold's own, so no cell is copied. Of features of more than rank.RANGE_ROWS cells only those near
    the middle are. Cells may come with their own fold, `_own`.
    """
    names = only or [r[0] for r in folds.select("outer_fold").distinct().collect()]
    keys = ["modality", "feature"]
    rows = cells.filter("value IS NOT NULL")
    rows = (rows if "_own" in cells.columns else rows.join(unlent(folds.withColumnRenamed("outer_fold", "_own")), "sample_id")).select(*keys, "value", "_own")
    if not names:
        return rows.select(F.col("_own").alias("outer_fold"), *keys, F.col("value").cast("double").alias("median")).limit(0)
    most, n_features = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m"), F.count("m")).first()
    if (most or 0) > rank.RANGE_ROWS and n_features * len(names) <= MIDDLES:
        rows = rows if "_own" in cells.columns else written(rows, "fold-cells")
        if (found := _middles(rows, keys, names)) is not None:
            return found
    placed = ranged(rows, keys, "value")
    seen = {f"_f{i}": (F.col("_own") != F.lit(name)).cast("long") for i, name in enumerate(names)}
    sums = placed.groupBy(*keys, "_range").agg(*[F.sum(x).alias(c) for c, x in seen.items()])
    lower, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = sums.select(*keys, "_range", *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"_b{c}") for c in seen], *[F.sum(c).over(whole).alias(f"_n{c}") for c in seen])
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.withColumns({c: F.sum(x).over(inside) for c, x in seen.items()}).join(sums, [*keys, "_range"])

    def middle(i: int, name) -> Column:
        place, n = F.col(f"_f{i}") + F.col(f"_b_f{i}"), F.col(f"_n_f{i}")
        on = (place == F.floor((n + 1) / 2)) | (place == F.floor(n / 2) + 1)
        return F.when((F.col("_own") != F.lit(name)) & on, F.lit(name))

    of = F.explode(F.array_compact(F.array(*[middle(i, name) for i, name in enumerate(names)])))
    ends = at.select(*keys, "value", of.alias("outer_fold")).groupBy("outer_fold", *keys)  # one value or two
    return ends.agg((0.5 * F.min("value") + 0.5 * F.max("value")).alias("median"))


def _middles(rows: DataFrame, keys: list[str], names: list) -> DataFrame | None:
    """The same by counting: what lies below the middle NEAR of a fold's training cells, and the values in it, by number.

    Where that is is told by approximate quantiles; None if a median wasn't in it.
    """
    trained = {i: F.col("_own") != F.lit(name) for i, name in enumerate(names)}
    edges = rows.groupBy(*keys).agg(*[F.percentile_approx(F.when(on, F.col("value")), [0.5 - NEAR, 0.5 + NEAR], 10_000).alias(f"_e{i}") for i, on in trained.items()])
    at = rows.join(F.broadcast(written(edges, "edges")), keys)  # two numbers for each of MIDDLES folds and features at most
    low, high = {i: F.col(f"_e{i}")[0] for i in trained}, {i: F.col(f"_e{i}")[1] for i in trained}
    of = lambda each: F.explode(F.array(*[F.struct(F.lit(name).alias("outer_fold"), *each(i)) for i, name in enumerate(names)])).alias("x")
    counts = at.groupBy(*keys).agg(*[F.count(F.when(on, 1)).alias(f"_n{i}") for i, on in trained.items()], *[F.count(F.when(on & (F.col("value") < low[i]), 1)).alias(f"_b{i}") for i, on in trained.items()])
    counts = counts.select(*keys, of(lambda i: (F.col(f"_n{i}").alias("n"), F.col(f"_b{i}").alias("b")))).select(*keys, "x.*").filter("n > 0")
    inside = F.array_compact(F.array(*[F.when(on & F.col("value").between(low[i], high[i]), F.lit(names[i])) for i, on in trained.items()]))
    held = at.select(*keys, "value", F.explode(inside).alias("outer_fold")).groupBy("outer_fold", *keys, "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("outer_fold", *keys).orderBy("value"))
    placed = counts.join(held.withColumn("_upto", upto), ["outer_fold", *keys], "left")
    last, n = F.col("b") + F.col("_upto"), F.col("n")
    on = [(last - F.col("c") < place) & (place <= last) for place in (F.floor((n + 1) / 2), F.floor(n / 2) + 1)]
    middle = F.when(on[0] | on[1], F.col("value"))
    found = placed.groupBy("outer_fold", *keys).agg((0.5 * F.min(middle) + 0.5 * F.max(middle)).alias("median"), sum(F.count(F.when(x, 1)) for x in on).alias("_found"))
    found = written(found, "medians")
    return None if found.filter("_found <> 2").head(1) else found.drop("_found")


def masked_standardized(cells: DataFrame, folds: DataFrame) -> DataFrame:
    """(outer_fold, sample_id, modality, feature, z, side): observed cells standardised by training moments of each fold.

    A spread below 1e-8 counts as 1; a missing cell is zero and has no row.
    """
    m = fold_moments(cells, folds, ["modality", "feature"]).select("modality", "feature", "outer_fold", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("sd"))
    rows = cells.join(unlent(folds.withColumnRenamed("outer_fold", "_own")), "sample_id").join(m, ["modality", "feature"])
    sd = F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd"))
    side = F.when(F.col("_own") == F.col("outer_fold"), "assessment").otherwise("train")
    return rows.select("outer_fold", "sample_id", "modality", "feature", ((F.col("value") - F.col("mean")) / sd).alias("z"), side.alias("side"))


def imputed_moments(cells: DataFrame, samples: DataFrame, folds: DataFrame, only: list | None = None) -> DataFrame:
    """(outer_fold, modality, feature, n, median, mean, sd) of the training columns after median imputation.

    The imputed cells enter in closed form, so none is made. Columns without spread are left out.
    """
    own = samples.select("sample_id").join(unlent(folds), "sample_id").groupBy("outer_fold").agg(F.count(F.lit(1)).alias("m"))
    rows = own.agg(F.sum("m").alias("t")).join(own).select("outer_fold", (F.col("t") - F.col("m")).alias("rows"))  # one row per fold
    seen = fold_moments(cells, folds, ["modality", "feature"]).withColumnRenamed("mean", "_mean")
    x = seen.join(F.broadcast(rows), "outer_fold").join(fold_medians(cells, folds, only), ["outer_fold", "modality", "feature"])
    miss = F.col("rows") - F.col("n")
    mean = (F.col("n") * F.col("_mean") + miss * F.col("median")) / F.col("rows")
    x = x.withColumn("mean", mean).withColumn("_miss", miss)
    m2 = F.col("m2") + F.col("n") * (F.col("_mean") - F.col("mean")) ** 2 + F.col("_miss") * (F.col("median") - F.col("mean")) ** 2
    x = x.withColumn("sd", F.sqrt(m2 / F.col("rows")))
    return x.filter(F.col("sd") > 1e-12 * F.greatest(F.lit(1.0), F.abs("mean"))).select("outer_fold", "modality", "feature", "n", "median", "mean", "sd")


def imputed_standardized(cells: DataFrame, folds: DataFrame, moments: DataFrame) -> DataFrame:
    """(outer_fold, sample_id, side, modality, feature, z) of the observed cells; a missing one is (median - mean) / sd."""
    rows = cells.join(unlent(folds.withColumnRenamed("outer_fold", "_own")), "sample_id").join(moments, ["modality", "feature"])
    side = F.when(F.col("_own") == F.col("outer_fold"), "assessment").otherwise("train")
    return rows.select("outer_fold", "sample_id", side.alias("side"), "modality", "feature", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))


def _with_targets(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """(modality, feature, value, y, outer_fold), written: the passes over them shuffle none of these rows."""
    return written(cells.select("sample_id", "modality", "feature", "value").join(unlent(labelled), "sample_id").select("modality", "feature", "value", "y", "outer_fold"), "targeted")


def selected(cells: DataFrame, samples: DataFrame, folds: DataFrame, top: int = 2000) -> DataFrame:
    """(outer_fold, modality, feature, f, place): the features with the largest training ANOVA F in every fold.

    Class-wise sums are taken once per fold and class; training sums are totals less the fold's own. Missing cells count
    as the fold's training median, in closed form.
    """
    labelled = samples.select("sample_id", "y").join(unlent(folds), "sample_id")
    rows = _with_targets(cells, labelled)
    mu = written(rows.groupBy("modality", "feature").agg(F.avg("value").alias("_mu")), "centres")
    x = rows.join(mu, ["modality", "feature"]).withColumn("_x", F.col("value") - F.col("_mu"))
    own = written(x.groupBy("modality", "feature", "y", "outer_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q")), "fold-sums")
    medians = written(fold_medians(rows.withColumnRenamed("outer_fold", "_own"), folds), "medians")
    dropped(rows)
    every = own.groupBy("modality", "feature", "y").agg(*[F.sum(c).alias(f"t{c}") for c in "nsq"])
    per = labelled.groupBy("y", "outer_fold").agg(F.count(F.lit(1)).alias("own"))
    per = per.join(per.groupBy("y").agg(F.sum("own").alias("all")), "y").groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("outer_fold", "own"))).alias("own"), F.max("all").alias("all"))
    grid = mu.join(per).join(folds.select("outer_fold").distinct()).withColumn("rows", F.col("all") - F.coalesce(F.col("own")[F.col("outer_fold")], F.lit(0)))  # classes x folds rows a feature
    grid = grid.drop("own", "all").join(every, ["modality", "feature", "y"], "left").join(own, ["modality", "feature", "y", "outer_fold"], "left").join(medians, ["outer_fold", "modality", "feature"])
    gap, miss = F.col("median") - F.col("_mu"), F.col("rows") - F.col("seen")
    grid = grid.na.fill(0, ["n", "s", "q", "tn", "ts", "tq"]).withColumn("seen", F.col("tn") - F.col("n")).filter("rows > 0")
    train = grid.select("modality", "feature", "y", "outer_fold", F.col("rows").alias("n"), (F.col("ts") - F.col("s") + miss * gap).alias("s"), (F.col("tq") - F.col("q") + miss * gap * gap).alias("q"))
    t = train.groupBy("outer_fold", "modality", "feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    f = (between / (F.col("k") - 1)) / (F.when(within > 0, within) / (F.col("n") - F.col("k")))
    rn = F.row_number().over(Window.partitionBy("outer_fold").orderBy(F.desc_nulls_last("f"), "modality", "feature"))
    return t.withColumn("f", f).withColumn("place", rn).filter(F.col("place") <= top).select("outer_fold", "modality", "feature", "f", "place")


def selected_linear(cells: DataFrame, samples: DataFrame, folds: DataFrame, top: int = 2000) -> DataFrame:
    """(outer_fold, modality, feature, f, place): the features with the largest training F of a line through a number y.

    F is r^2 / (1 - r^2) times n - 2. Sums are taken once per fold over observed cells; training sums are totals less the
    fold's own. Missing cells count as the fold's training median: what they add follows from the sums of y without them.
    """
    keys = ["modality", "feature"]
    y_mean = samples.agg(F.avg("y").alias("_my"))
    labelled = samples.select("sample_id", F.col("y").cast("double").alias("y")).join(F.broadcast(y_mean)).select("sample_id", (F.col("y") - F.col("_my")).alias("y")).join(unlent(folds), "sample_id")
    rows = _with_targets(cells, labelled)
    mu = written(rows.groupBy(*keys).agg(F.avg("value").alias("_mu")), "centres")
    x = rows.join(mu, keys).withColumn("_x", F.col("value") - F.col("_mu"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"), F.sum("y").alias("t"), F.sum(F.col("_x") * F.col("y")).alias("c")]
    own = written(x.groupBy(*keys, "outer_fold").agg(*sums), "fold-sums")
    medians = written(fold_medians(rows.withColumnRenamed("outer_fold", "_own"), folds), "medians")
    dropped(rows)
    every = own.groupBy(*keys).agg(*[F.sum(c).alias(f"a{c}") for c in "nsqtc"])
    per = labelled.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("my"), F.sum(F.col("y") * F.col("y")).alias("vy"))
    whole = per.agg(*[F.sum(c).alias(f"w{c}") for c in ("m", "my", "vy")])
    train = per.join(F.broadcast(whole)).select("outer_fold", *[(F.col(f"w{c}") - F.col(c)).alias(c) for c in ("m", "my", "vy")])  # a row per fold
    grid = every.join(F.broadcast(train)).join(own, [*keys, "outer_fold"], "left").na.fill(0, list("nsqtc")).join(mu, keys).join(medians, ["outer_fold", *keys])
    gap, miss = F.col("median") - F.col("_mu"), F.col("m") - (F.col("an") - F.col("n"))
    s = F.col("as") - F.col("s") + miss * gap
    q = F.col("aq") - F.col("q") + miss * gap * gap
    c = F.col("ac") - F.col("c") + gap * (F.col("my") - (F.col("at") - F.col("t")))
    n = F.col("m")
    vx, vy, cxy = q - s * s / n, F.col("vy") - F.col("my") * F.col("my") / n, c - s * F.col("my") / n
    r2 = F.when((vx > 1e-12) & (vy > 0), cxy * cxy / (vx * vy))
    f = F.when(r2 < 1, r2 / (1 - r2) * (n - 2)).when(r2 >= 1, float("inf"))
    place = F.row_number().over(Window.partitionBy("outer_fold").orderBy(F.desc_nulls_last("f"), *keys))
    return grid.withColumn("f", f).withColumn("place", place).filter(F.col("place") <= top).select("outer_fold", *keys, "f", "place")


def vectors(z: DataFrame, features: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """(keys, x): rows (keys, modality, feature, z) as dense vectors over features (by, modality, feature, blank).

    Features are numbered by a join, in order of name inside `by`; a feature without a row has the value `blank`. The
    table of features is as large as the selection that made it.
    """
    by = list(by)
    at = F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy("modality", "feature")) - 1
    numbered_ = features.withColumn("ix", at)
    blanks = numbered_.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "blank"))), lambda e: e["blank"]).alias("blanks"))
    rows = z.join(numbered_.select(*by, "modality", "feature", "ix"), [*by, "modality", "feature"]).groupBy(*keys).agg(F.collect_list("ix").alias("ix"), F.collect_list("z").alias("z"))

    @F.pandas_udf("array<double>")
    def filled(ix: pd.Series, z_: pd.Series, blank: pd.Series) -> pd.Series:
        out = []
        for i, v, b in zip(ix, z_, blank, strict=True):
            x = np.array(b, float)
            x[np.asarray(i, int)] = v
            out.append(x)
        return pd.Series(out, dtype=object)

    joined = rows.join(F.broadcast(blanks), by) if by else rows.join(F.broadcast(blanks))  # a row per fold
    return joined.select(*keys, array_to_vector(filled("ix", "z", "blanks")).alias("x"))


def logistic(n: int) -> LogisticRegression:
    """L2 with a penalty of 1 / n on the mean loss: scale 1 on the summed one."""
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=100)


def elastic(n: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / max(1, n), elasticNetParam=0.5, standardization=False, maxIter=200)


def ridge(n: int, sd: float, alpha: float = 1.0) -> LinearRegression:
    """Ridge with the given penalty; the solver scales it by the target's population deviation."""
    return LinearRegression(featuresCol="x", labelCol="y", solver="normal", regParam=alpha * sd / max(1, n), elasticNetParam=0.0, standardization=False)


class InParts:
    """A forest of any number of trees from make(trees, seed): a part of them is fitted, asked and dropped at a time.

    A part has as many trees as can have PART_NODES nodes, by depth and by the n rows; a forest of one part is fitted as it is.
    The driver holds one part of one forest, or whole forests of that size, one for each thread. The forest's word is the sum of its trees' shares (the mean of their values in a regression), as of one that is whole.
    """

    _one = threading.Lock()  # folds side by side would hold a part each

    def __init__(self, make: Callable, n: int, trees: int, depth: int):
        self.make, self.trees, self.part = make, trees, max(1, PART_NODES // min(2 << depth, max(1, 2 * n)))

    def predicted(self, train: DataFrame, rows: DataFrame) -> DataFrame:
        """rows without their vectors, with `prediction`, and with `probability` of classes."""
        columns, parts, classes = [c for c in rows.columns if c != "x"], [], 0
        for i, done in enumerate(range(0, self.trees, self.part)):
            trees = min(self.part, self.trees - done)
            with self._one if self.part < self.trees else contextlib.nullcontext():
                model = self.make(trees, 1 + i).fit(train)
                classes = getattr(model, "numClasses", 0)
                said = vector_to_array("rawPrediction") if classes else F.array(F.col("prediction") * trees)
                parts.append(written(model.transform(rows).select(*columns, F.lit(i).alias("_i"), said.alias("_said")), "trees"))
                del model
        said = functools.reduce(DataFrame.unionByName, parts).groupBy(*columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_said"))), lambda x: x["_said"]).alias("_said"))  # a row per part
        total = lambda k: F.aggregate("_said", F.lit(0.0), lambda a, x: a + x[k]) / self.trees
        if not classes:
            return said.select(*columns, total(0).alias("prediction"))
        shares = said.select(*columns, F.array(*[total(k) for k in range(classes)]).alias("_s"))
        return shares.select(*columns, (F.array_position("_s", F.array_max("_s")) - 1).cast("double").alias("prediction"), array_to_vector("_s").alias("probability"))


def forest(n: int, trees: int = 300, depth: int = 12) -> InParts:
    return InParts(lambda k, seed: RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=k, maxDepth=depth, seed=seed), n, trees, depth)


def forest_regression(n: int, trees: int = 300, depth: int = 12) -> InParts:
    return InParts(lambda k, seed: RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=k, maxDepth=depth, featureSubsetStrategy="all", seed=seed), n, trees, depth)


def _predicted(estimator, train: DataFrame, rows: DataFrame) -> DataFrame:
    return estimator.predicted(train, rows) if hasattr(estimator, "predicted") else estimator.fit(train).transform(rows)


def boosting_regression(n: int, rounds: int = 50, depth: int = 3) -> GBTRegressor:
    return GBTRegressor(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, seed=1)


class AgainstRest:
    """An estimator of any number of classes from one of two: a model of each class against the rest, shares scaled to sum to 1."""

    def __init__(self, make, n: int, threads: int = 4):
        self.make, self.n, self.threads = make, n, threads

    def fit(self, rows: DataFrame) -> AgainstRest:
        self.classes = sorted(r[0] for r in rows.select("y").distinct().collect())  # a row per class
        one = lambda c: self.make(self.n).fit(rows.withColumn("y", (F.col("y") == c).cast("double")))
        with ThreadPoolExecutor(self.threads) as pool:
            self.models = list(pool.map(one, self.classes))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with `prediction` and `probability`, a place for every class number up to the largest."""
        out, columns = rows, rows.columns
        for i, model in enumerate(self.models):
            model.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}")
            out = model.transform(out)
        share = {int(c): vector_to_array(f"_p{i}")[1] for i, c in enumerate(self.classes)}
        raw = F.array(*[share.get(k, F.lit(0.0)) for k in range(int(max(self.classes)) + 1)])
        total = F.aggregate("_all", F.lit(0.0), lambda a, x: a + x)
        scaled = F.transform("_all", lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(self.classes)))
        out = out.withColumn("_all", raw).withColumn("_s", scaled)
        best = (F.array_position("_s", F.array_max("_s")) - 1).cast("double")
        return out.select(*columns, best.alias("prediction"), array_to_vector("_s").alias("probability"))


def boosting_classes(n: int) -> AgainstRest:
    """Boosting for more than two classes."""
    return AgainstRest(boosting, n)


def boosting(n: int, rounds: int = 50, depth: int = 3):
    """Two classes; `boosting_classes` takes more."""
    return GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, seed=1)


def prepared(cells: DataFrame, samples: DataFrame, folds: DataFrame, top: int | None = None, only: list | None = None) -> DataFrame:
    """(outer_fold, sample_id, side, x, y): imputed, standardised and selected columns of every fold, fitted on its training rows."""
    return prepared_columns(cells, samples, folds, top, only=only)[0]


def prepared_columns(cells: DataFrame, samples: DataFrame, folds: DataFrame, top: int | None = None, select=selected, only: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The same, written, with (outer_fold, modality, feature, ix, blank): each fold's columns by their place in its vectors.

    `only` names the folds that are wanted. A sample's cells are put together once; its vector in each fold is made of
    them by the fold's medians, means and deviations, which are as many as the columns that were selected.
    """
    samples, folds = written(samples, "samples"), written(folds, "folds")
    own = unlent(folds.select("sample_id", F.col("outer_fold").alias("_own")))
    cells = written(cells.repartition("sample_id").join(own, "sample_id"), "cells")  # each is read many times; a small file would be one task's
    with noted() as steps:
        moments = imputed_moments(cells, samples, folds, only)
        if only:
            moments = moments.filter(F.col("outer_fold").isin(only))
        if top is not None:
            moments = moments.join(select(cells, samples, folds, top).select("outer_fold", "modality", "feature"), ["outer_fold", "modality", "feature"])
        moments = written(moments, "moments")
    dropped(*[t for t in steps if t is not moments])
    columns = moments.select("outer_fold", "modality", "feature", ((F.col("median") - F.col("mean")) / F.col("sd")).alias("blank"))
    placed = columns.withColumn("ix", F.row_number().over(Window.partitionBy("outer_fold").orderBy("modality", "feature")) - 1)

    used = moments.select("modality", "feature").distinct().withColumn("_ix", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("modality", "feature")) - 1)
    used = written(used, "used")
    own = {fold: p.sort_values("_ix") for fold, p in moments.join(used, ["modality", "feature"]).select("outer_fold", "_ix", "median", "mean", "sd").toPandas().groupby("outer_fold")}
    scale = {fold: tuple(p[c].to_numpy() for c in ("_ix", "median", "mean", "sd")) for fold, p in own.items()}
    width = used.count()
    rows = cells.join(used, ["modality", "feature"]).groupBy("sample_id").agg(F.first("_own").alias("outer_fold"), F.collect_list("_ix").alias("ix"), F.collect_list(F.col("value").cast("double")).alias("v"))
    rows = rows.join(unlent(samples.select("sample_id", F.col("y").cast("double").alias("y"))), "sample_id")
    kind = dict(rows.dtypes)

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            step = max(1, SLICE // max(1, width))
            for lo in range(0, len(part), step):
                some = part.iloc[lo : lo + step]
                x = np.full((len(some), width), np.nan)
                x[np.repeat(np.arange(len(some)), [len(i) for i in some.ix]), np.concatenate(some.ix.tolist()).astype(int)] = np.concatenate(some.v.tolist())
                for fold, (at, median, mean, sd) in scale.items():
                    on = np.isin(np.arange(width), at)
                    held = ~np.isnan(x[:, on]).all(axis=1)  # a sample without a cell in the fold's columns has no row
                    z = x[:, on][held]
                    z = (np.where(np.isnan(z), median, z) - mean) / sd
                    side = np.where(some.outer_fold[held] == fold, "assessment", "train")
                    yield pd.DataFrame({"outer_fold": fold, "sample_id": some.sample_id[held], "side": side, "x": list(z), "y": some.y[held]})

    x = rows.mapInPandas(filled, f"outer_fold {kind['outer_fold']}, sample_id {kind['sample_id']}, side string, x array<double>, y double")
    x = written(x.withColumn("x", array_to_vector("x")), "prepared")
    dropped(cells, samples, folds, used)
    return x, placed


def out_of_fold(cells: DataFrame, samples: DataFrame, folds: DataFrame, make=logistic, model: str = "linear", threads: int = 4, top: int | None = None, only: list | None = None) -> DataFrame:
    """(model, sample_id, outer_fold, y, pred, probs): every sample with a cell predicted once, by the fold that left it out.

    Classes are weighted n / (classes x rows of the class). Folds are jobs from a small pool of threads; `only`
    names those to run.
    """
    data = prepared(cells, samples, folds, top, only)  # read by every fold
    names = only or [r[0] for r in folds.select("outer_fold").distinct().collect()]

    def one(fold: int) -> DataFrame:
        train = data.filter((F.col("outer_fold") == fold) & (F.col("side") == "train"))
        counts = train.groupBy("y").agg(F.count(F.lit(1)).alias("m"))
        total = counts.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("c")).first()
        weighted = train.join(F.broadcast(counts), "y").withColumn("w", F.lit(total.n) / (F.lit(total.c) * F.col("m")))  # a row per class
        return _predicted(make(total.n), weighted, data.filter((F.col("outer_fold") == fold) & (F.col("side") == "assessment"))).select(
            F.lit(model).alias("model"), "sample_id", "outer_fold", "y", F.col("prediction").alias("pred"), vector_to_array("probability").alias("probs")
        )

    out = written(_together(one, names, threads), "predicted")  # what reads them needs neither the models nor their rows
    dropped(data)
    return out


def out_of_fold_regression(
    cells: DataFrame, samples: DataFrame, folds: DataFrame, alpha: float = 1.0, model: str = "ridge", threads: int = 4, make=None, top: int | None = None
) -> DataFrame:
    """(model, sample_id, outer_fold, y, score): regression of the target y, every sample predicted once.

    Ridge unless `make` gives another estimator; `top` keeps the features with the largest training F.
    """
    data = prepared_columns(cells, samples, folds, top, selected_linear)[0]
    names = [r[0] for r in folds.select("outer_fold").distinct().collect()]

    def one(fold: int) -> DataFrame:
        train = data.filter((F.col("outer_fold") == fold) & (F.col("side") == "train"))
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop("y")).first()
        said = _predicted(make(n) if make else ridge(n, sd or 1.0, alpha), train, data.filter((F.col("outer_fold") == fold) & (F.col("side") == "assessment")))
        said = said.select(F.lit(model).alias("model"), "sample_id", "outer_fold", "y", F.col("prediction").alias("score"))
        return written(said, "predicted")  # what reads them doesn't carry the model along

    return _together(one, names, threads)


def _together(one, names: list, threads: int) -> DataFrame:
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, names))
    return functools.reduce(DataFrame.unionByName, parts)


def grid(modalities: list[str], estimator: str = "linear") -> dict[str, list[str]]:
    """Models by name with the modalities that they see: each alone, the fusion and, of several, the fusion without each."""
    out = {f"{estimator}::{m}": [m] for m in modalities} | {f"{estimator}::FUSION": list(modalities)}
    return out | ({f"{estimator}::FUSION-minus-{m}": [x for x in modalities if x != m] for m in modalities} if len(modalities) > 1 else {})


def model_grid(cells: DataFrame, samples: DataFrame, folds: DataFrame, estimators: dict, top: int | None = None) -> DataFrame:
    """Out-of-fold predictions of the whole grid, under the same folds, for every estimator (name to its maker)."""
    cells, folds = written(cells, "grid-cells"), written(folds, "grid-folds")
    names = sorted(r[0] for r in cells.select("modality").distinct().collect())
    runs = [(name, seen, make) for estimator, make in estimators.items() for name, seen in grid(names, estimator).items()]
    return functools.reduce(DataFrame.unionByName, [out_of_fold(cells.filter(F.col("modality").isin(seen)), samples, folds, make, name, top=top) for name, seen, make in runs])


def batch_blocked(cells: DataFrame, samples: DataFrame, k: int, make=logistic, name: str = "stress::batch-blocked-FUSION") -> DataFrame:
    """Out-of-fold predictions of the fusion by models that have seen no row of the predicted batch.

    Samples without a batch are left out; fewer than three batches raise.
    """
    known = written(samples.filter("batch IS NOT NULL"), "batched")
    return out_of_fold(cells.join(known.select("sample_id"), "sample_id", "left_semi"), known, splits.blocked(known, k), make, name)


def batch_adjusted(cells: DataFrame, samples: DataFrame, folds: DataFrame, make=logistic, name: str = "sensitivity::batch-adjusted-FUSION", confounded: bool = False, blocked: bool = False) -> DataFrame:
    """Out-of-fold predictions of the fusion on cells centred by batch, the offsets from each fold's training side alone.

    Not for a study whose batches go with the outcome, where centring takes the signal too, nor for batch-blocked folds,
    whose batches have no training rows: both raise.
    """
    if confounded or blocked:
        raise ValueError("batches go with the outcome" if confounded else "folds are blocked by batch")
    moved = written(centred(cells, samples, folds), "centred")
    names = [r[0] for r in folds.select("outer_fold").distinct().collect()]

    def one(fold: int) -> DataFrame:
        own = F.when(F.col("outer_fold") == fold, F.lit(fold)).otherwise(F.lit(-1))  # this fold against all others
        return out_of_fold(moved.filter(F.col("outer_fold") == fold).drop("outer_fold"), samples, folds.withColumn("outer_fold", own), make, name, 1, only=[fold])

    return _together(one, names, 2)


def stacked(predictions: DataFrame, samples: DataFrame, folds: DataFrame, model: str = "stacking::FUSION") -> DataFrame:
    """Late fusion: a linear model over the out-of-fold class probabilities of the single-modality models."""
    p = predictions.filter(~F.col("model").contains("FUSION")).select("sample_id", F.col("model").alias("modality"), F.posexplode("probs").alias("c", "value"))
    cells = p.select("sample_id", "modality", F.concat(F.lit("p"), F.col("c").cast("string")).alias("feature"), "value")
    return out_of_fold(cells, samples, folds, model=model)


def shuffled_target(samples: DataFrame, seed: int = 41, columns: tuple[str, ...] = ("y",)) -> DataFrame:
    """samples with the targets of other samples: a control in which nothing can be learned. Ranks come from hash shards.

    Several columns, such as the time and the event of a survival target, move together.
    """
    a = numbered(samples.select("sample_id"), "sample_id", "_i")
    moved = samples.select(F.concat_ws("|", F.lit(seed), "sample_id").alias("_k"), *columns)
    b = numbered(moved.select("_k"), "_k", "_i").join(moved, "_k").select("_i", *columns)
    return samples.drop(*columns).join(a, "sample_id").join(b, "_i").drop("_i")


def shuffled_features(cells: DataFrame, samples: DataFrame, seed: int = 47) -> DataFrame:
    """cells with every feature's column permuted on its own, missing cells too: nothing is left of the samples.

    Samples are numbered in order of a hash; a feature moves place i to (a i + b) mod n, with a from numbers that have no
    divisor in common with n, and b, by the feature's hash. No window holds a feature.
    """
    places = numbered(samples.select("sample_id").distinct(), "sample_id", "_i")
    n = places.count()
    steps = [a for a in range(n // 3 + 1, 2 * n + 2) if math.gcd(a, n) == 1][:256] or [1]
    key = F.xxhash64(F.lit(seed), "modality", "feature")
    a, b = F.get(F.array(*map(F.lit, steps)), F.pmod(key, F.lit(len(steps))).cast("int")), F.pmod(F.shiftright(key, 9), F.lit(n))
    moved = cells.join(places, "sample_id").drop("sample_id").withColumn("_i", ((F.col("_i").cast("long") * a + b) % n).cast("int"))
    return moved.join(places, "_i").select("sample_id", "modality", "feature", "value")


def noise(samples: DataFrame, features: DataFrame, seed: int = 53) -> DataFrame:
    """Gaussian cells of the same shape, each from the hash of (seed, sample, feature)."""
    rows = samples.select("sample_id").distinct().join(features.select("modality", "feature").distinct())
    u = [uniform(F.lit(seed + i), "sample_id", "modality", "feature") for i in (0, 1)]
    return rows.withColumn("value", F.sqrt(-2 * F.ln(1 - u[0])) * F.cos(2 * math.pi * u[1]))


def masked(cells: DataFrame, rate: float, seed: int = 43, mechanism: str = "mcar", samples: DataFrame | None = None) -> DataFrame:
    """cells without those that a mechanism of missing values takes away; `rate` is the mean share.

    mcar: by a hash alone. mar: by batch, from 0 in the first to twice the rate in the last. mnar: by the value's rank in
    its feature, from 0 to twice the rate. batch: all of it in half of the batches. sample: whole samples of a modality.
    """
    u = uniform(F.lit(seed), "sample_id", "modality", "feature")
    if mechanism == "mcar":
        return cells.filter(u >= rate)
    if mechanism == "sample":
        return cells.filter(uniform(F.lit(seed), "sample_id", "modality") >= rate)
    if mechanism == "mnar":
        n = cells.groupBy("modality", "feature").agg(F.count(F.lit(1)).alias("_n"))
        ranked = average_ranks(cells, ["modality", "feature"], "value", "_r").join(n, ["modality", "feature"])
        return ranked.filter(u >= 2 * rate * (F.col("_r") - 0.5) / F.col("_n")).select(*cells.columns)
    batches = samples.select("batch").distinct().filter("batch IS NOT NULL")
    k = F.count(F.lit(1)).over(Window.partitionBy())
    share = (F.row_number().over(Window.orderBy("batch")) - 1) / F.greatest(k - 1, F.lit(1))  # one row per batch
    batches = batches.withColumn("_p", 2 * rate * (share if mechanism == "mar" else F.round(share).cast("double")))
    rows = cells.join(samples.select("sample_id", "batch"), "sample_id").join(batches, "batch", "left")
    return rows.filter(u >= F.coalesce("_p", F.lit(0.0))).select(*cells.columns)


def target_copies(cells: DataFrame, samples: DataFrame, target: str = "y") -> DataFrame:
    """(modality, feature, equal, bijection, affine): features that give the target away, over all features in one pass."""
    rows = cells.join(samples.select("sample_id", F.col(target).cast("double").alias("_y")), "sample_id").filter("value IS NOT NULL AND _y IS NOT NULL")
    ends = F.struct("_y", "value")
    at = rows.groupBy("modality", "feature").agg(
        F.min(ends).alias("_lo"), F.max(ends).alias("_hi"), F.bool_and(F.col("value") == F.col("_y")).alias("equal"), F.countDistinct("value", "_y").alias("_p"), F.countDistinct("value").alias("_a"), F.countDistinct("_y").alias("_b")
    )
    slope = (F.col("_hi.value") - F.col("_lo.value")) / F.when(F.col("_hi._y") != F.col("_lo._y"), F.col("_hi._y") - F.col("_lo._y"))
    line = at.select("modality", "feature", "equal", ((F.col("_p") == F.col("_a")) & (F.col("_p") == F.col("_b"))).alias("bijection"), slope.alias("_s"), F.col("_lo.value").alias("_v"), F.col("_lo._y").alias("_t"))
    line_at = F.col("_v") + F.col("_s") * (F.col("_y") - F.col("_t"))
    fits = F.bool_and(F.abs(F.col("value") - line_at) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("value")))
    return rows.join(line, ["modality", "feature"]).groupBy("modality", "feature", "equal", "bijection").agg(F.coalesce(fits & (F.first("_s") != 0), F.lit(False)).alias("affine"))


def survival_copies(cells: DataFrame, samples: DataFrame, time: str = "time", event: str = "event", least_pairs: int = 1) -> DataFrame:
    """(modality, feature, time_copy, event_copy, joint, inverted): features that give away when or whether an event comes.

    A time or event copy equals it in every sample; joint: the study has a copy of each. Inverted: the feature falls
    strictly as time grows and is the same where time is, over `least_pairs` pairs of different times at least. Then time
    and value have as many distinct pairs as values each, and the place of a value from below and that of its time add
    up to the same number, whatever the feature.
    """
    rows = cells.filter("value IS NOT NULL").join(samples.select("sample_id", F.col(time).cast("double").alias("_t"), F.col(event).cast("double").alias("_e")), "sample_id")
    n = samples.select("sample_id").distinct().count()
    keys = ["modality", "feature"]
    whole = F.count(F.lit(1)) == n
    copies = rows.groupBy(*keys).agg((whole & F.bool_and(F.col("value") == F.col("_t"))).alias("time_copy"), (whole & F.bool_and(F.col("value") == F.col("_e"))).alias("event_copy"), F.count(F.lit(1)).alias("_n"), whole.alias("_whole"))
    pairs = written(rows.groupBy(*keys, "_t", "value").agg(F.count(F.lit(1)).alias("m")).withColumn("_one", F.lit(1).cast("long")), "time-values")
    placed = running_counts(running_counts(pairs, keys, "_t", "_one").withColumnRenamed("before", "_bt"), keys, "value", "_one")
    tied = pairs.groupBy(*keys, "_t").agg(F.sum("m").alias("m")).groupBy(*keys).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("_same"))
    shape = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_p"), F.countDistinct("_t").alias("_a"), F.countDistinct("value").alias("_b"), F.min(F.col("_bt") + F.col("before")).alias("_lo"), F.max(F.col("_bt") + F.col("before")).alias("_hi")
    )
    falls = (F.col("_a") > 1) & (F.col("_p") == F.col("_a")) & (F.col("_p") == F.col("_b")) & (F.col("_lo") == F.col("_hi"))
    enough = F.col("_n") * (F.col("_n") - 1) / 2 - F.col("_same") >= least_pairs
    both = copies.agg((F.bool_or("time_copy") & F.bool_or("event_copy")).alias("_both"))
    out = copies.join(shape, keys).join(tied, keys).join(F.broadcast(both))
    return out.select(*keys, "time_copy", "event_copy", (F.col("_both") & (F.col("time_copy") | F.col("event_copy"))).alias("joint"), (falls & enough & F.col("_whole")).alias("inverted"))
