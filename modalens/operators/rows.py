"""Quality checks and summaries of result rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalens.operators.bootstrap import drawn_counts, percentile_interval
from modalens.operators.metrics import wilson

#: Blocks of a key's datasets in a pooled interval; every one works out all draws of its key.
ROLE_BLOCKS = 8


def broken(rows: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """rows with `rule`, one for each broken rule. A rule may say required, enum, range (both ends allowed)."""
    checks = []
    for c, rule in rules.items():
        v = F.col(c)
        if rule.get("required"):
            checks.append(F.when(v.isNull(), F.lit(f"{c} missing")))
        if "enum" in rule:
            checks.append(F.when(v.isNotNull() & ~v.isin(rule["enum"]), F.lit(f"{c} not allowed")))
        if "range" in rule:
            lo, hi = rule["range"]
            checks.append(F.when(v.isNotNull() & (F.isnan(v.cast("double")) | (v < lo) | (v > hi)), F.lit(f"{c} out of range")))
    return rows.withColumn("rule", F.explode(F.array(*checks))).filter("rule IS NOT NULL")


def mixed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n): keys whose rows have several values."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("_k")).filter("_k > 1").drop("_k")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unexplained_nulls(rows: DataFrame, failures: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows without a value, or with one that is not finite, that no failure record explains."""
    v = F.col(value)
    return rows.filter(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).join(failures.select(*keys).distinct(), keys, "left_anti")


def prediction_checks(pred: DataFrame) -> DataFrame:
    """Per model: rows, scores outside 0 to 1, repeated samples, whether all scores are the same."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    return pred.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("n_outside"), (F.count(F.lit(1)) - F.countDistinct("sample_id")).alias("n_repeated"),
        (F.min("score") == F.max("score")).alias("constant"),
    )


def null_behaviour(rows: DataFrame, keys: list[str], value: str, chance: float, margin: float) -> DataFrame:
    """Per key: mean of what should be chance, and whether it is within the margin."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.withColumn("within", F.abs(F.col("mean") - chance) <= margin)


def findings(checks: dict[str, tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """(keys, rule, severity, n): how many rows each check found under each key. checks: by name the severity and the rows found."""
    out = None
    for rule, (severity, found) in checks.items():
        if severity not in ("error", "warning"):
            raise ValueError(f"{rule}: {severity} is no severity")
        one = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def gate(problems: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One verdict from (rule, severity, n): FAIL on an error, WARN on a warning, else PASS.

    With `every`, a table of keys, there is a verdict for each of them, and PASS for one without problems.
    """
    keys = every.columns if every is not None else []
    n = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0))
    rows = problems if every is None else every.join(problems, keys, "left")
    out = rows.groupBy(*keys).agg(n("error").alias("errors"), n("warning").alias("warnings"))
    return out.withColumn("verdict", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def record_gate(rows: DataFrame, failures: DataFrame, expected: DataFrame, rules: dict[str, dict], phase: str = "phase", value: str = "primary_value", control: float = 0.12, chance: float = 0.5, stale: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts of the phases of result rows (phase, dataset_id, method_id, arm, repeat, value, profile).

    Errors: broken row rules, several profiles in a phase, repeated keys, a value that is missing or not finite without a
    failure record, expected tasks without a row, a mean of control rows (method "control") more than `control` above
    chance. Warnings: rows that `stale` marks. A phase that expects no task at all is an error too.
    """
    key = [phase, "dataset_id", "method_id", "arm", "repeat"]
    mean = rows.filter("method_id = 'control'").groupBy(phase).agg(F.avg(value).alias("_m")).filter(F.col("_m") > chance + control)
    checks = {
        "row rule": ("error", broken(rows, rules)),
        "several profiles": ("error", mixed(rows, [phase], "profile")),
        "repeated key": ("error", duplicates(rows, key)),
        "unexplained null": ("error", unexplained_nulls(rows, failures, key, value)),
        "missing task": ("error", expected.join(rows, key, "left_anti")),
        "nothing expected": ("error", rows.select(phase).distinct().join(expected.select(phase).distinct(), phase, "left_anti")),
        "control above chance": ("error", mean),
        "stale row": ("warning", rows.filter(stale if stale is not None else F.lit(False))),
    }
    found = findings(checks, [phase])
    every = rows.select(phase).unionByName(expected.select(phase)).distinct()
    return found, gate(found, every)


def predictive_table(rows: DataFrame, keys: list[str], value: str = "primary_value") -> DataFrame:
    """Per key: attempted and scored rows, mean over the scored ones, and over all attempts with a failure as zero."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempted"), F.count(value).alias("scored"), F.avg(value).alias("mean_scored"), (F.sum(value) / F.count(F.lit(1))).alias("mean_attempted")
    )


def flag_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, of (flag, truth): share of true cases flagged and of others left alone."""
    return rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("truth"), F.col("flag").cast("int"))).alias("sensitivity"), F.avg(F.when(~F.col("truth"), (~F.col("flag")).cast("int"))).alias("specificity")
    )


def audit_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: data sets, mean role F1, alarms with Wilson's interval and their Monte-Carlo error, false certifications
    (their base is all data sets where one leaks) and false alarms (where none does), and the mean over all controls.

    Keys without any control score have no row.
    """
    from modalens.operators.metrics import wilson

    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    scores = F.filter("controls", lambda v: v.isNotNull() & ~F.isnan(v))
    per = rows.withColumns({"_c": F.aggregate(scores, F.lit(0.0), lambda a, v: a + v), "_m": F.size(scores)})
    g = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("datasets"), F.avg("role_f1").alias("mean_role_f1"), count("alarm").alias("alarms"), count("false_certification").alias("false_certifications"),
        count("false_alarm").alias("false_alarms"), F.coalesce(F.bool_or("leak"), F.lit(False)).alias("_leak"), (F.sum("_c") / F.when(F.sum("_m") > 0, F.sum("_m"))).alias("mean_control"),
    ).filter("mean_control IS NOT NULL")
    n, p = F.col("datasets"), F.col("alarms") / F.col("datasets")
    low, high = wilson(F.col("alarms"), n)
    base = lambda leak: F.when(F.col("_leak") == leak, n).otherwise(0)
    return g.select(
        *keys, "datasets", "mean_role_f1", "alarms", low.alias("alarm_low"), high.alias("alarm_high"), F.sqrt(p * (1 - p) / n).alias("alarm_mcse"), "false_certifications",
        base(True).alias("certification_base"), "false_alarms", base(False).alias("alarm_base"), "mean_control",
    )


def not_worse(rows: DataFrame, keys: list[str], size: str, value: str, slack: float) -> DataFrame:
    """Per key and size: the mean, and whether it falls below the next smaller size's by more than the slack."""
    per = rows.groupBy(*keys, size).agg(F.avg(value).alias("mean"))
    before = F.lag("mean").over(Window.partitionBy(*keys).orderBy(size))
    return per.withColumn("worse", F.coalesce(F.col("mean") < before - slack, F.lit(False)))


def failure_counts(failures: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by all keys, with totals (null keys)."""
    return failures.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))


def progress(rows: DataFrame, expected: DataFrame, keys: list[str], unit: str, finished: str) -> DataFrame:
    """Per key: units done and outstanding, and rows an hour between the first and the last one."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    hours = (seconds(F.max(finished)) - seconds(F.min(finished))) / 3600
    out = rows.groupBy(*keys).agg(F.countDistinct(unit).alias("done"), ((F.count(F.lit(1)) - 1) / F.when(hours > 0, hours)).alias("per_hour"))
    return out.join(F.broadcast(expected)).select(*keys, "done", (F.col("expected") - F.col("done")).alias("outstanding"), "per_hour")


def flag_rates(rows: DataFrame, keys: list[str], severity: str = "severity", flag: str = "flag") -> DataFrame:
    """(keys, severity, n, flagged, rate, low, high) with Wilson's interval; in clean conditions the rate is that of false alarms."""
    out = rows.groupBy(*keys, severity).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("long")).alias("flagged"))
    low, high = wilson(F.col("flagged").cast("double"), F.col("n").cast("double"))
    return out.select(*keys, severity, "n", "flagged", (F.col("flagged") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def expected_order(rows: DataFrame, flags: DataFrame, chance: float = 0.5, slack: float = 0.05, worse: float = 0.02) -> DataFrame:
    """(check, value, deviates) of what a design implies; a deviation is to be looked into and changes nothing.

    rows (family, arm, size, value): the mean of null controls is near chance, the unsafe arm scores above the safe one,
    and the mean of the standard arm doesn't fall as samples grow. flags (family, severity, flag): the severe condition is
    flagged more often than the clean one. A check without its rows is left out.
    """
    mean = lambda when: F.avg(F.when(when, F.col("value")))
    one = rows.agg(mean(F.col("family") == "null").alias("null"), (mean(F.col("arm") == "unsafe") - mean(F.col("arm") == "safe")).alias("gap"))
    out = one.select(F.lit("null mean at chance").alias("check"), F.col("null").alias("value"), (F.abs(F.col("null") - chance) > slack).alias("deviates"))
    out = out.unionByName(one.select(F.lit("leakage gap above zero").alias("check"), F.col("gap").alias("value"), (F.col("gap") <= 0).alias("deviates")))
    sizes = not_worse(rows.filter("family = 'predictive' AND arm = 'standard' AND value IS NOT NULL"), [], "size", "value", worse).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("worse").cast("double")).alias("n"))
    out = out.unionByName(sizes.filter("k > 1").select(F.lit("more data is not worse").alias("check"), F.col("n").alias("value"), (F.col("n") > 0).alias("deviates")))
    rate = lambda s: F.avg(F.when(F.col("severity") == s, F.col("flag").cast("double")))
    contrast = flags.groupBy("family").agg((rate("severe") - rate("clean")).alias("value"))
    return out.unionByName(contrast.select(F.concat(F.lit("severe above clean: "), "family").alias("check"), "value", (F.col("value") <= 0).alias("deviates"))).filter("value IS NOT NULL")


def progress_report(done: DataFrame, expected: DataFrame, now: Column, family: str = "family", unit: str = "dataset_id", finished: str = "finished") -> DataFrame:
    """(family, expected, completed, outstanding, per_hour, eta_hours, newest_age_hours, active) by family.

    Units are counted once, by their last row; the rate and the age of the newest row are those of all families together,
    and the active family is the one with most outstanding units, ties by name.
    """
    seconds = lambda c: c.cast("timestamp").cast("double")
    want = expected.select(family, unit).distinct()
    last = done.groupBy(unit).agg(F.max(seconds(F.col(finished))).alias("_t"))
    span = (F.max("_t") - F.min("_t")) / 3600
    pace = last.agg(F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("per_hour"), ((seconds(now) - F.max("_t")) / 3600).alias("newest_age_hours"))
    out = want.join(last, unit, "left").groupBy(family).agg(F.count(F.lit(1)).alias("expected"), F.count("_t").alias("completed"))
    out = out.withColumn("outstanding", F.col("expected") - F.col("completed")).join(F.broadcast(pace))
    first = F.row_number().over(Window.orderBy(F.desc("outstanding"), family))  # a row per family
    return out.select(family, "expected", "completed", "outstanding", "per_hour", (F.col("outstanding") / F.col("per_hour")).alias("eta_hours"), "newest_age_hours", ((first == 1) & (F.col("outstanding") > 0)).alias("active"))


def pooled_role_f1(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, roles, role_f1) of (keys, truth, called): F1 of every true role over all rows of a key, and their mean.

    A role that is only ever called counts as a wrong call of others; a true role never called has F1 zero. Rows without
    a true role are left out.
    """
    return _role_f1(pairs.filter(F.col("truth").isNotNull()).groupBy(*keys, "truth", "called").agg(F.count(F.lit(1)).alias("_c")), keys)


def _role_f1(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The same from counts (keys, truth, called, _c)."""
    hit = F.when(F.col("truth") == F.col("called"), F.col("_c")).otherwise(0)
    zero = F.lit(0).cast("long")
    true = cells.select(*keys, F.col("truth").alias("_role"), F.col("_c").alias("_t"), zero.alias("_p"), hit.alias("_h"))
    called = cells.filter(F.col("called").isNotNull()).select(*keys, F.col("called").alias("_role"), zero.alias("_t"), F.col("_c").alias("_p"), zero.alias("_h"))
    per = true.unionByName(called).groupBy(*keys, "_role").agg(*[F.sum(c).alias(c) for c in ("_t", "_p", "_h")]).filter("_t > 0")
    return per.groupBy(*keys).agg(F.sum("_t").alias("n"), F.count(F.lit(1)).alias("roles"), F.avg(2 * F.col("_h") / (F.col("_t") + F.col("_p"))).alias("role_f1"))


def pooled_role_interval(pairs: DataFrame, keys: list[str], dataset: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(keys, usable, ci_low, ci_high) of the pooled F1, by drawing whole datasets of a key; a key of one dataset has no row.

    Datasets are numbered inside their key shard by shard; a task has a block of a key's
    datasets and works out how often each replicate draws them: no row takes its replicates through a shuffle.
    """
    cells = pairs.filter(F.col("truth").isNotNull()).groupBy(*keys, dataset, "truth", "called").agg(F.count(F.lit(1)).alias("_c"))
    units = cells.select(*keys, dataset).distinct().withColumn("_o", F.xxhash64(dataset)).withColumn("_s", F.pmod("_o", F.lit(64)))
    counts = units.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the shards
    own = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_o", dataset)) - 1
    n = counts.groupBy(*keys).agg(F.sum("_m").alias("_n")).filter("_n > 1")
    placed = units.withColumn("_r", own).join(counts.select(*keys, "_s", before.alias("_b")), [*keys, "_s"]).join(n, keys).select(*keys, dataset, "_n", (F.col("_b") + F.col("_r")).alias("_i"))
    size = F.ceil(F.col("_n") / F.lit(ROLE_BLOCKS))
    plain = {c: t in ("int", "bigint") for c, t in pairs.select(*keys).dtypes}  # a key of another type draws by its hash
    own_keys = [F.col(c).alias(f"_k{i}") if plain[c] else F.xxhash64(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    wide = [not plain[c] or t == "bigint" for c, t in pairs.select(*keys).dtypes]
    dealt = cells.join(placed, [*keys, dataset]).select("*", F.floor(F.col("_i") / size).alias("_d"), *own_keys)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        after = [(int(v), long) for v, long in zip((pdf[f"_k{i}"].iloc[0] for i in range(len(keys))), wide, strict=True) if not pd.isna(v)]
        pdf["called"] = pdf["called"].astype(object).where(pdf["called"].notna(), None)
        code, names = pd.factorize(pd.MultiIndex.from_arrays([pdf["truth"], pdf["called"].isna(), pdf["called"].fillna("")]))
        units, at = np.unique(pdf["_i"].to_numpy(), return_inverse=True)
        x = np.zeros((len(units), len(names)))
        np.add.at(x, (at, code), pdf["_c"].to_numpy())
        n = int(pdf["_n"].iloc[0])
        out = np.stack([drawn_counts([seed, rep], n, after, wide=True)[units] @ x for rep in range(1, reps + 1)])
        one = {c: pdf[c].iloc[0] for c in keys}
        each = [pd.DataFrame({**one, "rep": np.arange(1, reps + 1), "truth": t, "called": None if gone else c, "_c": out[:, i].astype(np.int64)}) for i, (t, gone, c) in enumerate(names)]
        return pd.concat(each).query("_c > 0")

    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*keys).dtypes)
    roles = ", ".join(f"`{c}` {t}" for c, t in pairs.select("truth", "called").dtypes)
    parts = dealt.groupBy(*keys, "_d").applyInPandas(sums, f"{kinds}, rep int, {roles}, _c long")
    drawn = parts.groupBy(*keys, "rep", "truth", "called").agg(F.sum("_c").alias("_c"))
    return percentile_interval(_role_f1(drawn, [*keys, "rep"]), keys, "role_f1", least=2)
