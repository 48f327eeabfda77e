"""Scalar cleaning of messy cells, ids, labels and event indicators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that mean a missing value, lower-cased and stripped.
NA_TOKENS = ("", "na", "n/a", "nan", "null", "none", ".", "-", "?", "#n/a", "#na", "missing", "nd", "n.d.", "inf", "-inf", "+inf", "infinity")
#: Words that mean an event, and words that mean none.
EVENT_WORDS = ("dead", "deceased", "death", "event", "progressed", "progression", "relapse", "relapsed", "recurred", "recurrence", "yes", "true", "positive", "1")
CENSOR_WORDS = ("alive", "living", "censored", "no event", "no_event", "none", "no", "false", "negative", "0")
#: Keywords of a file name by the role that they mean, in the order in which they are tried.
ROLE_KEYWORDS = {
    "clinical": ("clinical", "pheno", "phenotype", "metadata", "sample_info", "samples", "label", "outcome", "target", "survival", "design", "meta"),
    "rna": ("rnaseq", "rna_seq", "rna", "mrna", "express", "expr", "gene", "tpm", "fpkm", "counts", "transcript"),
    "protein": ("proteom", "protein", "rppa", "prot"),
    "methylation": ("methylation", "methyl", "cpg", "dnam", "450k", "27k", "beta"),
    "mirna": ("mirna", "microrna", "mir"),
    "cnv": ("cnv", "copynumber", "copy_number", "gistic", "segment", "seg", "cna"),
    "metabolomics": ("metabolom", "metabolite", "metab"),
    "mutation": ("mutation", "somatic", "maf", "snv", "variant", "mut"),
}
#: Beginnings of verdicts and the role that each stands for.
VERDICT_ROLES = (
    ("batch-confounded", "batch_confounded"), ("predictive (adds marginal signal)", "predictive"), ("predictive (standalone)", "predictive"),
    ("informative alone (fusion gain not significant)", "not_additive"), ("informative but non-additive", "not_additive"), ("redundant", "not_additive"), ("no detectable signal", "control_like"),
)
#: Ways to normalise ids of known kinds. The suffix is the sample and aliquot part of a barcode.
PRESETS = {"none": {}, "tcga": {"upper": True, "suffixes": (r"(-\d{2}[A-Z])?(-\d{2}[A-Z]-\d{4}-\d{2})?$",)}}
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def na_masked(c: Column) -> Column:
    """The stripped string, null where it means a missing value."""
    s = F.trim(c)
    return F.when(~F.lower(s).isin(*NA_TOKENS), s)


def number(c: Column) -> Column:
    """A finite number, or null. The pattern keeps out forms that a cast would take, such as 1.5d or NaN."""
    s = F.trim(c)
    v = F.when(s.rlike(NUMBER), s.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def rescued(c: Column) -> Column:
    """A number; a cell that isn't one is read again with decimal comma and thousands points."""
    masked = na_masked(c)
    return F.coalesce(number(masked), number(F.replace(F.replace(masked, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))


def captured(c: Column, pattern: str) -> Column:
    """The first group of the first match of the pattern, else the id as it is; so too for a pattern without a group."""
    if not re.compile(pattern).groups:
        return c
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def once(c: Column, pattern: str) -> Column:
    """The string without the first match of the pattern."""
    at, found = F.regexp_instr(c, F.lit(pattern)), F.coalesce(F.regexp_substr(c, F.lit(pattern)), F.lit(""))  # an empty match takes nothing away
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(found), F.length(c)))).otherwise(c)


def normalized(c: Column, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), upper: bool = False) -> Column:
    """Ids without surrounding blanks and without the first match of each pattern, in upper case if asked for.

    Patterns match where they say so themselves: one that should only match at an end has an anchor.
    """
    out = stripped(c)
    for pattern in (*prefixes, *suffixes):
        out = once(out, pattern)
    return stripped(F.upper(out) if upper else out)


def gene_symbol(c: Column) -> Column:
    """`SYMBOL (123)` without its number."""
    return F.split(c, r" \(", 2)[0]


def role(path: Column) -> Column:
    """A table's role by the first keyword that its file name (without its last ending) has, else other."""
    name = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    return F.coalesce(*[F.when(name.contains(k), F.lit(v)) for v, words in ROLE_KEYWORDS.items() for k in words], F.lit("other"))


def targets_dropped(samples: DataFrame, target: str) -> DataFrame:
    """(n_kept, n_dropped): rows with and without a target."""
    has = F.col(target).isNotNull() & (F.trim(F.col(target).cast("string")) != "")
    return samples.agg(F.sum(has.cast("long")).alias("n_kept"), F.sum((~has).cast("long")).alias("n_dropped"))


def with_target(samples: DataFrame, target: str) -> DataFrame:
    """samples with a target that isn't blank; `targets_dropped` counts the others."""
    return samples.filter(F.col(target).isNotNull() & (F.trim(F.col(target).cast("string")) != ""))


def coded_only(cells: DataFrame, samples: DataFrame, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells and samples of those with a coded target, and (dropped), how many have none."""
    y = F.col(target).cast("double")
    has = y.isNotNull() & ~F.isnan(y)
    kept = samples.filter(has)
    dropped = samples.agg(F.coalesce(F.sum((~has).cast("long")), F.lit(0)).alias("dropped"))
    return cells.join(kept.select("sample_id"), "sample_id", "left_semi"), kept, dropped


def observed(cells: DataFrame, features: DataFrame) -> DataFrame:
    """(modality, feature, note): which features stay, and which go with their modality or alone for want of a value."""
    seen = cells.filter("value IS NOT NULL").select("modality", "feature").distinct().withColumn("_f", F.lit(True))
    rows = features.select("modality", "feature").distinct().join(seen, ["modality", "feature"], "left")
    rows = rows.join(seen.select("modality", F.lit(True).alias("_m")).distinct(), "modality", "left")
    note = F.when(F.col("_m").isNull(), "modality dropped: no numeric data").when(F.col("_f").isNull(), "feature dropped: no observed value").otherwise("kept")
    return rows.select("modality", "feature", note.alias("note"))


def encoded(samples: DataFrame, label: str, positive: str | None = None) -> DataFrame:
    """samples with `code`: labels in order, the positive one last. The table of labels is one row per class."""
    from pyspark.sql import Window

    labels = samples.filter(F.col(label).isNotNull()).select(label).distinct()
    last = F.col(label).eqNullSafe(F.lit(positive)).cast("int")
    codes = labels.select(label, (F.row_number().over(Window.orderBy(last, label)) - 1).alias("code"))
    return samples.join(F.broadcast(codes), label, "left")


def event(df: DataFrame, c: str) -> DataFrame:
    """df with `event_code`: numbers, where nine tenths of all rows are numbers and these are 0 and 1 only; else a leading
    0: or 1:, else words, else the number as it is. What none of these reads is null.
    """
    raw = F.col(c).cast("string")
    s, v = F.lower(stripped(raw)), number(raw)
    share = F.sum(F.when(v.isNotNull(), 1).otherwise(0)) >= 0.9 * F.count(F.lit(1))
    numeric = df.agg((share & F.coalesce(F.min(v.isin(0.0, 1.0)), F.lit(False))).alias("_numeric"))
    lead = F.when(s.rlike(r"^[01]\s*:"), F.substring(s, 1, 1).cast("double"))
    parsed = F.coalesce(lead, F.when(s.isin(*EVENT_WORDS), 1.0), F.when(s.isin(*CENSOR_WORDS), 0.0), v)
    return df.join(F.broadcast(numeric)).withColumn("event_code", F.when(F.col("_numeric"), v).otherwise(parsed)).drop("_numeric")


def group_key(*columns: str) -> Column:
    """A composite group: parts joined by a bar, a missing part as NA."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def early_fusion_name() -> Column:
    return F.concat_ws("::", "modality", "feature")


def structural_gate(cells: DataFrame) -> DataFrame:
    """(modality, feature, n_inf, variance): features that vary; infinite values are missing."""
    finite = F.when(F.abs(F.col("value")) < float("inf"), F.col("value"))
    return cells.groupBy("modality", "feature").agg(
        F.sum((F.abs(F.col("value")) == float("inf")).cast("long")).alias("n_inf"), F.var_samp(finite).alias("variance")
    ).filter("variance > 0")


def log_cpm(cells: DataFrame) -> DataFrame:
    """log2 of counts per million plus one, per sample; null in a sample without counts."""
    from pyspark.sql import Window

    lib = F.sum("value").over(Window.partitionBy("sample_id", "modality"))
    return cells.withColumn("value", F.log2(F.col("value") * 1e6 / F.when(lib > 0, lib) + 1))


def verdict_role(verdict: Column) -> Column:
    """A verdict's role by its beginning; what fits none is a class of its own, no verdict has no role."""
    return F.when(verdict != "", F.coalesce(*[F.when(verdict.startswith(k), F.lit(r)) for k, r in VERDICT_ROLES], F.lit("__unmapped__")))


def model_kind(name: Column) -> Column:
    """What a model is for, by its name."""
    return (
        F.when(name.startswith("control::"), "control").when(name.startswith("stress::"), "stress test").when(name.startswith("sensitivity::"), "sensitivity probe")
        .when(name.startswith("stacking::") | name.endswith("::FUSION"), "fusion").when(name.contains("FUSION-minus-"), "leave-one-out")
        .when(name.startswith("neural::"), "neural single").otherwise("single modality")
    )
