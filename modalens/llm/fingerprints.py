"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a weighted set: its words with their counts. For sample j and a word of weight w, a keyed hash of the
word and j gives r and c from Gamma(2, 1) and b uniform; t = floor(ln w / r + b), a = c exp(-r (t - b + 1)). The word
with the smallest a is the sample and (word, t) its value. Two documents agree in a sample with the probability of
their generalised Jaccard similarity, sum of minima over sum of maxima; a fingerprint is the values of all samples.

Data flow: a word's counts come from its run in the sorted words of its own text, so counting shuffles nothing. Each
sample is one min() over a packed number (a above, the value's hash below), kept in the hash aggregation's buffer;
documents are bucketed by id once (at quantiles, so that outlying or hot ids fill no bucket), which the aggregation reuses. The next document comes from a window inside the
bucket, and for a bucket's last one from the first row of the next bucket that has rows, found over bucket numbers.

Defined cases: a null text is empty; a text without words has the empty fingerprint, alike to itself only; null ids
come first in the order; rows that repeat an id follow each other by a hash of their texts; the only document is its own next one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalens.llm.common import SPACE, written

SAMPLES = 64
BUCKET_BYTES = 1 << 19
#: Quantiles of the ids that buckets are cut by, and how many of them are compared at a time.
CUTS, BLOCK = 256, 16
#: Buckets whose order one task may settle; beyond it, their order is found in groups of so many.
TOGETHER = 1000
_HEX = 6


def sample_columns(term: Column, ln_w: Column, samples: int) -> list[Column]:
    """For each sample the packed number of a word: the smaller, the better; its low 24 bits stand for (word, t).

    One 64-bit hash gives four uniforms. With e = -ln u0 and f = -ln u1, r = e + f is Gamma(2, 1) and b = f / r is
    uniform and independent of it, so r (1 - b) = e and a = c exp(-r (t - b + 1)) = c u0 exp(-r t). A word that occurs
    once has t = 0, and needs one logarithm only.
    """
    out = []
    for j in range(samples):
        h = F.xxhash64(term, F.lit(j))
        u = [(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(65535)) + F.lit(0.5)) * F.lit(2.0**-16) for k in (0, 16, 32, 48)]
        r, f = -F.ln(u[0] * u[1]), -F.ln(u[1])
        t = F.when(ln_w > 0, F.floor((ln_w + f) / r)).otherwise(F.lit(0).cast("long"))
        a = -F.ln(u[2] * u[3]) * u[0] * F.when(t > 0, F.exp(-r * t)).otherwise(F.lit(1.0))
        value = F.shiftrightunsigned(term.bitwiseXOR(t * F.lit(0x9E3779B1)), 8).bitwiseAND(F.lit((1 << 24) - 1))
        out.append(F.shiftleft((a * F.lit(float(1 << 33))).cast("long"), 24).bitwiseOR(value))
    return out


def runs(text: Column) -> Column:
    """Each distinct word once, as often after itself as it occurs, a blank after each."""
    line = F.concat(F.array_join(F.array_sort(F.filter(F.split(text, SPACE), lambda w: w != "")), " "), F.lit(" "))
    return F.regexp_extract_all(line, F.lit(r"(\S+ )\1*"), 0)


def minima(each: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """(keys, m): the samples' smallest packed numbers over the runs of a table (keys, run), null without a word."""
    word = each.select(*keys, F.octet_length("run").alias("n"), F.substring_index("run", " ", 1).alias("word"))
    term = word.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), F.ln(F.col("n") / (F.octet_length("word") + 1)).alias("ln_w"))
    mins = [F.min(c).alias(f"s{j}") for j, c in enumerate(sample_columns(F.col("term"), F.col("ln_w"), samples))]
    return term.groupBy(*keys).agg(*mins).select(*keys, F.array(*[F.col(f"s{j}") for j in range(samples)]).alias("m"))


def fingerprint(m: Column) -> Column:
    """The values of all samples in hexadecimal digits; empty without a word."""
    digits = F.transform(m, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 24) - 1))), _HEX, "0"))
    return F.when(m[0].isNotNull(), F.array_join(digits, "")).otherwise("")


def with_fingerprint(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint) of a table (keys, text); rows of equal keys are one weighted set."""
    each = texts.select(*keys, F.explode_outer(runs(F.col("text"))).alias("run"))
    return minima(each, keys, samples).select(*keys, fingerprint(F.col("m")).alias("fingerprint"))


def with_two_fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint, edited_fingerprint) of a table (keys, text, edited), one row for each of the keys.

    A word that both texts have equally often has the same samples in both: it is worked out once, in a part of its own,
    and each text's minima are those of its own part and of the common one.
    """
    both = texts.select(*keys, runs(F.col("text")).alias("a"), runs(F.col("edited")).alias("b"))
    parts = F.array(F.array_except("a", "b"), F.array_except("b", "a"), F.array_intersect("a", "b"))
    each = both.select(*keys, F.posexplode(parts).alias("part", "runs")).select(*keys, "part", F.explode_outer("runs").alias("run"))
    per = minima(each, [*keys, "part"], samples).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("part", "m"))).alias("p"))  # three entries
    one, two = (F.zip_with(F.col("p")[i], F.col("p")[2], lambda x, y: F.least(x, y)) for i in (0, 1))
    return per.select(*keys, one.alias("a"), two.alias("b")).select(*keys, fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that agree; two empty fingerprints agree, an empty and another one do not."""
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda j: F.substring(a, j * _HEX + 1, F.lit(_HEX)) == F.substring(b, j * _HEX + 1, F.lit(_HEX)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.size(same) / F.lit(float(samples)))


def following(buckets: DataFrame, n: int) -> DataFrame:
    """(bucket, after): the next bucket of the table, after the last one the first. n: largest bucket number."""
    if n <= TOGETHER:
        w = Window.orderBy("bucket")
        first = F.min("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return buckets.select("bucket", F.coalesce(F.lead("bucket").over(w), first).alias("after"))
    grouped = buckets.withColumn("g", F.floor(F.col("bucket") / TOGETHER))
    inside = grouped.withColumn("after", F.lead("bucket").over(Window.partitionBy("g").orderBy("bucket")))
    firsts = grouped.groupBy("g").agg(F.min("bucket").alias("first"))
    groups = following(firsts.select(F.col("g").alias("bucket")), n // TOGETHER + 1)
    jump = groups.join(firsts.withColumnRenamed("g", "after"), "after").select(F.col("bucket").alias("g"), "first")
    return inside.join(jump, "g", "left").select("bucket", F.coalesce("after", "first").alias("after"))


def bucketed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (id, text) with `o`, a hash of the text, and `bucket`, and the largest bucket's number.

    Buckets follow the order of (id, o) and hold about BUCKET_BYTES. Cuts at quantiles of the ids make ranges, an id that
    is itself a cut (every hot one is) makes a range of its own; inside a range, buckets are equal widths of ids, or of
    `o` where it has one id. Ids are scaled before they are subtracted, so ids far apart don't overflow.
    """
    steps = [j / CUTS for j in range(CUTS + 1)]
    cuts = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx("id", steps, F.lit(20 * CUTS)))).alias("cuts")).first().cuts or [0]
    blocks = [cuts[j : j + BLOCK] for j in range(0, len(cuts), BLOCK)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("id")))
    block = F.greatest(below(F.array(*[F.lit(b[0]) for b in blocks])) - 1, F.lit(0))
    inside = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.col("block") + 1)
    cut = F.col("block") * BLOCK + below(inside)
    ranged = rows.withColumn("o", F.xxhash64("text")).withColumn("block", block).withColumn("cut", cut)
    is_cut = F.coalesce(F.array_contains(F.array(*map(F.lit, cuts)), F.col("id")), F.lit(False))
    ranged = ranged.withColumn("r", F.when(F.col("id").isNull(), -1).otherwise(2 * F.col("cut") + is_cut.cast("int")))
    scale = 2.0**-20
    x = F.when((F.col("r") < 0) | (F.col("r") % 2 == 1), F.col("o") * F.lit(scale)).otherwise(F.col("id") * F.lit(scale))
    ranged = ranged.withColumn("x", x)
    found = ranged.groupBy("r").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # 2 CUTS + 2 rows at most
    table, first = [], 0
    for r in sorted(found):
        many = max(1, r.bytes // BUCKET_BYTES)
        table.append((r.r, r.lo, (r.hi - r.lo) / many * (1 + 1e-12) + 1e-300, many, first))
        first += many
    ranges = rows.sparkSession.createDataFrame(table, "r int, lo double, width double, many long, first long")
    within = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.col("many") - 1)
    return ranged.join(F.broadcast(ranges), "r").select("id", "text", "o", (F.col("first") + within).cast("long").alias("bucket")), max(first, 1)


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the start of the next document's text instead of its own second half.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets, n = bucketed(rows)
    order = Window.partitionBy("bucket").orderBy("id", "o", "text")
    placed = buckets.select(
        "bucket", "id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text")
    )
    heads = placed.filter("rn = 1").select(F.col("bucket").alias("after"), F.col("text").alias("head"))
    jump = following(heads.select(F.col("after").alias("bucket")), n).join(heads, "after")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", "head"), F.lit(1), half))
    both = placed.join(jump, "bucket").select(
        "bucket", "rn", "id", "text", edited.alias("edited"),
        F.when(F.col("next_text").isNull(), F.col("after")).otherwise(F.col("bucket")).alias("b2"),
        F.when(F.col("next_text").isNull(), F.lit(1)).otherwise(F.col("rn") + 1).alias("r2"),
    )
    both = both.select("bucket", "rn", "id", "b2", "r2", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("sha"), "text", "edited")
    own = written(with_two_fingerprints(both, ["bucket", "rn", "id", "b2", "r2", "n_chars", "sha"], samples), "fingerprints")
    after = own.select(F.col("bucket").alias("b2"), F.col("rn").alias("r2"), F.col("fingerprint").alias("next_fingerprint"))
    out = own.join(after, ["b2", "r2"])
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
