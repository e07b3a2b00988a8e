"""Catalogues, training histories, trials, audits and resampling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import number
from .metrics import ratio, running_before
from .quantiles import percentile_columns, percentiles

CATALOGUE = ("length", "start_ra", "end_ra", "start_dec", "end_dec", "satellite_name")


def require(df: DataFrame, columns=CATALOGUE) -> DataFrame:
    """df, if it has the columns; fails at once otherwise."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def unique_names(cat: DataFrame) -> DataFrame:
    """The distinct names, sorted."""
    return cat.where("satellite_name IS NOT NULL").select("satellite_name").distinct().orderBy("satellite_name")


def catalogue_summary(cat: DataFrame) -> DataFrame:
    return cat.agg(F.count("*").alias("rows"), F.countDistinct("satellite_name").alias("names"), F.count("satellite_name").alias("labelled"), F.count_if(F.col("satellite_name").isNull()).alias("missing"))


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing): nulls, and NaN in numbers, of every column in one pass."""
    gone = lambda c, t: F.col(c).isNull() | F.isnan(c) if t in ("double", "float") else F.col(c).isNull()
    one = df.agg(*[F.count_if(gone(c, t)).alias(c) for c, t in df.dtypes])
    return one.unpivot([], one.columns, "column", "missing")


def name_frequency(cat: DataFrame, n: int) -> DataFrame:
    return cat.where("satellite_name IS NOT NULL").groupBy("satellite_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "satellite_name").limit(n)


def length_summary(cat: DataFrame) -> DataFrame:
    """Of lengths that are numbers: count, mean, median, min and max."""
    v = cat.select(F.col("length").cast("string").try_cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    median = percentile_columns(v, {"median": ("v", 0.5)}, [])
    return v.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")).join(F.broadcast(median)).select("n", "mean", "median", "min", "max")


def coordinate_ranges(cat: DataFrame) -> DataFrame:
    both = lambda c: (F.least(F.min(f"start_{c}"), F.min(f"end_{c}")).alias(f"{c}_min"), F.greatest(F.max(f"start_{c}"), F.max(f"end_{c}")).alias(f"{c}_max"))
    return cat.agg(*both("ra"), *both("dec"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max of each column that has a value."""
    v = F.col("v")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").where(v.isNotNull() & ~F.isnan("v"))
    q = percentiles(df, columns, [0.25, 0.5, 0.75])
    q = q.groupBy("column").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    one = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return one.join(F.broadcast(q), "column").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def per_year(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("n"))


def longest_zero_run(history: DataFrame) -> DataFrame:
    """Per run, the most epochs in a row with a validation Dice of 0."""
    w = Window.partitionBy("run_id").orderBy("epoch")
    zero = F.col("val_dice") == 0
    h = history.withColumn("_r", F.row_number().over(w)).withColumn("_z", zero).withColumn("_g", F.col("_r") - F.row_number().over(Window.partitionBy("run_id", "_z").orderBy("epoch")))
    runs = h.groupBy("run_id", "_z", "_g").agg(F.count("*").alias("k"))
    return runs.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("_z"), F.col("k"))), F.lit(0)).cast("long").alias("longest_zero"))


def loss_spikes(history: DataFrame, factor: float = 2.0) -> DataFrame:
    """Per run, epochs whose loss is over `factor` times the smallest finite loss before."""
    v = F.col("val_loss")
    finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    before = F.min(finite).over(Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    h = history.select("run_id", finite.alias("v"), before.alias("b"))
    return h.groupBy("run_id").agg(F.count_if(F.col("v") > factor * F.col("b")).alias("spikes"))


def _finite(c: str) -> Column:
    v = F.col(c)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def run_stability(history: DataFrame) -> DataFrame:
    """Per run: whether a train or validation loss is missing or not finite, epochs, and the last
    epoch's Dice (null when it isn't finite)."""
    losses = [c for c in ("train_loss", "val_loss") if c in history.columns]
    bad = F.lit(False)
    for c in losses:
        bad |= _finite(c).isNull()
    return history.groupBy("run_id").agg(F.bool_or(bad).alias("bad_loss"), F.count("*").alias("epochs"), F.max_by(_finite("val_dice"), "epoch").alias("last_dice"))


def best_epochs(history: DataFrame) -> DataFrame:
    """Per run the first epoch with the largest Dice."""
    best = F.max(F.struct("val_dice", (-F.col("epoch")).alias("e")))
    return history.groupBy("run_id").agg(best.alias("b")).select("run_id", (-F.col("b.e")).alias("epoch"), F.col("b.val_dice").alias("val_dice"))


RUN_TAG = r"^(.+)_t(\d+)_s(\d+)$"


def parse_tag(tag: Column, pattern: str = RUN_TAG) -> list[Column]:
    """prefix, trial and seed of a run tag such as <prefix>_t44_s2804; other tags fail."""
    ok = F.when(tag.rlike(pattern), tag).otherwise(F.raise_error(F.concat(F.lit("not a run tag: "), F.coalesce(tag, F.lit("null")))))
    part = lambda i: F.regexp_extract(ok, pattern, i)
    return [part(1).alias("prefix"), part(2).cast("int").alias("trial"), part(3).cast("int").alias("seed")]


def trial_aggregate(results: DataFrame, expected_seeds: list[int], resamples: int, seed: int, expected_trials: list[int] | None = None, level: float = 0.95) -> DataFrame:
    """Per trial of results (prefix, trial, seed, run, val_f1, bad_loss, last_dice, longest_zero,
    spikes): mean, sample deviation (0 for one value, null for none) and bootstrap interval of the
    F1, failed runs (no F1, a bad loss or no last Dice) plus missing seeds, and the runs' stability.

    Fails when an expected trial is absent or a trial's runs have several prefixes; with expected
    trials only those are listed."""
    fail = F.col("val_f1").isNull() | F.coalesce("bad_loss", F.lit(False)) | F.col("last_dice").isNull()
    g = results.groupBy("trial").agg(
        F.min("prefix").alias("prefix"), F.max("prefix").alias("_p"), F.count("val_f1").alias("n"), F.avg("val_f1").alias("mean"), F.stddev_samp("val_f1").alias("std"), F.count_if(fail).alias("_failed"), F.collect_set("seed").alias("_s"),
        F.coalesce(F.max("longest_zero"), F.lit(0)).alias("longest_zero"), F.coalesce(F.sum("spikes"), F.lit(0)).alias("spikes"),
    )
    if expected_trials is not None:
        want = results.sparkSession.createDataFrame([(t,) for t in sorted(expected_trials)], "trial long")
        g = want.join(g.withColumn("trial", F.col("trial").cast("long")), "trial", "left")
        known = F.when(F.col("prefix").isNull() & F.col("_s").isNull(), F.raise_error(F.concat(F.lit("missing expected trial "), F.col("trial").cast("string"))).cast("long")).otherwise(F.col("trial"))
        g = g.withColumn("trial", known)
    one = F.when(F.col("prefix").eqNullSafe(F.col("_p")), F.col("prefix")).otherwise(F.raise_error(F.concat(F.lit("mixed prefixes in trial "), F.col("trial").cast("string"))))
    gone = F.size(F.array_except(F.array(*[F.lit(s).cast("long") for s in expected_seeds]), F.col("_s").cast("array<long>"))).cast("long")
    g = g.select("trial", one.alias("prefix"), "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std")).alias("std"), gone.alias("missing_seeds"), (F.col("_failed") + gone).alias("failures"), "longest_zero", "spikes")
    ci = bootstrap_mean(results.withColumn("trial", F.col("trial").cast("long")), "trial", "run", "val_f1", resamples, seed, level).select("trial", "lo", "hi")
    return g.join(ci, "trial", "left")


def trial_summary(results: DataFrame, expected: list[int]) -> DataFrame:
    """Per trial: seeds, mean and sample deviation (0 for one) of F1, expected seeds that are missing."""
    g = results.groupBy("trial").agg(F.count("val_f1").alias("n"), F.avg("val_f1").alias("mean"), F.stddev_samp("val_f1").alias("std"), F.first("batch_size").alias("batch_size"), F.first("learning_rate").alias("learning_rate"), F.collect_set("seed").alias("_s"))
    gone = F.size(F.array_except(F.array(*[F.lit(s).cast("long") for s in expected]), F.col("_s").cast("array<long>")))
    return g.withColumn("std", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std"))).withColumn("missing_seeds", gone.cast("long")).drop("_s")


def select_trial(summary: DataFrame, tie: float) -> DataFrame:
    """Within `tie` of the best mean, the smallest batch size, then learning rate, then trial."""
    best = summary.agg(F.max("mean").alias("_best"))
    return summary.join(F.broadcast(best)).where(F.col("mean") >= F.col("_best") - tie).orderBy(F.col("batch_size").asc_nulls_last(), F.col("learning_rate").asc_nulls_last(), "trial").limit(1).drop("_best")


def top_trials(results: DataFrame, k: int) -> DataFrame:
    """The k trials with the best single result, and the seed that gave it."""
    best = F.max(F.struct("val_f1", (-F.col("run")).alias("r"), "seed"))
    return results.groupBy("trial").agg(best.alias("b")).select("trial", F.col("b.val_f1").alias("val_f1"), F.col("b.seed").alias("seed")).orderBy(F.desc("val_f1"), "trial").limit(k)


def band(values: DataFrame, value: str, anchor: float) -> DataFrame:
    """Mean, sample deviation (0 for one value, null for none), missing values, and whether the anchor
    is within one deviation of the mean."""
    g = values.agg(F.avg(value).alias("mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("sd"), F.count_if(F.col(value).isNull()).alias("missing"))
    return g.withColumn("anchor_inside", F.abs(F.lit(anchor) - F.col("mean")) <= F.col("sd"))


def verdict_check(crops: DataFrame) -> DataFrame:
    """Crops without a verdict and verdicts that are not known, per stratum."""
    known = F.col("verdict").isin("trail", "no_trail", "uncertain")
    return crops.groupBy("stratum").agg(F.count("*").alias("crops"), F.count_if(F.col("verdict").isNull()).alias("missing"), F.count_if(~known).alias("unknown"))


def control_summary(crops: DataFrame, area: int) -> DataFrame:
    """Per stratum of control crops (stratum, verdict, reference_has_trail, model_fired, fp_pixels) of
    `area` pixels: verdicts, crops with a trail in the reference, crops in which the model fired, and
    the false positives' median, largest and share of the crop, over all crops and over those in which
    the model fired though the reference has no trail; null without such crops, shares to 8 places."""
    v = lambda x: F.count_if(F.col("verdict") == x).alias(f"verdict_{x}")
    over = F.coalesce(F.col("model_fired") & ~F.col("reference_has_trail"), F.lit(False))
    c = crops.withColumn("over_fired_fp", F.when(over, F.col("fp_pixels")))
    medians = percentile_columns(c, {"median_fp": ("fp_pixels", 0.5), "over_fired_median_fp": ("over_fired_fp", 0.5)}, ["stratum"])
    one = c.groupBy("stratum").agg(F.count("*").alias("crops"), v("trail"), v("no_trail"), F.count_if("reference_has_trail").alias("reference_has_trail"), F.count_if("model_fired").alias("model_fired"), F.max("fp_pixels").alias("max_fp"), F.count_if(over).alias("over_fired"), F.max("over_fired_fp").alias("over_fired_max_fp"))
    j = one.join(medians.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    stats = lambda name: [f"{name}median_fp", f"{name}max_fp", F.round(F.col(f"{name}median_fp") / area, 8).alias(f"{name}median_fp_fraction")]
    return j.select("stratum", "crops", "verdict_trail", "verdict_no_trail", "reference_has_trail", "model_fired", *stats(""), "over_fired", *stats("over_fired_"))


def mechanism(original_reference_f1: Column, model_original_f1: Column, original_width: Column, reference_width: Column, model_width: Column) -> Column:
    """The fixed diagnosis of why the labels and the model disagree.

    Thin labels: the model scores the labels as well as the reference does (to 0.02), the reference is
    wider than the labels by 1 px or more and the model as wide as the reference (to 1 px).  A model
    that overpaints: labels and reference differ in width by less than 1 px and the model is wider by
    1 px or more.  Otherwise, and without one of the widths, inconclusive."""
    thin = (original_reference_f1 <= model_original_f1 + 0.02) & (reference_width - original_width >= 1) & (F.abs(model_width - reference_width) <= 1)
    wide = (F.abs(reference_width - original_width) < 1) & (model_width - reference_width >= 1)
    # The three labels.
    return F.when(thin, "thin-original support").when(wide, "model-overpaint support").otherwise("mixed/inconclusive")


def category_summary(df: DataFrame, category: str, value: str) -> DataFrame:
    q = percentile_columns(df, {"median": (value, 0.5), "q25": (value, 0.25), "q75": (value, 0.75)}, [category]).withColumnRenamed(category, "_c")
    one = df.groupBy(category).agg(F.count("*").alias("available"), F.count(value).alias("sampled"))
    return one.join(q, F.col(category).eqNullSafe(F.col("_c")), "left").drop("_c")


TIERS = ("low", "medium", "high")


def tertiles(df: DataFrame, value: str) -> DataFrame:
    """Adds tier: low, medium or high by the 33.333 and 66.667 percentiles (inclusive)."""
    q = percentile_columns(df, {"_low": (value, 0.33333), "_high": (value, 0.66667)}, [])  # one row
    v = F.col(value)
    return df.join(F.broadcast(q)).withColumn("tier", F.when(v <= F.col("_low"), "low").when(v <= F.col("_high"), "medium").otherwise("high")).drop("_low", "_high")


def tier_summary(rows: DataFrame, key: str, contrast: str, values: list[str], resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """Per contrast tier: components, images, contrast range, and the mean of each value with its
    interval when images (key) are drawn with replacement (null under two images).  Empty with fewer
    than 15 components that have a contrast or fewer than 3 images."""
    valid = rows.where(F.col(contrast).isNotNull())
    enough = valid.agg(((F.count("*") >= 15) & (F.countDistinct(key) >= 3)).alias("_ok"))
    t = tertiles(valid, contrast)
    out = t.groupBy("tier").agg(F.count("*").alias("components"), F.countDistinct(key).alias("images"), F.min(contrast).alias("contrast_min"), F.max(contrast).alias("contrast_max"), *[F.avg(v).alias(f"{v}_mean") for v in values])
    for v in values:
        ci = None
        for i, tier in enumerate(TIERS):
            one = cluster_mean(t.where(F.col("tier") == tier), key, v, resamples, seed + i, level).select(F.lit(tier).alias("tier"), F.col("mean_lo").alias(f"{v}_lo"), F.col("mean_hi").alias(f"{v}_hi"))
            ci = one if ci is None else ci.union(one)
        out = out.join(ci, "tier", "left")
    return out.join(F.broadcast(enough.where("_ok")).select("_ok")).drop("_ok")


#: Parts of the (group and) resample rows before draws are made of them: rows so few would be one task's.
DRAW_PARTS = 48


def draws(units: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(resample, unit_no): n draws with replacement of units numbered 0 to n-1, for each resample.

    Resamples times units rows are made where they are used.  Spark takes them for one row, so what joins
    them has to ask for a merge, or it would send all of them to every task."""
    n = units.agg(F.count("*").alias("n"))
    d = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).repartition(DRAW_PARTS)
    d = d.where("n > 0").select("n", "resample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return d.select("resample", (number(seed, F.col("resample"), F.col("i")) % F.col("n")).alias("unit_no"))


def numbered(units: DataFrame, key: str) -> DataFrame:
    """Adds unit_no, the rank of each unit by its distinct key from 0 on, by running counts of two levels."""
    return running_before(units.withColumn("_one", F.lit(1).cast("long")), key, ["_one"]).withColumn("unit_no", F.col("_one_before").cast("long")).drop("_one", "_one_before")


def _interval(df: DataFrame, columns: list[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    return df.agg(*[F.percentile(c, p).alias(f"{c}_{n}") for c in columns for n, p in (("lo", a), ("hi", 1 - a))])


def cluster_bootstrap(counts: DataFrame, key: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile intervals of precision, recall, Dice and IoU when images are drawn with replacement;
    the counts of drawn images are summed.  Does not depend on the order of rows."""
    units = numbered(counts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), key)
    s = draws(units, resamples, seed).hint("merge").join(units, "unit_no").groupBy("resample").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    s = s.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), ratio(tp, tp + fp + fn).alias("iou"))
    return _interval(s, s.columns, level)


def bootstrap_mean(values: DataFrame, group: str, key: str, value: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean per group; each group draws by itself."""
    v = values.where(F.col(value).isNotNull())
    w = Window.partitionBy(group).orderBy(key)
    v = v.select(group, F.col(value).alias("_v"), (F.row_number().over(w) - 1).cast("long").alias("unit_no"))
    n = v.groupBy(group).agg(F.count("*").alias("_n"), F.avg("_v").alias("mean"))
    d = n.select(group, "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).repartition(DRAW_PARTS).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("i"))
    d = d.select(group, "resample", (number(seed, F.col(group), F.col("resample"), F.col("i")) % F.col("_n")).alias("unit_no"))
    m = d.hint("merge").join(v, [group, "unit_no"]).groupBy(group, "resample").agg(F.avg("_v").alias("m"))
    a = (1 - level) / 2
    return m.groupBy(group).agg(F.percentile("m", a).alias("lo"), F.percentile("m", 1 - a).alias("hi")).join(n.select(group, "mean"), group)


def cluster_mean(rows: DataFrame, key: str, value: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """Interval of the mean over the pooled rows of images drawn with replacement; null under two images."""
    units = numbered(rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.sum(value).alias("s"), F.count("*").alias("k")), key)
    m = draws(units, resamples, seed).hint("merge").join(units, "unit_no").groupBy("resample").agg((F.sum("s") / F.sum("k")).alias("mean"))
    enough = units.agg((F.count("*") >= 2).alias("_ok"))
    i = _interval(m, ["mean"], level).join(F.broadcast(enough))
    return i.select(*[F.when(F.col("_ok"), F.col(c)).alias(c) for c in ("mean_lo", "mean_hi")])


def paired_bootstrap(rows: DataFrame, key: str, a: str, b: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """Interval of the mean difference of two values of the same units, drawn together; spans_zero."""
    units = numbered(rows.select(key, (F.col(a) - F.col(b)).alias("d")), key)
    m = draws(units, resamples, seed).hint("merge").join(units, "unit_no").groupBy("resample").agg(F.avg("d").alias("difference"))
    return _interval(m, ["difference"], level).withColumn("spans_zero", (F.col("difference_lo") <= 0) & (F.col("difference_hi") >= 0))


def patch_bootstrap(counts: DataFrame, key: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """As cluster_bootstrap for many small units: each patch has a Poisson(1) weight in each resample,
    so a resample is a weighted sum and no unit is numbered."""
    u = number(seed, F.col(key), F.col("resample")) / 4294967296.0
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    s = counts.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight).groupBy("resample").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    s = s.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("dice"))
    return _interval(s, s.columns, level)
