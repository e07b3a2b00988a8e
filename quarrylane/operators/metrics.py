"""Confusion counts, the eight metrics, threshold sweeps and error decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs as R

COUNTS = ("tp", "fp", "tn", "fn")


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den, and null where den is 0."""
    return F.when(den != 0, num / den)


def binarise(value: Column, threshold: float, logits: bool = False, kind: str = "score") -> Column:
    """A mask of values by their kind: booleans ("bool") as they are, whole numbers ("int") above 0,
    scores of at least the threshold.  Logits of any number go through a sigmoid first."""
    if kind == "bool":
        return value
    if kind == "int" and not logits:
        return value > 0
    return (1 / (1 + F.exp(-value)) if logits else value) >= threshold


def confusion(pred: Column, target: Column) -> list[Column]:
    """Aggregates for the four counts of two boolean columns."""
    return [F.count_if(c).alias(n) for n, c in zip(COUNTS, (pred & target, pred & ~target, ~pred & ~target, ~pred & target))]


def dense_counts(scored: DataFrame, keys: list[str], prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """Confusion counts of scored pixels per key."""
    return scored.groupBy(*keys).agg(*confusion(binarise(F.col(prob), threshold), F.col("target")))


def sparse_counts(pred: DataFrame, target: DataFrame, area: int, key: str = "image_id") -> DataFrame:
    """Confusion counts per image of two sets of pixels (key, y, x) in frames of `area` pixels.

    The runs of both sides meet in one sweep; true negatives are what is left of the area."""
    side = lambda d: R.runs_of(d.select(F.col(key).alias("image_id"), "y", "x"))
    p, t = F.col("p") > 0, F.col("t") > 0
    both = R.sweep(R.named({"p": side(pred), "t": side(target)}), ["p", "t"]).groupBy(F.col("image_id").alias(key)).agg(R.size(p & t).alias("tp"), R.size(p & ~t).alias("fp"), R.size(~p & t).alias("fn"))
    return both.select(key, "tp", "fp", (F.lit(area) - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), "fn")


def combine(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums counts over the keys and over every prefix of them; `level` is the number of keys kept."""
    out = counts.rollup(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS], F.grouping_id().alias("g"))
    return out.withColumn("level", F.lit(len(keys)) - F.bit_count("g")).drop("g")


def metrics(counts: DataFrame) -> DataFrame:
    """Adds the eight metrics to counts; ratios without a denominator are 0."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + tn + fp + fn), "specificity": ratio(tn, tn + fp), "positive_fraction": ratio(tp + fn, tp + tn + fp + fn),
        }
    )


def patch_losses(scored: DataFrame, keys: list[str], smooth: float = 1e-4, squared: bool = True, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Mean log loss and soft Dice loss per key, and their weighted sum; probabilities are held within
    1e-7 of 0 and 1 in the log loss."""
    t, raw = F.col("target").cast("double"), F.col("prob")
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), raw))
    bce = -F.avg(t * F.log(p) + (1 - t) * F.log(1 - p))
    den = F.sum(raw * raw) + F.sum(t * t) if squared else F.sum(raw) + F.sum(t)
    return scored.groupBy(*keys).agg(bce.alias("bce"), (1 - (2 * F.sum(raw * t) + smooth) / (den + smooth)).alias("dice_loss")).withColumn("loss", weights[0] * F.col("bce") + weights[1] * F.col("dice_loss"))


def threshold_histogram(scored: DataFrame, prob: Column, first: int, last: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives by the highest threshold (in hundredths, first to last) that a score
    reaches; `first - 1` where it reaches none.  One pass, one row per bin."""
    at = F.least(F.lit(last), F.floor(F.round(prob * 100, 9)).cast("int"))
    return scored.select(*keys, F.greatest(F.lit(first - 1), at).alias("bin"), F.col("target")).groupBy(*keys, "bin").agg(F.count_if("target").alias("pos"), F.count_if(~F.col("target")).alias("neg"))


def sweep(scored: DataFrame, prob: str = "prob", first: int = 5, last: int = 95) -> DataFrame:
    """Counts, precision, recall and F1 at every threshold from first to last hundredths.

    Thresholds come from a running sum over the histogram's at most last - first + 2 rows."""
    return _curve(threshold_histogram(scored, F.col(prob), first, last), first, last)


def _curve(h: DataFrame, first: int, last: int) -> DataFrame:
    grid = h.sparkSession.range(first - 1, last + 1).select(F.col("id").cast("int").alias("bin"))
    h = grid.join(h, "bin", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    c = h.select("bin", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("neg").over(whole).alias("n"), F.sum("pos").over(whole).alias("p"))
    c = c.where(F.col("bin") >= first).select((F.col("bin") / 100).alias("threshold"), "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))
    return metrics(c).select("threshold", *COUNTS, "precision", "recall", "f1")


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold with the largest F1, the lowest of equals."""
    return curve.orderBy(F.desc("f1"), "threshold").limit(1)


def tuned_scores(scored: DataFrame, choose: Column, score: Column, prob: str = "prob", threshold: float | None = None) -> DataFrame:
    """The threshold with the best F1 on the rows that `choose` takes (or the one given), and the eight
    metrics of the rows that `score` takes at it.  One pass makes both histograms.

    The first threshold wins among equals, also where there are no rows to choose by."""
    n = F.when(choose, F.lit("choose")).when(score, F.lit("score"))
    h = threshold_histogram(scored.withColumn("part", n).where(F.col("part").isNotNull()), F.col(prob), 5, 95, ("part",))
    if threshold is None:
        own = h.where("part = 'choose'")
        best = best_threshold(_curve(own, 5, 95)).select("threshold", F.col("f1").alias("chosen_f1"))
    else:
        best = scored.sparkSession.range(1).select(F.lit(threshold).alias("threshold"), F.lit(None).cast("double").alias("chosen_f1"))
    at = F.round(F.col("threshold") * 100).cast("int")
    c = h.where("part = 'score'").join(F.broadcast(best)).groupBy("threshold", "chosen_f1").agg(
        *[F.sum(F.when(k, F.col(v)).otherwise(0)).alias(c) for c, v, k in (("tp", "pos", F.col("bin") >= at), ("fp", "neg", F.col("bin") >= at), ("tn", "neg", F.col("bin") < at), ("fn", "pos", F.col("bin") < at))]
    )
    return metrics(c)


def operating_points(curve: DataFrame, least_recall: float) -> DataFrame:
    """For a classifier: the threshold with the largest F1 (the highest of equals) and the highest one
    whose recall is at least least_recall."""
    f1 = F.max(F.struct("f1", "threshold"))["threshold"].alias("best_f1")
    return curve.agg(f1, F.max(F.when(F.col("recall") >= least_recall, F.col("threshold"))).alias("target_recall"))


def running_before(df: DataFrame, value: str, sums: list[str], parts: int = 256) -> DataFrame:
    """Adds <name>_before for each of sums: its sum over the rows with a smaller value (values are
    distinct).  Sums run within parts cut at a sample of the values, taken by hash, and over the
    parts' totals, so no task orders more than a few of the `parts` parts of the rows."""
    sample = df.select(value).orderBy(F.xxhash64(value), value).limit(parts - 1)
    cuts = sample.agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    df = df.join(F.broadcast(cuts)).withColumn("_part", part).drop("_cuts")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sums]).select("_part", *[F.coalesce(F.sum(s).over(upto), F.lit(0)).alias(f"_{s}") for s in sums])  # at most `parts` rows
    inner = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"{s}_before") for s in sums]).join(F.broadcast(totals), "_part")
    return df.withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"_{s}") for s in sums}).drop("_part", *[f"_{s}" for s in sums])


def roc_auc(scored: DataFrame, score: str = "prob") -> DataFrame:
    """Area under the ROC curve with mid-ranks for ties; null when a class is missing.

    Rows are grouped by score first; running sums over distinct scores take two levels."""
    g = scored.groupBy(score).agg(F.count_if("target").cast("double").alias("p"), F.count_if(~F.col("target")).cast("double").alias("n"))
    g = running_before(g, score, ["n"]).withColumn("won", F.col("p") * (F.col("n_before") + F.col("n") / 2))
    return g.agg(ratio_or_null(F.sum("won"), F.sum("p") * F.sum("n")).alias("auc"))


def ks_statistic(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Largest difference of two samples' distribution functions."""
    both = left.select(value, F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select(value, F.lit(0), F.lit(1))).groupBy(value).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = both.agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    d = F.abs((F.col("a_before") + F.col("a")) / F.col("_na") - (F.col("b_before") + F.col("b")) / F.col("_nb"))
    return running_before(both, value, ["a", "b"]).join(F.broadcast(whole)).select(d.alias("d")).agg(F.max("d").alias("ks"))


def class_weight(patches: DataFrame) -> DataFrame:
    """Negatives per positive of patches (target); fails when either is missing."""
    c = patches.agg(F.count_if("target").alias("pos"), F.count_if(~F.col("target")).alias("neg"))
    return c.select(F.when((F.col("pos") == 0) | (F.col("neg") == 0), F.raise_error(F.lit("one class is missing"))).otherwise(F.col("neg") / F.col("pos")).cast("double").alias("weight"))


def patch_records(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per patch: Dice, mean probability, whether it holds any target, predicted fraction."""
    pred, t = binarise(F.col("prob"), threshold), F.col("target")
    both, p, g = F.count_if(pred & t), F.count_if(pred), F.count_if(t)
    return scored.groupBy("image_id", "patch_id").agg(ratio(2 * both, p + g).alias("dice"), F.avg("prob").alias("mean_probability"), (g > 0).alias("is_positive"), (p / F.count("*")).alias("predicted_fraction"))


def fp_decomposition(scored: DataFrame, threshold: float = 0.5, positive: DataFrame | None = None, favourable: float = 0.5) -> DataFrame:
    """False positives in patches without any target (a gate can drop them) against those in patches
    with some, the rate in empty patches, and whether a gate would help: from the share `favourable` on.  `positive` (patch_id, is_positive) says which
    patches are positive; without it, those with a target pixel."""
    per = scored.groupBy("patch_id").agg(F.count_if(binarise(F.col("prob"), threshold) & ~F.col("target")).alias("fp"), F.bool_or("target").alias("is_positive"))
    if positive is not None:
        per = per.drop("is_positive").join(positive, "patch_id")
    inter = F.sum(F.when(~F.col("is_positive"), F.col("fp")).otherwise(0)).alias("inter_patch_fp")
    intra = F.sum(F.when(F.col("is_positive"), F.col("fp")).otherwise(0)).alias("intra_patch_fp")
    c = per.agg(inter, intra, F.count_if(~F.col("is_positive")).alias("empty_patches"), F.count_if(~F.col("is_positive") & (F.col("fp") > 0)).alias("empty_fired"))
    total = F.col("inter_patch_fp") + F.col("intra_patch_fp")
    share = ratio(F.col("inter_patch_fp"), total)
    # The three labels.
    label = F.when(total == 0, "insufficient-data").when(share >= favourable, "gate-favourable").otherwise("gate-limited")
    return c.select("inter_patch_fp", "intra_patch_fp", share.alias("inter_fraction"), ratio(F.col("empty_fired"), F.col("empty_patches")).alias("empty_fp_rate"), label.alias("label"))


def two_stage(scored: DataFrame, gate_threshold: float, threshold: float) -> DataFrame:
    """A patch gate before the segmentation: gate precision, recall, F1 and miss rate; precision and
    recall of routed patches and end to end, where a rejected patch's targets are all missed.
    Denominators are at least 1 and ratios have 6 decimals."""
    pred, t = binarise(F.col("prob"), threshold), F.col("target")
    per = scored.groupBy("patch_id").agg(F.avg("gate").alias("gate"), F.bool_or("target").alias("is_positive"), *confusion(pred, t)).withColumn("routed", F.col("gate") >= gate_threshold)
    g = F.col("routed")
    c = per.agg(
        F.count_if(g & F.col("is_positive")).alias("gtp"), F.count_if(g & ~F.col("is_positive")).alias("gfp"), F.count_if(~g & F.col("is_positive")).alias("gfn"), F.count_if(g).alias("routed"), F.count("*").alias("patches"),
        *[F.sum(F.when(g, F.col(x)).otherwise(0)).alias(x) for x in ("tp", "fp", "fn")], F.sum(F.when(~g, F.col("tp") + F.col("fn")).otherwise(0)).alias("lost"),
    )
    r6 = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn") + F.col("lost")
    return c.select(
        r6(F.col("gtp"), F.col("gtp") + F.col("gfp")).alias("gate_precision"), r6(F.col("gtp"), F.col("gtp") + F.col("gfn")).alias("gate_recall"), r6(2 * F.col("gtp"), 2 * F.col("gtp") + F.col("gfp") + F.col("gfn")).alias("gate_f1"), r6(F.col("gfn"), F.col("gtp") + F.col("gfn")).alias("gate_fnr"),
        r6(tp, tp + fp).alias("precision"), r6(tp, tp + F.col("fn")).alias("routed_recall"), r6(tp, tp + fn).alias("recall"), r6(2 * tp, 2 * tp + fp + fn).alias("dice"), r6(F.col("routed"), F.col("patches")).alias("routed_fraction"),
    )


def joint_sweep(scored: DataFrame, gates: tuple[int, int] = (5, 95), thresholds: tuple[int, int] = (10, 90), step: int = 5) -> DataFrame:
    """Precision, recall and Dice end to end at every pair of gate and pixel thresholds (hundredths).

    One pass makes a histogram by (gate bin, pixel bin); two running sums over it replace a pass for
    every pair."""
    spark = scored.sparkSession
    gate_of = scored.groupBy("patch_id").agg(F.avg("gate").alias("_gate"))
    s = scored.join(gate_of, "patch_id")
    cut = lambda v, a, b: F.greatest(F.lit(a - step), F.least(F.lit(b), (F.floor(F.round(v * 100, 6) / step) * step).cast("int")))
    h = s.groupBy(cut(F.col("_gate"), *gates).alias("g"), cut(F.col("prob"), *thresholds).alias("t")).agg(F.count_if("target").alias("pos"), F.count_if(~F.col("target")).alias("neg"))
    grid = spark.range(gates[0] - step, gates[1] + 1, step).select(F.col("id").cast("int").alias("g"), F.explode(F.sequence(F.lit(thresholds[0] - step), F.lit(thresholds[1]), F.lit(step))).alias("t"))
    h = grid.join(h, ["g", "t"], "left").na.fill(0, ["pos", "neg"])
    by_t = Window.partitionBy("g").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("g", "t", F.sum("pos").over(by_t).alias("pos"), F.sum("neg").over(by_t).alias("neg"), F.sum("pos").over(Window.partitionBy()).alias("all_pos"))
    by_g = Window.partitionBy("t").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("g", "t", F.sum("pos").over(by_g).alias("tp"), F.sum("neg").over(by_g).alias("fp"), "all_pos").where((F.col("g") >= gates[0]) & (F.col("t") >= thresholds[0]))
    return h.select((F.col("g") / 100).alias("gate"), (F.col("t") / 100).alias("threshold"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"), ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")).alias("dice"))



def pareto_front(curve: DataFrame) -> DataFrame:
    """By falling recall, the rows whose precision is not below that of any row before."""
    before = Window.orderBy(F.desc("recall"), "threshold").rowsBetween(Window.unboundedPreceding, -1)
    return curve.withColumn("_best", F.max("precision").over(before)).where(F.col("_best").isNull() | (F.col("precision") >= F.col("_best"))).drop("_best")


def hard_negatives(scored: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """The k patches without any target that have most false positives, then the highest mean score."""
    per = scored.groupBy("image_id", "patch_id").agg(F.bool_or("target").alias("is_positive"), F.count_if(binarise(F.col("prob"), threshold)).alias("fp_pixels"), F.avg("prob").alias("mean_probability"))
    return per.where(~F.col("is_positive") & (F.col("fp_pixels") > 0)).drop("is_positive").orderBy(F.desc("fp_pixels"), F.desc("mean_probability"), "patch_id").limit(k)


def fired_patches(scored: DataFrame, threshold: float, quiet: float) -> DataFrame:
    """Patches without any target: fired where their peak score reaches the threshold, quiet where it
    is below `quiet`; patches between the two are neither and not listed."""
    per = scored.groupBy("image_id", "patch_id").agg(F.bool_or("target").alias("is_positive"), F.max("prob").alias("peak"))
    per = per.where(~F.col("is_positive")).select("image_id", "patch_id", "peak", (F.col("peak") >= threshold).alias("fired"))
    return per.where(F.col("fired") | (F.col("peak") < quiet))


def equal_width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) between the smallest and largest finite value; the last bin is closed."""
    v = F.col(value).cast("double")
    df = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ends = df.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / width))).cast("int")
    n = df.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    return n.select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n")


def frame_summary(scored: DataFrame, threshold: float = 0.5, lines: DataFrame | None = None) -> DataFrame:
    """Per image without labels: predicted pixels and fraction, mean and largest score and, with the
    pixels (image_id, y, x) of lines, how many there are."""
    p = F.count_if(binarise(F.col("prob"), threshold))
    out = scored.groupBy("image_id").agg(p.alias("predicted"), (p / F.count("*")).alias("fraction"), F.avg("prob").alias("mean_probability"), F.max("prob").alias("max_probability"))
    if lines is None:
        return out
    n = lines.select("image_id", "y", "x").distinct().groupBy("image_id").agg(F.count("*").alias("line_pixels"))
    return out.join(n, "image_id", "left").na.fill(0, ["line_pixels"])


VIEWS = ("as_is", "flip_x", "flip_y", "turned")


def view_mean(scored: DataFrame, height: int, width: int) -> DataFrame:
    """The mean score of each pixel over models and views (image_id, model, view, y, x, prob,
    normalisation): each view's flip or half turn is undone first.  Fails on other views, and where
    models of one image were fed by different normalisations."""
    v, y, x = F.col("view"), F.col("y"), F.col("x")
    known = F.when(v.isin(*VIEWS), v).otherwise(F.raise_error(F.concat(F.lit("unknown view: "), F.coalesce(v, F.lit("null")))))
    s = scored.withColumn("view", known)
    s = s.withColumn("y", F.when(v.isin("flip_y", "turned"), height - 1 - y).otherwise(y)).withColumn("x", F.when(v.isin("flip_x", "turned"), width - 1 - x).otherwise(x))
    mean = F.when(F.min("normalisation").eqNullSafe(F.max("normalisation")), F.avg("prob")).otherwise(F.raise_error(F.lit("models differ in normalisation")).cast("double"))
    return s.groupBy("image_id", "y", "x").agg(mean.alias("prob"))


def ensemble_mean(scored: DataFrame, probs: list[str]) -> DataFrame:
    """The mean score of several models for each row, as `prob`."""
    return scored.withColumn("prob", sum((F.col(p) for p in probs[1:]), F.col(probs[0])) / len(probs))
