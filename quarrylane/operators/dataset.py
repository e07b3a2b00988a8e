"""Building and auditing a patch dataset: splits, sampling, joins of statistics, checks."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest, gaussian, number


def parse_observation(name: Column) -> Column:
    """The timestamp in ML1_YYYYMMDD_HHMMSS; null where the name has none; a bad date fails."""
    d = F.regexp_extract(name, r"ML1_(\d{8})_(\d{6})", 1)
    t = F.regexp_extract(name, r"ML1_(\d{8})_(\d{6})", 2)
    return F.when(F.length(d) > 0, F.to_timestamp(F.concat(d, t), "yyyyMMddHHmmss"))


def mask_path(path: Column) -> Column:
    """The mask of a frame, by suffix; other names fail."""
    return F.when(path.rlike(r"_red\.fits_full\.png$"), F.regexp_replace(path, r"_red\.fits_full\.png$", "_red_mask.png")).when(path.rlike(r"_image\.png$"), F.regexp_replace(path, r"_image\.png$", "_mask.png")).otherwise(F.raise_error(F.concat(F.lit("no mask rule for "), path)))


def patch_name(path: Column, y: Column, x: Column) -> Column:
    return F.concat_ws("_", F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.png$", ""), y.cast("string"), x.cast("string"))


def parse_patch(path: Column) -> tuple[Column, Column]:
    """(y, x) of a patch named <stem>_<y>_<x>_image; fails on other names."""
    part = lambda i: F.regexp_extract(path, r"_(\d+)_(\d+)_image", i)
    ok = F.when(path.rlike(r"_\d+_\d+_image"), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a patch name: "), path)))
    return tuple(F.coalesce(ok.cast("int"), part(i).cast("int")) for i in (1, 2))


def seeded_ranks(df: DataFrame, group: str, seed: int, *keys: str) -> DataFrame:
    """Adds _r, each row's place from 0 on in its group by seeded order of the keys, and _n, the group's rows.

    Rows are ordered within the first three hex digits of their digests, and the counts of those give what
    stands before: no task orders more than a few of 4,096 parts of a group."""
    d = df.withColumn("_d", digest(seed, *[F.col(k) for k in keys])).withColumn("_b", F.substring("_d", 1, 3))
    parts = d.groupBy(group, "_b").agg(F.count("*").alias("_k"))  # at most 4,096 rows per group
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_b", before.alias("_before"), F.sum("_k").over(Window.partitionBy(group)).alias("_n"))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_d", *keys)) - 1)
    return d.hint("merge").join(parts, [group, "_b"]).withColumn("_r", F.col("_before") + F.col("_i")).select(*df.columns, "_r", "_n")


def image_splits(counts: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """(image, positives, quartile, split): images of each quartile of positives, in seeded order, are cut
    by floors of the ratios; test takes the rest."""
    if not (0 < train and 0 < val and train + val < 1):
        raise ValueError("ratios must be positive and leave something for test")
    q = counts.agg(F.percentile("positives", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    p = F.col("positives")
    quartile = F.when(p <= F.col("q")[0], 0).when(p <= F.col("q")[1], 1).when(p <= F.col("q")[2], 2).otherwise(3)
    c = counts.join(F.broadcast(q)).withColumn("quartile", quartile).drop("q")
    c = seeded_ranks(c, "quartile", seed, "image")
    # Exact: 0.7 of 90 is 63, in doubles 62.99.
    a, b = (F.floor(F.col("_n").cast("decimal(19,0)") * F.lit(Decimal(str(share)))).cast("long") for share in (train, val))
    return c.withColumn("split", F.when(F.col("_r") < a, "train").when(F.col("_r") < a + b, "val").otherwise("test")).drop("_r", "_n")


def sample_negatives(manifest: DataFrame, per_positive: int, seed: int) -> DataFrame:
    """All positives and, per split, the first per_positive times as many negatives in seeded order.

    A histogram of negatives by the first two hex digits of their digest finds the bucket in which the
    quota ends; only that bucket is ranked, so no split is ever sorted in one task."""
    pos, neg = F.col("fraction") > 0, F.col("fraction") <= 0
    m = manifest.withColumn("_d", digest(seed, F.col("patch"))).withColumn("_b", F.substring("_d", 1, 2))
    quota = m.groupBy("split").agg((F.count_if(pos) * per_positive).alias("_quota"))
    buckets = m.where(neg).groupBy("split", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("split").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = buckets.withColumn("_before", before).join(quota, "split").select("split", "_b", (F.col("_quota") - F.col("_before")).alias("_left"), (F.col("_before") + F.col("_n") <= F.col("_quota")).alias("_whole"))
    n = m.where(neg).join(F.broadcast(cut), ["split", "_b"])  # at most 256 rows per split
    edge = n.where(~F.col("_whole") & (F.col("_left") > 0)).withColumn("_r", F.row_number().over(Window.partitionBy("split", "_b").orderBy("_d", "patch"))).where(F.col("_r") <= F.col("_left"))
    keep = manifest.columns
    return m.where(pos).select(keep).union(n.where("_whole").select(keep)).union(edge.select(keep))


def image_subset(manifest: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Other splits whole, and of train the first max(1, round(fraction * n)) images in seeded order:
    smaller fractions are subsets of larger ones."""
    images = manifest.where("split = 'train'").select("source_image", F.lit(0).alias("_all")).distinct()
    kept = seeded_ranks(images, "_all", seed, "source_image").where(F.col("_r") < F.greatest(F.lit(1), F.bround(F.col("_n") * fraction))).select("source_image")
    return manifest.where("split <> 'train'").union(manifest.where("split = 'train'").join(kept, "source_image", "left_semi").select(manifest.columns))


def patch_lists(stats: DataFrame, splits: DataFrame) -> DataFrame:
    """The patches of patch_statistics with the split of their image (image_id, split) and whether they
    hold a positive pixel; patches of images without a split fail."""
    j = stats.join(splits.select("image_id", "split"), "image_id", "left")
    split = F.when(F.col("split").isNull(), F.raise_error(F.concat(F.lit("no split for image "), F.col("image_id").cast("string")))).otherwise(F.col("split"))
    return j.withColumn("split", split).withColumn("is_positive", ~F.col("is_empty"))


def image_patch_summary(images: DataFrame, patches: DataFrame) -> DataFrame:
    """The image summary with the number of each image's non-empty patches (null without patches),
    fewest first."""
    n = patches.groupBy("image_id").agg(F.count_if(~F.col("is_empty")).alias("non_empty_patches"))
    return images.join(n, "image_id", "left").orderBy("non_empty_patches", "image_id")


def attach_statistics(manifest: DataFrame, stats: DataFrame) -> DataFrame:
    """Image statistics on every patch; images without any get nulls."""
    return manifest.join(stats.select("source_image", "image_mean", "image_std"), "source_image", "left")


def image_statistics(px: DataFrame) -> DataFrame:
    """Mean and population deviation per image, from whole-number sums; also on the scale of 0 to 1."""
    s = px.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count_if(F.col("v") > 0).alias("positive"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return s.select("image_id", "n", mean.alias("mean"), std.alias("std"), (mean / 255).alias("mean01"), (std / 255).alias("std01"), "positive", (F.col("positive") / F.col("n")).alias("positive_fraction"))


def normalise(px: DataFrame, mode: str = "per_image", keys: tuple[str, ...] = ("image_id",), stats: DataFrame | None = None, eps: float = 1e-6) -> DataFrame:
    """Adds z, the normalised value of each pixel v.

    "fixed": (v - 0.5) / 0.5 for values from 0 to 1.  "per_image": the z-score within each patch, told
    by `keys` (sample deviation).  "full_image": the z-score by stats (image_id, image_mean,
    image_std), and the patch's own where the image has none or a NaN."""
    if mode not in ("fixed", "per_image", "full_image"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "fixed":
        return px.withColumn("z", (F.col("v") - 0.5) / 0.5)
    own = px.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    px = px.join(own, list(keys))
    z = (F.col("v") - F.col("_m")) / (F.col("_s") + eps)
    if mode == "per_image":
        return px.withColumn("z", z).drop("_m", "_s")
    px = px.join(stats.select("image_id", F.nanvl(F.col("image_mean"), F.lit(None)).alias("_im"), F.nanvl(F.col("image_std"), F.lit(None)).alias("_is")), "image_id", "left")
    return px.withColumn("z", F.coalesce((F.col("v") - F.col("_im")) / (F.col("_is") + eps), z)).drop("_m", "_s", "_im", "_is")


def add_noise(px: DataFrame, alpha: float, beta: float, multiplier: float, seed: int) -> DataFrame:
    """Signal-dependent Gaussian noise on values p from 0 to 1, clipped: deviation m * sqrt(alpha * p + beta ** 2)."""
    if alpha < 0 or beta < 0 or multiplier <= 0:
        raise ValueError("alpha and beta must not be negative, multiplier must be positive")
    p = F.col("p")
    noisy = p + multiplier * F.sqrt(alpha * p + beta * beta) * gaussian(seed, F.col("image_id"), F.col("y"), F.col("x"))
    return px.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), noisy)))


def augment(px: DataFrame, size: int, seed: int, keys: tuple[str, ...] = ("image_id",), where: Column | None = None) -> DataFrame:
    """Flips and quarter turns of square patches, drawn once per patch (told by `keys`), so that frame
    and mask move alike; only rows that `where` takes (such as those of the train split) move."""
    still = F.lit(False) if where is None else ~F.coalesce(where, F.lit(False))
    bit = lambda k, n: F.when(still, 0).otherwise(number(f"{seed}|{k}", *[F.col(c) for c in keys]) % n)
    last = size - 1
    px = px.withColumn("x", F.when(bit("h", 2) == 1, last - F.col("x")).otherwise(F.col("x"))).withColumn("y", F.when(bit("v", 2) == 1, last - F.col("y")).otherwise(F.col("y")))
    k, y, x = bit("r", 4), F.col("y"), F.col("x")
    ny = F.when(k == 0, y).when(k == 1, last - x).when(k == 2, last - y).otherwise(x)
    nx = F.when(k == 0, x).when(k == 1, y).when(k == 2, last - x).otherwise(last - y)
    return px.withColumns({"y": ny, "x": nx})


def stretch(px: DataFrame, low: float, high: float, levels: int | None = None, unlisted: tuple[int, int] | None = None) -> DataFrame:
    """Clips 8-bit values to two percentiles of their image and scales to 0 to 1, or to whole numbers up
    to `levels` (half-even); all 0 if the percentiles are equal.

    The percentiles (linear interpolation) come from a histogram of at most 256 values per image.  A frame
    may list only some of its pixels: `unlisted` is the value of the others and the pixels of a frame, and the
    column `rest` is what that value becomes."""
    h = px.groupBy("image_id", "v").agg(F.count("*").alias("k"))
    if unlisted:
        value, area = unlisted
        others = h.groupBy("image_id").agg((F.lit(area) - F.sum("k")).alias("k")).where("k > 0")
        h = h.unionByName(others.withColumn("v", F.lit(value).cast(px.schema["v"].dataType)))
    q = h.groupBy("image_id").agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100)), F.col("k")).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]

    def scaled(v):
        s = F.when(hi <= lo, F.lit(0.0)).otherwise((F.greatest(lo, F.least(hi, v.cast("double"))) - lo) / (hi - lo))
        return F.bround(s * levels).cast("int") if levels else s

    out = px.join(q, "image_id").withColumn("s", scaled(F.col("v")))
    return (out.withColumn("rest", scaled(F.lit(unlisted[0]))) if unlisted else out).drop("q")


def fill_nonfinite(px: DataFrame, value: str = "v") -> DataFrame:
    """Replaces nulls, NaN and infinities by the image's median finite value; `filled` marks them."""
    v = F.col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    # One row per distinct value with its count: what is held for a frame is its values, not its pixels.
    h = px.groupBy("image_id", F.when(~bad, v).alias("_v")).agg(F.count("*").alias("_k"))
    m = h.groupBy("image_id").agg(F.percentile("_v", 0.5, F.col("_k")).alias("_m"))
    m = m.withColumn("_m", F.when(F.col("_m").isNull(), F.raise_error(F.concat(F.lit("no finite pixel in image "), F.col("image_id").cast("string")))).otherwise(F.col("_m")))
    return px.join(m, "image_id").withColumns({value: F.when(bad, F.col("_m")).otherwise(v), "filled": F.coalesce(bad, F.lit(True))}).drop("_m")


def downsample(px: DataFrame, factor: float) -> DataFrame:
    """Area means on a grid coarser by any factor of at least 1: each pixel adds to the up to four cells
    it overlaps, by the overlap."""
    if factor < 1:
        raise ValueError("factor must be at least 1")

    def cells(c: str) -> Column:
        a, b = F.col(c) / factor, (F.col(c) + 1) / factor
        seq = F.sequence(F.floor(a), F.ceil(b) - 1)
        return F.transform(seq, lambda i: F.struct(i.alias("i"), (F.least(b, i + 1) - F.greatest(a, i)).alias("w")))

    p = px.select("image_id", "v", F.explode(cells("y")).alias("cy"), cells("x").alias("cxs")).select("image_id", "v", "cy", F.explode("cxs").alias("cx")).where("cy.w > 1e-12 AND cx.w > 1e-12")
    w = F.col("cy.w") * F.col("cx.w")
    return p.groupBy("image_id", F.col("cy.i").alias("y"), F.col("cx.i").alias("x")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))


def append_hard_negatives(manifest: DataFrame, mined: DataFrame, repeat: int) -> DataFrame:
    """Train rows and `repeat` further copies of the mined ones; fails when one is not in train."""
    train = manifest.where("split = 'train'")
    checked = mined.select("patch").distinct().join(train.select("patch", F.lit(True).alias("_known")).distinct(), "patch", "left")
    checked = checked.select(F.when(F.col("_known"), F.col("patch")).otherwise(F.raise_error(F.lit("a mined patch is not in train"))).cast("long").alias("patch"))
    more = train.join(checked, "patch", "left_semi").select(manifest.columns).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop("_i")
    return train.unionByName(more)


def split_leaks(manifest: DataFrame) -> DataFrame:
    """Pairs of splits that share source images: how many, and the first."""
    d = manifest.select("split", "source_image").distinct()
    a, b = d.select(F.col("split").alias("a"), "source_image"), d.select(F.col("split").alias("b"), "source_image")
    return a.join(b, "source_image").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("source_image").alias("example"))


def audit(manifest: DataFrame, masks: DataFrame | None = None, files: DataFrame | None = None, strict: bool = False, patch_size: int = 528, tolerance: float = 1e-6) -> DataFrame:
    """One row per check of a manifest (split, source_image, patch, fraction): failing rows and ok.

    With image_mean and image_std: images of which only some patches, or only one of the two, have
    statistics, means outside 0 to 1 and deviations not above 0 and, if strict, rows without any.
    With masks (patch, positive_pixels, pixels): fractions that differ from the mask's by more than
    the tolerance.  With files (patch, height, width, mask_height, mask_width), one row per patch that
    is on disk: patches without files, and sides other than patch_size."""
    m = manifest
    checks = ["split_values", "fraction_range", "missing_values", "repeated_patches", "class_balance", "split_leaks"]
    ok_split = F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False))
    fraction, none = F.col("fraction"), F.lit(None).cast("double")
    bad = {
        "split_values": ~ok_split,
        "fraction_range": fraction.isNull() | (fraction < 0) | (fraction > 1),
        "missing_values": F.col("source_image").isNull() | F.col("patch").isNull(),
    }
    mean = std = none
    if {"image_mean", "image_std"} <= set(manifest.columns):
        mean, std = (F.when(~F.isnan(c), F.col(c)) for c in ("image_mean", "image_std"))
        checks.append("statistics_pattern")
        bad["statistics_range"] = (mean < 0) | (mean > 1) | (std <= 0)
        if strict:
            bad["statistics_missing"] = mean.isNull()
    if masks is not None:
        m = m.join(masks.select("patch", F.col("positive_pixels").alias("_on"), F.col("pixels").alias("_of")), "patch", "left")
        bad["fraction_recomputed"] = F.abs(fraction - F.col("_on") / F.col("_of")) > tolerance
    if files is not None:
        sides = ("height", "width", "mask_height", "mask_width")
        m = m.join(files.select("patch", *[F.col(c).alias(f"_{c}") for c in sides], F.lit(True).alias("_there")), "patch", "left")
        bad["absent_files"] = F.col("_there").isNull()
        bad["patch_shapes"] = reduce(lambda x, y: x | y, [F.col(f"_{c}") != patch_size for c in sides])
    # One scan: every row counts once for its image, once for its patch and once for its split.
    row = m.select("source_image", "patch", "split", (fraction > 0).alias("_positive"), mean.alias("_mean"), std.alias("_std"), *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in bad.items()])
    image, patch, split = F.col("source_image"), F.col("patch"), F.col("split")
    g = row.withColumn("_s", split).groupingSets([[image], [patch], [split]], image, patch, split).agg(
        F.grouping("source_image").alias("_i"), F.grouping("patch").alias("_p"), F.grouping("split").alias("_k"), F.count("*").alias("_n"), F.count("_mean").alias("_m"), F.count("_std").alias("_d"),
        F.coalesce(F.max("_positive"), F.lit(False)).alias("_any"), F.countDistinct("_s").alias("_splits"), *[F.sum(n).alias(n) for n in bad],
    )
    of_image, of_patch, of_split = (F.col(c) == 0 for c in ("_i", "_p", "_k"))
    total = lambda rule, v: F.coalesce(F.sum(F.when(rule, v)), F.lit(0)).cast("long")
    sums = {n: total(of_image, F.col(n)) for n in bad}
    sums["repeated_patches"] = total(of_patch & patch.isNotNull(), F.col("_n") - 1)
    sums["class_balance"] = total(of_split & split.isNotNull() & ~F.col("_any"), F.lit(1))
    sums["split_leaks"] = total(of_image & image.isNotNull(), F.floor(F.col("_splits") * (F.col("_splits") - 1) / 2))
    if "statistics_pattern" in checks:
        sums["statistics_pattern"] = total(of_image, ((F.col("_m") != F.col("_d")) | ((F.col("_m") > 0) & (F.col("_m") < F.col("_n")))).cast("long"))
    one = g.agg(*[v.alias(n) for n, v in sums.items()])
    return one.unpivot([], one.columns, "check", "failing").withColumn("ok", F.col("failing") == 0)


def densest(patches: DataFrame, k: int) -> DataFrame:
    return patches.where("fraction > 0").orderBy(F.desc("fraction"), "source_image", "patch").limit(k)


def seeded_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in seeded order."""
    return df.orderBy(digest(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def quota_sample(df: DataFrame, groups: list[str], quota: int, seed: int, *keys: str, pooled: int | None = None, pool: tuple[str, ...] = ()) -> DataFrame:
    """At most `quota` rows of each group, in seeded order; with `pooled`, then at most so many rows of
    each pool (the columns `pool`, such as the category without its image)."""
    order = (digest(seed, *[F.col(k) for k in keys]), *keys)
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_r") <= quota)
    if pooled is not None:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*pool).orderBy(*order))).where(F.col("_r") <= pooled)
    return df.drop("_r")


def noise_calibration(px: DataFrame) -> DataFrame:
    """Of background pixels: mu, sigma (population, on 0 to 1), alpha = sigma^2 / (2 mu) and
    beta = sigma / sqrt(2), so that alpha * mu + beta^2 is sigma^2; a mean that isn't positive fails."""
    s = px.agg(F.count("*").alias("n"), (F.sum("v") / F.count("*") / 255).alias("mu"), (F.sum(F.col("v") * F.col("v")) / F.count("*") / 65025).alias("q"))
    var = F.greatest(F.lit(0.0), F.col("q") - F.col("mu") * F.col("mu"))
    mu = F.when(F.col("mu") > 0, F.col("mu")).otherwise(F.raise_error(F.lit("the background's mean isn't positive")).cast("double"))
    return s.select("n", mu.alias("mu"), F.sqrt(var).alias("sigma"), (var / (2 * mu)).alias("alpha"), F.sqrt(var / 2).alias("beta"))
