"""Studies of streaks: profiles, recall per component, crops, line strata, audits, run comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from . import labels as L
from . import pixels as P
from . import runs as R
from .dataset import seeded_ranks, stretch
from .kernels import component_widths, edge_pixels
from .metrics import metrics, ratio, sparse_counts

PX = P.PX


def histogram_median(hist: DataFrame, *keys: str) -> DataFrame:
    """Median of unit-wide bins (keys, bin, n): a linear step in the first bin that reaches half."""
    w = Window.partitionBy(*keys).orderBy("bin")
    h = hist.withColumn("_c", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_half", F.sum("n").over(Window.partitionBy(*keys)) / 2)
    first = h.where((F.col("_c") >= F.col("_half")) & (F.col("n") > 0))
    step = F.col("bin") + (F.col("_half") - (F.col("_c") - F.col("n"))) / F.col("n")
    return first.groupBy(*keys).agg(F.min_by(step, "bin").alias("median"))


def main_axes(labelled: DataFrame) -> DataFrame:
    """(image_id, component, angle, cy, cx): angle of each component's main axis and its centre.  Sums of whole
    numbers are exact, so no order of the pixels changes a bit."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    s = labelled.groupBy("image_id", "component").agg(*[F.sum(c).alias(n) for n, c in {"n": F.lit(1).cast("long"), "sy": y, "sx": x, "syy": y * y, "sxx": x * x, "sxy": x * y}.items()])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    spread = lambda ab, a, b: (whole("n") * whole(ab) - whole(a) * whole(b)).cast("double")
    angle = F.atan2(2 * spread("sxy", "sx", "sy"), spread("sxx", "sx", "sx") - spread("syy", "sy", "sy")) / 2
    return s.select("image_id", "component", angle.alias("angle"), (F.col("sy") / F.col("n")).alias("cy"), (F.col("sx") / F.col("n")).alias("cx"))


#: Places along an axis that go to a tile together, and values that a task reads at once.
ALONG = 256
AT_ONCE = 1 << 19


def medians(key: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys and the median of each one's values, as F.percentile has it."""
    order = np.lexsort((v, key))
    key, v = key[order], v[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first, append=len(key))
    return key[first], 0.5 * v[first + (n - 1) // 2] + 0.5 * v[first + n // 2]


def read_tile(blocks: pa.Table, px: pa.Table, reach: int, stride: int, missing: float | None, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of blocks, offsets, values): what blocks of places along axes read in their tile, by bilinear
    interpolation; components that are whole in it give their medians only.

    Values lie between corners, so where those are equal the value is theirs to the last bit, which a sum of
    weighted values is not."""
    n = {c: blocks.column(c).to_numpy() for c in ("ty", "tx", "cy", "cx", "sin", "cos", "t0", "t1", "my", "mx")}
    whole = blocks.column("whole").to_numpy(zero_copy_only=False)
    (ty, y0), (tx, x0) = ((n[c][0], n[c][0] * tile) for c in ("ty", "tx"))
    my, mx = n["my"][0], n["mx"][0]
    shape = tuple(int(min(tile, m - v)) + 1 for m, v in ((my, y0), (mx, x0)))
    grid = np.full(shape, float(missing or 0))
    y, x = px.column("y").to_numpy() - y0, px.column("x").to_numpy() - x0
    inside = (y < shape[0]) & (x < shape[1])
    grid[y[inside], x[inside]] = px.column("v").to_numpy(zero_copy_only=False)[inside]
    listed = None
    if missing is None:
        listed = np.zeros(shape, bool)
        listed[y[inside], x[inside]] = True
    offsets = np.arange(-reach, reach + 1)
    count = (n["t1"] - n["t0"]) // stride + 1
    for rows in np.split(np.arange(len(count)), np.flatnonzero(np.diff(np.cumsum(count * len(offsets)) // AT_ONCE)) + 1):
        row = np.repeat(rows, count[rows])
        k = np.arange(len(row)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        at = {c: v[row] for c, v in n.items() if c in ("cy", "cx", "sin", "cos", "t0")}
        t = at["t0"] + k * stride
        qy = (at["cy"] + t * at["sin"])[:, None] + offsets * at["cos"][:, None]
        qx = (at["cx"] + t * at["cos"])[:, None] - offsets * at["sin"][:, None]
        qy, qx = np.clip(qy, 0.0, float(my)), np.clip(qx, 0.0, float(mx))
        iy, ix = np.floor(qy).astype(np.int64), np.floor(qx).astype(np.int64)
        fy, fx = qy - iy, qx - ix
        own = (iy // tile == ty) & (ix // tile == tx)
        a, b = np.where(own, iy - y0, 0), np.where(own, ix - x0, 0)
        c, d = np.minimum(a + 1, my - y0), np.minimum(b + 1, mx - x0)
        low = grid[a, b] + fx * (grid[a, d] - grid[a, b])
        high = grid[c, b] + fx * (grid[c, d] - grid[c, b])
        v = low + fy * (high - low)
        if listed is not None:
            own &= listed[a, b] | listed[a, d] | listed[c, b] | listed[c, d]
        i, o = np.nonzero(own)
        i, v = row[i], v[own]
        key, mid = medians((i * len(offsets) + o)[whole[i]], v[whole[i]])
        yield np.append(i[~whole[i]], key // len(offsets)), offsets[np.append(o[~whole[i]], key % len(offsets))], np.append(v[~whole[i]], mid)


def profile(labelled: DataFrame, frame: DataFrame, reach: int, stride: int = 1, size: tuple[int, int] | None = None, missing: float | None = None, tile: int = L.TILE) -> DataFrame:
    """(image_id, component, offset, v): the median value across each component's main axis.

    Points between the 5th and 95th percentile along the axis are moved by each offset across it and
    read by bilinear interpolation; coordinates are held inside the frame.  A frame may list only some
    of its pixels: `missing` is the value of the others, and size its height and width.

    Axes meet the pixels of the tiles that they cross, and points exist in the arrays of a tile's task only: what
    is shuffled are pixels, axes cut into pieces, and values of components that cross a tile's border."""
    keys = ["image_id", "component"]
    a = main_axes(labelled)
    along = (F.col("x") - F.col("cx")) * F.cos("angle") + (F.col("y") - F.col("cy")) * F.sin("angle")
    span = labelled.hint("merge").join(a, keys).groupBy(*keys).agg(F.percentile(along, F.array(F.lit(0.05), F.lit(0.95))).alias("q"), *[F.first(c).alias(c) for c in ("cy", "cx", "angle")])
    axes = span.select(*keys, "cy", "cx", F.sin("angle").alias("sin"), F.cos("angle").alias("cos"), F.ceil(F.col("q")[0]).alias("t0"), F.floor(F.col("q")[1]).alias("last")).where("t0 <= last")
    if size:
        axes = axes.withColumns({"my": F.lit(size[0] - 1).cast("long"), "mx": F.lit(size[1] - 1).cast("long")})
    else:
        axes = axes.hint("merge").join(frame.groupBy("image_id").agg(F.max("y").cast("long").alias("my"), F.max("x").cast("long").alias("mx")), "image_id")

    def tiles(end: str, c: str, along: str, across: str) -> Column:
        """The rows or columns of tiles between the places t0 and end, with all offsets; a hair more, for rounding."""
        ends = [F.col(f"c{c}") + F.col(t) * F.col(along) for t in ("t0", end)]
        wide = F.lit(reach) * F.abs(across) + 1e-6
        held = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.col(f"m{c}").cast("double"), v)) / tile)
        return F.sequence(held(F.least(*ends) - wide), held(F.greatest(*ends) + wide))

    whole = (F.size(tiles("last", "y", "sin", "cos")) == 1) & (F.size(tiles("last", "x", "cos", "sin")) == 1)
    starts = F.when(F.col("whole"), F.array("t0")).otherwise(F.sequence("t0", "last", F.lit(ALONG * stride).cast("long")))
    blocks = axes.withColumn("whole", whole).withColumn("t0", F.explode(starts))
    blocks = blocks.withColumn("t1", F.when(F.col("whole"), F.col("last")).otherwise(F.least("last", F.col("t0") + (ALONG - 1) * stride)))
    blocks = blocks.withColumn("ty", F.explode(tiles("t1", "y", "sin", "cos"))).withColumn("tx", F.explode(tiles("t1", "x", "cos", "sin"))).drop("last")
    # A tile also has the first pixels of the next ones, which are corners of its last points.
    near = lambda c: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - 1) / tile)), F.floor(F.col(c) / tile))
    v = F.col("v").cast("double")
    px = frame.select(F.col("image_id").alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (v if missing is None else F.coalesce(v, F.lit(missing))).alias("v")).where("y >= 0 AND x >= 0 AND v IS NOT NULL")
    px = px.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))
    schema = labelled.select(*keys, F.lit(0).alias("offset"), F.lit(0.0).alias("v")).schema

    def read(blocks: pa.Table, px: pa.Table) -> pa.Table:
        parts = list(read_tile(blocks, px, reach, stride, missing, tile)) if blocks.num_rows else []
        row, offset, v = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        return pa.Table.from_arrays([*blocks.select(keys).take(pa.array(row)).columns, pa.array(offset.astype(np.int32)), pa.array(v.astype(np.float64))], names=[*keys, "offset", "v"])

    values = blocks.groupBy(*P.TILE).cogroup(px.groupBy(*P.TILE)).applyInArrow(read, schema)
    return values.groupBy(*keys, "offset").agg(F.percentile("v", 0.5).alias("v"))


def profile_metrics(prof: DataFrame, sideband: int, saturation: float = 250.0) -> DataFrame:
    """Per component: background (median of offsets at or beyond the sideband; of all, where there are
    none), scatter (1.4826 times the median deviation from it), peak over the background (at least 0),
    contrast (peak in scatters; null for a scatter of 1e-6 or less), width between the outermost
    offsets at half the peak or more (null without a peak), excess (trapezoids over the profile's
    positive part) and whether the raw peak is saturated."""
    keys = ["image_id", "component"]
    own = Window.partitionBy(*keys)
    line = own.orderBy("offset")
    p = prof.withColumn("_side", (F.abs("offset") >= sideband) | (F.count_if(F.abs("offset") >= sideband).over(own) == 0))
    p = p.withColumn("background", F.percentile(F.when(F.col("_side"), F.col("v")), 0.5).over(own)).withColumn("_e", F.col("v") - F.col("background"))
    p = p.withColumn("peak", F.greatest(F.max("_e").over(own), F.lit(0.0))).withColumn("_plus", F.greatest(F.col("_e"), F.lit(0.0)))
    p = p.withColumn("_area", (F.col("_plus") + F.lag("_plus").over(line)) / 2 * (F.col("offset") - F.lag("offset").over(line)))
    wide = F.when((F.col("peak") > 0) & (F.col("_e") >= F.col("peak") / 2), F.col("offset"))
    m = p.groupBy(*keys).agg(
        F.first("background").alias("background"), (1.4826 * F.percentile(F.when(F.col("_side"), F.abs("_e")), 0.5)).alias("scatter"), F.first("peak").alias("peak"),
        (F.max(wide) - F.min(wide)).cast("double").alias("fwhm"), F.coalesce(F.sum("_area"), F.lit(0.0)).alias("excess"), (F.max("v") >= saturation).alias("saturated"),
    )
    contrast = F.when(F.col("scatter") > 1e-6, F.col("peak") / F.col("scatter")).alias("contrast")
    return m.select(*keys, "background", "scatter", "peak", contrast, "fwhm", "excess", "saturated")


def component_recall(labelled: DataFrame, pred: DataFrame, post: DataFrame) -> DataFrame:
    """Per target component: share of its pixels in the prediction, after line completion, and added."""
    flag = lambda d, n: d.select(*PX).distinct().withColumn(n, F.lit(1))
    j = labelled.hint("merge").join(flag(pred, "a"), PX, "left").hint("merge").join(flag(post, "b"), PX, "left").groupBy("image_id", "component").agg(F.count("*").alias("area"), F.count("a").alias("pre"), F.count("b").alias("post"))
    return j.select("image_id", "component", "area", (F.col("pre") / F.col("area")).alias("recall_pre"), (F.col("post") / F.col("area")).alias("recall_post"), ((F.col("post") - F.col("pre")) / F.col("area")).alias("recall_added"))


def component_scores(labelled: DataFrame, pred: DataFrame, lines: DataFrame, patches: DataFrame, patch: int, margin: int, height: int, width: int) -> DataFrame:
    """Per target component, within the support of patches (image_id, y0, x0): the supported share and
    pixels, recall of the prediction, of it with lines, and what lines add, and the Dice of the
    component's box (with a margin, inside the frame) before and after lines, in which all predicted
    pixels of the support count.  Without supported pixels the share is 0 and the rest null."""
    keys = ["image_id", "component"]
    whole = labelled.groupBy(*keys).agg(F.count("*").alias("pixels"))
    own = P.within_support(labelled, patches, patch)
    pre, post = pred.select(*PX).distinct(), P.union(pred, lines)
    flags = pre.withColumn("a", F.lit(True)).hint("merge").join(post.withColumn("b", F.lit(True)), PX, "right")  # a implies b
    gt = own.hint("merge").join(flags, PX, "left").groupBy(*keys).agg(F.count("*").alias("supported"), F.count("a").alias("pre"), F.count("b").alias("post"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    # Predicted pixels of the boxes meet in cells as large as a patch.
    low = lambda c: F.greatest(F.lit(0), F.col(c) - margin)
    high = lambda c, n: F.least(F.lit(n - 1), F.col(c) + margin)
    box = gt.select(*keys, low("y0").alias("y0"), high("y1", height).alias("y1"), low("x0").alias("x0"), high("x1", width).alias("x1"))
    at = lambda c: F.floor(F.col(c) / patch)
    box = box.withColumn("cy", F.explode(F.sequence(at("y0"), at("y1")))).withColumn("cx", F.explode(F.sequence(at("x0"), at("x1"))))
    seen = P.within_support(flags, patches, patch).withColumn("cy", at("y")).withColumn("cx", at("x"))
    seen = seen.hint("merge").join(box, ["image_id", "cy", "cx"]).where("y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1").groupBy(*keys).agg(F.count("a").alias("n_pre"), F.count("b").alias("n_post"))
    j = whole.hint("merge").join(gt, keys, "left").hint("merge").join(seen, keys, "left").na.fill(0, ["supported", "n_pre", "n_post"])
    n = F.col("supported")
    share = lambda v: F.when(n > 0, v / n)
    dice = lambda c: F.when(n > 0, 2 * F.col(c) / (F.col(f"n_{c}") + n))
    added = F.col("post") - F.col("pre")
    return j.select(
        *keys, (n / F.col("pixels")).alias("support_fraction"), "supported", share(F.col("pre")).alias("recall_pre"), share(F.col("post")).alias("recall_post"), F.coalesce(added, F.lit(0)).alias("added"), share(added).alias("added_fraction"),
        dice("pre").alias("dice_pre"), dice("post").alias("dice_post"),
    )


def display_excess(frame: DataFrame, pred: DataFrame, target: DataFrame, patches: DataFrame, patch: int, near: int, far: int) -> DataFrame:
    """(image_id, y, x, category, excess, fallback): the pixels of frames (image_id, y, x, v) within the
    support of patches, by what they are (gt_trail; false positives near_gt_fp, ambiguous_fp and
    far_fp by their distance to a supported target; background), and how far their value is above the
    median of the image's background.  An image without background uses all its supported pixels that
    are no target, or all, and says so.  quota_sample draws samples from it, a count its sizes."""
    t = P.within_support(target.select(*PX).distinct(), patches, patch)
    px = P.within_support(frame.select(*PX, "v"), patches, patch)
    px = P.disc_marks(px, {"t": (t, {"_t": 0, "_near": min(near, far), "_far": far}), "p": (pred, {"_p": 0})})
    kind = F.when(F.col("_t"), "gt_trail").when(~F.col("_p"), "background").when(F.col("_near"), "near_gt_fp").when(F.col("_far"), "ambiguous_fp").otherwise("far_fp")
    px = px.select(*PX, "v", kind.alias("category"))
    median = lambda ok: F.percentile(F.when(ok, F.col("v")), 0.5, F.col("k"))
    h = px.groupBy("image_id", "category", "v").agg(F.count("*").alias("k"))  # values, not pixels
    c = F.col("category")
    m = h.groupBy("image_id").agg(median(c == "background").alias("a"), median(c != "gt_trail").alias("b"), median(F.lit(True)).alias("c"))
    m = m.select("image_id", F.coalesce("a", "b", "c").alias("_m"), F.col("a").isNull().alias("fallback"))
    return px.join(m, "image_id").select(*PX, "category", (F.col("v") - F.col("_m")).alias("excess"), "fallback")


def recovered_crop(added: DataFrame, fallback: DataFrame, images: DataFrame, height: int, width: int, margin: int) -> DataFrame:
    """Per image (of images) a crop round the most solid stretch of the pixels that lines add: rows y0 to
    y1 - 1, columns x0 to x1 - 1.

    The pixels are eroded by a 3x3 square (beyond the frame counts as set), which drops slivers along
    known streaks; where nothing is left, all added pixels count, and where there are none, those of
    `fallback`.  The box of the largest component (first in raster order) gets a margin inside the
    frame; an image without any pixel is shown as a whole, with an area of 0."""
    runs = R.merged(R.runs_of(added))
    core = R.erode(runs, R.kernel(1), height, width)
    has = lambda d, n: d.select("image_id").distinct().withColumn(n, F.lit(True))
    whole, other = runs.join(has(core, "_c"), "image_id", "left_anti"), R.merged(R.runs_of(fallback)).join(has(runs, "_r"), "image_id", "left_anti")
    seeds = core.unionByName(whole).unionByName(other)
    per = L.component_runs(seeds).groupBy("image_id", "component").agg(R.size(F.lit(True)).alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    top = per.groupBy("image_id").agg(F.max(F.struct("area", (-F.col("component")).alias("c"), "y0", "x0", "y1", "x1")).alias("b"))
    low = lambda c: F.coalesce(F.greatest(F.lit(0).cast("long"), F.col(f"b.{c}") - margin), F.lit(0).cast("long")).alias(c)
    high = lambda c, n: F.coalesce(F.least(F.lit(n).cast("long"), F.col(f"b.{c}") + margin), F.lit(n).cast("long")).alias(c)
    shown = images.select("image_id").distinct().join(top, "image_id", "left")
    return shown.select("image_id", F.coalesce("b.area", F.lit(0).cast("long")).alias("area"), low("y0"), low("x0"), high("y1", height), high("x1", width))


def strata_lines(prob: DataFrame, strata: list[float], **line) -> DataFrame:
    """Union of the lines found at each probability level, with the lowest level that found a pixel.
    Pixels are turned into lines once, for all levels."""
    own = {k: v for k, v in line.items() if k != "thetas"}
    drawn = P.drawn_runs(prob, [own | {"level": s} for s in strata], line.get("thetas", 180))
    level = F.get(F.array(*[F.lit(s) for s in strata]), F.col("case"))
    return drawn.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), level.alias("level")).groupBy(*PX).agg(F.min("level").alias("level"))


def gated_line_pass(prob: DataFrame, gates: DataFrame, gate: float, threshold: float, low: float, target: DataFrame, patch: int, **line) -> DataFrame:
    """Line accounting on the canvas of patches (image_id, cy, cx, gate) that a gate lets through."""
    cells = gates.where(F.col("gate") >= gate).select("image_id", "cy", "cx")
    kept = prob.withColumn("cy", F.floor(F.col("y") / patch)).withColumn("cx", F.floor(F.col("x") / patch)).hint("merge").join(cells, ["image_id", "cy", "cx"], "left_semi").drop("cy", "cx")
    pred = kept.where(F.col("prob") >= threshold).select(*PX)
    return P.line_accounting(pred, P.union(pred, P.complete_lines(kept.where(F.col("prob") >= low), **line)), target, patch)


def detector_grid(px: DataFrame, target: DataFrame, settings: list[dict], area: int, keep: int = 5) -> DataFrame:
    """Scores of the line detector for each of some settings (of one `thetas`), best F1 first.  Pixels are turned
    into lines once, and the runs of all settings meet those of the target in one sweep; none of the scores asks
    for the area of a frame."""
    own = [{k: v for k, v in s.items() if k != "thetas"} for s in settings]
    drawn = P.drawn_runs(px, own, settings[0].get("thetas", 180)).select(*R.RUN, F.concat(F.lit("s"), "case").alias("tag"))
    s = R.sweep(R.named({"t": R.runs_of(target)}).unionByName(drawn), ["t", *[f"s{i}" for i in range(len(own))]])
    p, t = [F.col(f"s{i}") > 0 for i in range(len(own))], F.col("t") > 0
    c = s.agg(F.array(*[F.struct(F.lit(i).alias("setting"), R.size(d & t).alias("tp"), R.size(d & ~t).alias("fp"), R.size(~d & t).alias("fn")) for i, d in enumerate(p)]).alias("c")).select(F.inline("c"))
    out = metrics(c.withColumn("tn", F.lit(0))).select("setting", "tp", "fp", "fn", "precision", "recall", "f1")
    return out.orderBy(F.desc("f1"), "setting").limit(keep)


def edge_mask(px: DataFrame, tile: int, low: float, high: float, size: tuple[int, int] | None = None) -> DataFrame:
    """Edge pixels with hysteresis: components of edges that hold a strong pixel."""
    e = P.stored(edge_pixels(px, tile, low, high, size=size), "edges")  # read twice
    named = P.components(e.select(*PX))
    strong = named.hint("merge").join(e.where("strong"), PX, "left_semi").select("image_id", "component").distinct()
    return named.hint("merge").join(strong, ["image_id", "component"], "left_semi").select(*PX)


def classical_detector(px: DataFrame, height: int, width: int, edge: tuple[float, float], clip: tuple[float, float] = (1.0, 99.5), tile: int = 256, missing: int | None = None, **line) -> DataFrame:
    """The pixels that the classical detector marks in frames (image_id, y, x, v: 0 to 255): percentile
    stretch, edges with hysteresis, straight segments.  A frame may list only some of its pixels, inside it:
    `missing` is the value of the others, which are made in arrays, tile by tile."""
    sparse = missing is not None
    s = stretch(px, *clip, levels=255, unlisted=(missing, height * width) if sparse else None)
    s = s.select(*PX, F.col("s").cast("double").alias("v"), *(["rest"] if sparse else []))
    return P.complete_lines(edge_mask(s, tile, *edge, size=(height, width) if sparse else None), height=height, width=width, **line)


def detector_scores(mask: DataFrame, target: DataFrame, area: int) -> DataFrame:
    """The eight metrics of each image, and of all together (image_id null)."""
    c = sparse_counts(mask, target, area)
    every = c.agg(*[F.sum(n).cast("long").alias(n) for n in ("tp", "fp", "tn", "fn")])
    return metrics(c.unionByName(every.withColumn("image_id", F.lit(None).cast(c.schema["image_id"].dataType))))


def thickness_recovery(precisions: DataFrame) -> DataFrame:
    """From precision before lines (thickness 0) and after lines of each thickness: the loss with the
    thickest lines and the share of it that each thinner one recovers."""
    p = precisions.agg(F.max(F.when(F.col("thickness") == 0, F.col("precision"))).alias("pre"), F.max_by("precision", "thickness").alias("thick"))
    return precisions.where("thickness > 0").join(F.broadcast(p)).select("thickness", (F.col("pre") - F.col("precision")).alias("loss"), ratio(F.col("precision") - F.col("thick"), F.col("pre") - F.col("thick")).alias("recovered"))


def merge_reviews(inference: DataFrame, reviews: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """inference with the columns of reviews; fails on a repeated, missing or unmatched review, or one
    without an answer or a reviewer."""
    one = reviews.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in (*flags, "reviewer")])
    j = inference.withColumn("_known", F.lit(True)).hint("merge").join(one, keys, "full")
    why = F.when(F.col("_known").isNull(), "review of nothing that was inferred").when(F.col("_n").isNull(), "no review").when(F.col("_n") > 1, "repeated review").when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "no reviewer")
    for f in flags:
        why = why.when(F.col(f).isNull(), f"no answer: {f}")
    return j.withColumn(flags[0], F.when(why.isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.col(flags[0]))).drop("_n", "_known")


def review_summary(reviewed: DataFrame, flags: list[str]) -> DataFrame:
    """How many rows were reviewed, and how many have each flag."""
    return reviewed.agg(F.count("*").alias("reviewed"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def decoded_params(params: DataFrame) -> DataFrame:
    """(trial_id, param_name, value as text) of stored parameters (trial_id, param_name, param_value,
    distribution_json): a place in the choices of a categorical one, else the number itself."""
    choices = F.expr("try_variant_get(try_parse_json(distribution_json), '$.attributes.choices', 'array<string>')")
    value = F.when(choices.isNull(), F.col("param_value").cast("string")).otherwise(F.get(choices, F.col("param_value").cast("int")))
    return params.select("trial_id", "param_name", value.alias("value"))


def _attributes(attributes: DataFrame) -> DataFrame:
    """(trial_id, key, value as text) of attributes stored as JSON, whatever their kinds."""
    return attributes.select("trial_id", "key", F.expr("try_variant_get(try_parse_json(value_json), '$', 'string')").alias("value"))


def top_trials(trials: DataFrame, values: DataFrame, params: DataFrame, attributes: DataFrame, k: int, needed: tuple[str, ...], either: tuple[str, ...] = ()) -> DataFrame:
    """The k complete trials (trial_id, number, state) with the best first objective (values: trial_id,
    objective, value), with their parameters as numbers, best first, equal ones by number.

    Parameters of `needed` come from params, those of `either` from a user attribute of that name, else
    from params; one that is missing, or no number, fails.  Nothing but the stored objective orders and
    limits, so only k trials meet their parameters."""
    best = trials.select("trial_id", "number", "state").where("state = 'COMPLETE'").join(values.where("objective = 0").select("trial_id", "value"), "trial_id").orderBy(F.desc("value"), "number").limit(k)
    names = [*needed, *either]
    own = lambda d, name, keep: d.join(F.broadcast(best.select("trial_id")), "trial_id", "left_semi").groupBy("trial_id").pivot(name, keep).agg(F.max("value"))
    p = own(decoded_params(params), "param_name", names).select("trial_id", *[F.col(n).alias(f"_p_{n}") for n in names])
    j = best.select("trial_id", "number", "value").join(p, "trial_id", "left")
    if either:
        a = own(_attributes(attributes), "key", list(either)).select("trial_id", *[F.col(n).alias(f"_a_{n}") for n in either])
        j = j.join(a, "trial_id", "left")
    text = lambda n: F.coalesce(f"_a_{n}", f"_p_{n}") if n in either else F.col(f"_p_{n}")
    fail = lambda n: F.raise_error(F.concat(F.lit("trial "), F.col("number").cast("string"), F.lit(f" lacks {n}"))).cast("double")
    return j.select("trial_id", "number", "value", *[F.coalesce(text(n).try_cast("double"), fail(n)).alias(n) for n in names]).orderBy(F.desc("value"), "number")


def trial_table(trials: DataFrame, values: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """All trials (trial_id, number, state) by number, with their objective (null where there is none), the
    attributes `names` as text and val_f1: the attribute of that name, else the objective."""
    a = _attributes(attributes).groupBy("trial_id").pivot("key", sorted({"val_f1", *names})).agg(F.max("value"))
    j = trials.select("trial_id", "number", "state").join(values.where("objective = 0").select("trial_id", F.col("value").alias("objective")), "trial_id", "left").join(a.withColumnRenamed("val_f1", "_f1"), "trial_id", "left")
    return j.select("trial_id", "number", "state", "objective", *[n for n in names if n != "val_f1"], F.coalesce(F.col("_f1").try_cast("double"), "objective").alias("val_f1")).orderBy("number")


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Differences b - a of two runs' values and whether all are equal, nulls alike."""
    x = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values])
    y = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values])
    j = x.join(y, keys, "full")
    same = F.lit(True)
    for v in values:
        same &= F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}"))
    return j.select(*keys, *[(F.col(f"_b_{v}") - F.col(f"_a_{v}")).alias(f"{v}_change") for v in values], same.alias("same"))


def stratified_components(comps: DataFrame, total: int, seed: int, least_images: int = 1, attempts: int = 200) -> DataFrame:
    """`total` components (image_id, component, tier), evenly from the tiers (the first ones by name give one
    more where it doesn't divide) and topped up from all others when a tier is short: of the attempts
    the first whose sample has least_images images.  Fails when none has.

    Ranks are by seeded order.  Attempts are tried a few at a time, as a column, and the order of a tier
    is cut off at `total` rows before it is sorted as a whole."""
    tiers = sorted(r.tier for r in comps.select("tier").distinct().collect())  # a handful
    if not tiers:
        return comps.select("image_id", "component", "tier")
    quota = F.create_map(*[x for i, t in enumerate(tiers) for x in (F.lit(t), F.lit(total // len(tiers) + (i < total % len(tiers))))])
    done, size = 0, 1
    while done < attempts:
        size = min(size, attempts - done)
        c = comps.select("image_id", "component", "tier", F.explode(F.sequence(F.lit(done), F.lit(done + size - 1))).alias("attempt"))
        c = c.withColumn("_d", digest(seed, F.col("attempt"), F.col("image_id"), F.col("component")))
        c = c.withColumn("_r", F.row_number().over(Window.partitionBy("attempt", "tier").orderBy("_d", "image_id", "component"))).where(F.col("_r") <= total)
        c = c.withColumn("_k", F.row_number().over(Window.partitionBy("attempt").orderBy(F.col("_r") > quota[F.col("tier")], "_d", "image_id", "component"))).where(F.col("_k") <= total)
        c = P.stored(c.select("image_id", "component", "tier", "attempt"))  # `total` rows an attempt
        first = c.groupBy("attempt").agg(F.countDistinct("image_id").alias("n")).where(F.col("n") >= least_images).agg(F.min("attempt")).first()[0]
        if first is not None:
            return c.where(F.col("attempt") == first).drop("attempt")
        done, size = done + size, 4 * size
    raise ValueError(f"no sample of {attempts} has {least_images} images")


def two_component_samples(comps: DataFrame, first: int, second: int, seed: int, **options) -> DataFrame:
    """A stratified sample and, of the rest, a plain seeded one; `sample` is 1 or 2."""
    a = stratified_components(comps, first, seed, **options)
    rest = comps.select("image_id", "component", "tier").hint("merge").join(a, ["image_id", "component"], "left_anti")
    b = rest.orderBy(digest(seed + 1, F.col("image_id"), F.col("component")), "image_id", "component").limit(second)
    return a.withColumn("sample", F.lit(1)).unionByName(b.withColumn("sample", F.lit(2)))


def component_ends(labelled: DataFrame, position: float = 0.5) -> DataFrame:
    """Per component the pixels with the smallest and the largest projection on its main axis, and the
    one nearest to the share `position` of the way between; ties go to the first in raster order."""
    keys = ["image_id", "component"]
    a = P.component_shapes(labelled).select(*keys, "angle")
    along = F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle")
    p = labelled.hint("merge").join(a, keys).withColumn("_t", F.round(along, 9))
    ends = p.groupBy(*keys).agg(F.min(F.struct("_t", "y", "x")).alias("a"), F.min(F.struct((-F.col("_t")).alias("_t"), "y", "x")).alias("b"))
    mid = F.col("a._t") + (-F.col("b._t") - F.col("a._t")) * position
    at = p.hint("merge").join(ends, keys).groupBy(*keys, "a", "b").agg(F.min(F.struct(F.round(F.abs(F.col("_t") - mid), 9).alias("d"), F.col("y"), F.col("x"))).alias("m"))
    return at.select(*keys, F.col("a.y").alias("y0"), F.col("a.x").alias("x0"), F.col("b.y").alias("y1"), F.col("b.x").alias("x1"), F.col("m.y").alias("y"), F.col("m.x").alias("x"))


def audit_crops(strata: list[tuple[str, DataFrame]], size: int, height: int, width: int, seed: int) -> DataFrame:
    """Crops (stratum, image_id, y, x points) of several strata under neutral names, in blind order, which
    takes two levels: no task orders more than a few of 4,096 parts of the points."""
    out = None
    for name, d in strata:
        one = d.select("image_id", "y", "x").withColumn("stratum", F.lit(name))
        out = one if out is None else out.unionByName(one)
    r = seeded_ranks(out.withColumn("_all", F.lit(0)), "_all", seed, "stratum", "image_id", "y", "x")
    y0, x0 = P.crop_window(F.col("y"), F.col("x"), height, width, size)
    return r.select(F.concat(F.lit("crop_"), F.lpad((F.col("_r") + 1).cast("string"), 4, "0")).alias("name"), "stratum", "image_id", y0.alias("y0"), x0.alias("x0"))


def annotation_scores(first: DataFrame, second: DataFrame, third: DataFrame, crops: DataFrame, size: int, tolerances: list[int]) -> DataFrame:
    """Tolerant scores of three mask sources against one another in crops (name, image_id, y0, x0), per
    pairing and tolerance, summed over the crops."""
    cut = {n: P.in_windows(d, crops, size).select(F.col("name").alias("image_id"), "y", "x") for n, d in (("first", first), ("second", second), ("third", third))}
    out = None
    for a, b in (("first", "second"), ("first", "third"), ("second", "third")):
        one = P.tolerant_metrics(P.tolerant_counts(cut[a], cut[b], tolerances, size, size)).withColumn("pairing", F.lit(f"{a}-{b}"))
        out = one if out is None else out.union(one)
    return out.select("pairing", "tolerance", "precision", "recall", "f1")


def audit_scores(crops: DataFrame, original: DataFrame, reference: DataFrame, model: DataFrame, size: int, tolerances: list[int], boundary: tuple[str, ...]) -> DataFrame:
    """(name, stratum, status, pairing, tolerance, ptp, fp, rtp, fn) of crops (name, stratum, image_id,
    y0, x0, verdict): tolerant counts of original and model against the reference and of the model
    against the original.

    Crops with an uncertain verdict and those of boundary strata without a reference pixel are listed
    once, with the status "uncertain" or "not_visible" and no counts; the others are "scored"."""
    cut = {n: P.in_windows(d, crops, size).select(F.col("name").alias("image_id"), "y", "x") for n, d in (("original", original), ("reference", reference), ("model", model))}
    seen = cut["reference"].select(F.col("image_id").alias("name")).distinct().withColumn("_seen", F.lit(True))
    lost = F.col("stratum").isin(*boundary) & F.col("_seen").isNull()
    status = F.when(F.col("verdict") == "uncertain", "uncertain").when(lost, "not_visible").otherwise("scored")
    c = crops.hint("merge").join(seen, "name", "left").select("name", "stratum", status.alias("status"))
    out = None
    for candidate, truth in (("original", "reference"), ("model", "reference"), ("model", "original")):
        one = P.tolerant_counts(cut[candidate], cut[truth], tolerances, size, size).withColumn("pairing", F.lit(f"{candidate}_vs_{truth}"))
        out = one if out is None else out.union(one)
    grid = F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pairing"), F.lit(t).alias("tolerance")) for a, b in (("original", "reference"), ("model", "reference"), ("model", "original")) for t in tolerances]))
    scored = c.where("status = 'scored'").select("*", grid.alias("g")).select("name", "stratum", "status", "g.*")
    scored = scored.hint("merge").join(out.withColumnRenamed("image_id", "name"), ["name", "pairing", "tolerance"], "left").na.fill(0, ["ptp", "fp", "rtp", "fn"])
    cols = ["name", "stratum", "status", "pairing", "tolerance", "ptp", "fp", "rtp", "fn"]
    return scored.select(*cols).unionByName(c.where("status <> 'scored'"), allowMissingColumns=True).select(*cols)


def audit_totals(scores: DataFrame, boundary: tuple[str, ...]) -> DataFrame:
    """Precision, recall and F1 per pairing and tolerance over the scored crops of the boundary strata."""
    s = scores.where("status = 'scored'").where(F.col("stratum").isin(*boundary))
    return P.tolerant_metrics(s, "pairing")


def crop_widths(crops: DataFrame, masks: dict[str, DataFrame], size: int) -> DataFrame:
    """(name, source, width): the median width of each mask in each crop; crops without a pixel of a mask
    have no row for it."""
    out = None
    for source, d in masks.items():
        px = P.in_windows(d, crops, size).select(F.col("name").alias("image_id"), "y", "x", F.lit(1).alias("component"))
        one = component_widths(px).select(F.col("image_id").alias("name"), F.lit(source).alias("source"), "width")
        out = one if out is None else out.union(one)
    return out


def stratum_table(scores: DataFrame, tolerances: list[int]) -> DataFrame:
    """Mean F1 per stratum and pairing, a column for each tolerance."""
    return scores.groupBy("stratum", "pairing").pivot("tolerance", tolerances).agg(F.avg("f1")).select("stratum", "pairing", *[F.col(str(t)).alias(f"f1_{t}") for t in tolerances])

