"""Operators on sparse pixel sets (image_id, y, x): sets, morphology, tolerant scores, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labels as L
from . import runs as R
from .metrics import ratio
from .shared import stored

PX = ["image_id", "y", "x"]


def offsets(radius: int, shape: str = "square") -> list[tuple[int, int]]:
    """Offsets of a square (Chebyshev), a disc (Euclidean) or an ellipse kernel (radius 1: a plus)."""
    span = range(-radius, radius + 1)
    if shape == "square":
        return [(dy, dx) for dy in span for dx in span]
    if shape == "disc":
        return [(dy, dx) for dy in span for dx in span if dy * dy + dx * dx <= radius * radius]
    half = {dy: int(round(radius * max(0.0, 1 - (dy / radius) ** 2) ** 0.5)) if radius else 0 for dy in span}
    return [(dy, dx) for dy in span for dx in range(-half[dy], half[dy] + 1)]


def inside(px: DataFrame, height: int, width: int) -> DataFrame:
    return px.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def dilate(px: DataFrame, radius: int, height: int, width: int, shape: str = "square") -> DataFrame:
    """Pixels within the kernel of a set pixel, clipped to the frame; a run of pixels is copied once for
    each row of the kernel."""
    return R.pixels_of(R.dilate(R.runs_of(px), R.kernel(radius, shape), height, width))


def erode(px: DataFrame, radius: int, height: int, width: int, shape: str = "square", outside: bool = True) -> DataFrame:
    """Pixels whose whole kernel is set; outside the frame counts as set or not, as `outside` says."""
    return R.pixels_of(R.erode(R.merged(R.runs_of(px)), R.kernel(radius, shape), height, width, outside))


def close(px: DataFrame, radius: int, height: int, width: int, shape: str = "square") -> DataFrame:
    k = R.kernel(radius, shape)
    return R.pixels_of(R.erode(R.dilate(R.runs_of(px), k, height, width), k, height, width))


def boundary(px: DataFrame, height: int, width: int) -> DataFrame:
    """Set pixels with an unset neighbour among eight; outside the frame counts as unset."""
    return R.pixels_of(R.boundaries({"a": R.merged(R.runs_of(px))}, height, width))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PX).union(b.select(*PX)).distinct()


def recovered(lines: DataFrame, pred: DataFrame, target: DataFrame) -> DataFrame:
    """Target pixels that lines add to a prediction."""
    s = R.sweep(R.named({n: R.runs_of(d) for n, d in (("lines", lines), ("pred", pred), ("target", target))}), ["lines", "pred", "target"])
    return R.pixels_of(s.where("lines > 0 AND pred = 0 AND target > 0"))


def hits(pred: DataFrame, target: DataFrame) -> DataFrame:
    """(image_id, y, x, hit): the predicted pixels, and whether they are target pixels, from one sweep."""
    s = R.sweep(R.named({"p": R.runs_of(pred), "t": R.runs_of(target)}), ["p", "t"]).where("p > 0")
    return s.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), (F.col("t") > 0).alias("hit"))


def tolerant_counts(pred: DataFrame, target: DataFrame, tolerances: list[int], height: int, width: int) -> DataFrame:
    """Per image and tolerance: predicted pixels within the square tolerance of a target (ptp) and not
    (fp), target pixels within it of a prediction (rtp) and not (fn).

    The runs of both sides and of their dilations meet in one sweep, for all tolerances."""
    levels = sorted({0, *tolerances})
    runs = None
    for n, d in (("p", pred), ("t", target)):
        one = R.tagged(R.runs_of(d), {f"{n}{k}": R.kernel(k) for k in levels}, height, width)
        runs = one if runs is None else runs.unionByName(one)
    s = R.sweep(runs, [f"{n}{k}" for n in "pt" for k in levels])
    p, t = F.col("p0") > 0, F.col("t0") > 0
    near = lambda n, k: F.col(f"{n}{k}") > 0
    within = [F.struct(F.lit(k).alias("tolerance"), R.size(p & near("t", k)).alias("ptp"), R.size(p & ~near("t", k)).alias("fp"), R.size(t & near("p", k)).alias("rtp"), R.size(t & ~near("p", k)).alias("fn")) for k in tolerances]
    return s.groupBy("image_id").agg(F.array(*within).alias("c")).select("image_id", F.inline("c"))


def tolerant_metrics(counts: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 per tolerance (and keys) over all images."""
    c = counts.groupBy(*keys, "tolerance").agg(*[F.sum(x).alias(x) for x in ("ptp", "fp", "rtp", "fn")])
    p, r = ratio(F.col("ptp"), F.col("ptp") + F.col("fp")), ratio(F.col("rtp"), F.col("rtp") + F.col("fn"))
    return c.select(*keys, "tolerance", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def disc_marks(px: DataFrame, sets: dict[str, tuple[DataFrame, dict[str, int]]], tile: int = L.TILE) -> DataFrame:
    """Adds to px, which has no column for it yet, whether a pixel of each set lies within the Euclidean radii
    given by column name (0: at the pixel itself).

    A tile's pixels meet those of the sets that its discs reach in one task, in arrays; nothing is copied for the
    places of a disc."""
    at = lambda c, d: F.floor((F.col(c) + d) / tile)
    near, reach = None, max(r for _, radii in sets.values() for r in radii.values())
    for i, (one, radii) in enumerate(sets.values()):
        far = max(radii.values())
        one = one.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.lit(i).alias("set"), F.explode(F.sequence(at("y", -far), at("y", far))).alias("ty"), F.sequence(at("x", -far), at("x", far)).alias("txs"))
        one = one.select("image_id", "y", "x", "set", "ty", F.explode("txs").alias("tx"))
        near = one if near is None else near.unionByName(one)
    kinds = [list(radii.items()) for _, radii in sets.values()]
    own = px.withColumns({"y": F.col("y").cast("long"), "x": F.col("x").cast("long"), "ty": at("y", 0), "tx": at("x", 0)})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.drop_columns(["ty", "tx"])
        y, x = (out.column(n).to_numpy() for n in ("y", "x"))
        y0, x0 = (int(v.min(initial=0 if not len(v) else v[0])) - reach for v in (y, x))
        shape = tuple(int(v.max(initial=0 if not len(v) else v[0])) + reach + 1 - v0 for v, v0 in ((y, y0), (x, x0)))
        ry, rx, of = (right.column(n).to_numpy() for n in ("y", "x", "set"))
        ry, rx = ry - y0, rx - x0
        inside = (ry >= 0) & (ry < shape[0]) & (rx >= 0) & (rx < shape[1])
        for i, radii in enumerate(kinds):
            n = np.zeros((shape[0], shape[1] + 1), np.int32)
            n[ry[inside & (of == i)], rx[inside & (of == i)] + 1] = 1
            n = np.cumsum(n, 1, dtype=np.int32)
            for name, r in radii:
                hit = np.zeros(len(y), bool)
                for dy, dx in R.kernel(r, "disc").items():
                    row = y - y0 + dy
                    hit |= n[row, x - x0 + dx + 1] > n[row, x - x0 - dx]
                out = out.append_column(name, pa.array(hit))
        return out

    schema = T.StructType([*own.drop("ty", "tx").schema, *[T.StructField(name, T.BooleanType()) for radii in kinds for name, _ in radii]])
    return own.groupBy(*TILE).cogroup(near.groupBy(*TILE)).applyInArrow(mark, schema)


def surface_counts(pred: DataFrame, target: DataFrame, taus: list[int], height: int, width: int) -> DataFrame:
    """Per image and tau: boundary pixels of either side, and those with one of the other side within
    the Euclidean distance tau; nsd is their share, null without any boundary.

    Two sweeps over runs: one finds the boundaries, one measures them against discs round the others."""
    edge = R.boundaries({"p": R.merged(R.runs_of(pred)), "t": R.merged(R.runs_of(target))}, height, width)
    grown = None
    for n in "pt":
        one = R.tagged(edge.where(F.col("tag") == n), {n: R.POINT, **{f"{n}{k}": R.kernel(k, "disc") for k in taus}})
        grown = one if grown is None else grown.unionByName(one)
    s = R.sweep(grown, [f"{n}{k}" for n in "pt" for k in ("", *taus)])
    p, t = F.col("p") > 0, F.col("t") > 0
    within = [F.struct(F.lit(k).alias("tau"), (R.size(p & (F.col(f"t{k}") > 0)) + R.size(t & (F.col(f"p{k}") > 0))).alias("near"), (R.size(p) + R.size(t)).alias("n")) for k in taus]
    both = s.groupBy("image_id").agg(F.array(*within).alias("c")).select("image_id", F.inline("c"))
    return both.withColumn("nsd", F.when(F.col("n") > 0, F.col("near") / F.col("n")))


def surface_summary(counts: DataFrame, pred: DataFrame, target: DataFrame, images: DataFrame) -> DataFrame:
    """Per tau of surface_counts: nsd over the boundary pixels of all images and of those with targets,
    and how many images (image_id) have both sides, none, only a prediction or only a target."""
    has = lambda d, n: d.select("image_id").distinct().withColumn(n, F.lit(True))
    kind = images.select("image_id").distinct().join(has(pred, "p"), "image_id", "left").join(has(target, "t"), "image_id", "left").na.fill(False, ["p", "t"])
    p, t = F.col("p"), F.col("t")
    totals = kind.agg(F.count_if(p & t).alias("scored"), F.count_if(~p & ~t).alias("empty_both"), F.count_if(p & ~t).alias("empty_target"), F.count_if(~p & t).alias("empty_prediction"))
    over = counts.hint("merge").join(kind, "image_id").groupBy("tau").agg((F.sum("near") / F.nullif(F.sum("n"), F.lit(0))).alias("nsd_all"), (F.sum(F.when(t, F.col("near"))) / F.nullif(F.sum(F.when(t, F.col("n"))), F.lit(0))).alias("nsd_positive"))
    return over.join(F.broadcast(totals))


def distance_strata(pred: DataFrame, target: DataFrame, near: int, far: int) -> DataFrame:
    """False positives by Euclidean distance to the nearest target: near (<= near), far (> far), else
    ambiguous; in images without targets all are far."""
    discs = R.tagged(R.runs_of(target), {"t": R.POINT, "near": R.kernel(near, "disc"), "far": R.kernel(far, "disc")})
    s = R.sweep(R.named({"p": R.runs_of(pred)}).unionByName(discs), ["p", "t", "near", "far"]).where("p > 0 AND t = 0")
    stratum = F.when(F.col("near") > 0, "near").when(F.col("far") > 0, "ambiguous").otherwise("far")
    return s.groupBy("image_id", stratum.alias("stratum")).agg(R.size(F.lit(True)).alias("n"))


def fp_distances(pred: DataFrame, target: DataFrame) -> DataFrame:
    """(image_id, y, x, d2, has_target): the squared distance of each false positive to the nearest
    target pixel of its image, at any distance; null in images without targets."""
    fp = R.pixels_of(R.difference(R.runs_of(pred), R.runs_of(target)))
    return fp.hint("merge").join(L.nearest(fp, target.select(*PX).distinct()), PX, "left").withColumn("has_target", F.col("d2").isNotNull())


def fp_distance_summary(distances: DataFrame, last: int = 50) -> DataFrame:
    """Over the false positives of fp_distances: how many have a distance and how many lie in images
    without targets, the shares within 1, 2 and 3 pixels of either number (null without any), how
    many lie beyond `last` pixels, and the median from 1-pixel bins up to there."""
    known, d2 = F.col("has_target"), F.col("d2")
    n, total = F.count_if(known), F.count("*")
    within = [(k, F.count_if(known & (d2 <= k * k))) for k in (1, 2, 3)]
    null_ratio = lambda a, b: F.when(b != 0, a / b)
    c = distances.agg(n.alias("with_target"), F.count_if(~known).alias("without_target"), *[null_ratio(w, n).alias(f"within_{k}") for k, w in within], *[null_ratio(w, total).alias(f"within_{k}_of_all") for k, w in within], F.count_if(d2 > last * last).alias("overflow"))
    bins = distances.where(known & (d2 <= last * last)).groupBy(F.least(F.lit(last - 1), F.floor(F.sqrt("d2"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most `last` bins
    h = bins.withColumn("c", F.sum("n").over(upto)).withColumn("half", F.sum("n").over(Window.partitionBy()) / 2)
    median = h.where(F.col("c") >= F.col("half")).agg(F.min_by(F.col("bin") + (F.col("half") - (F.col("c") - F.col("n"))) / F.col("n"), "bin").alias("median"))
    return c.join(F.broadcast(median))


def patch_grid(images: DataFrame, patch: int, stride: int) -> DataFrame:
    """All patch corners of images (image_id, height, width): y, x and their grid places."""
    ys = F.when(F.col("height") >= patch, F.sequence(F.lit(0), (F.col("height") - patch).cast("int"), F.lit(stride)))
    xs = F.when(F.col("width") >= patch, F.sequence(F.lit(0), (F.col("width") - patch).cast("int"), F.lit(stride)))
    g = images.select("image_id", F.posexplode(ys).alias("grid_y", "y"), xs.alias("xs"))
    return g.select("image_id", "grid_y", "y", F.posexplode("xs").alias("grid_x", "x"))


def patch_statistics(images: DataFrame, px: DataFrame, patch: int, stride: int) -> DataFrame:
    """The grid with positive pixels, their fraction and is_empty, empty patches included.

    Each pixel goes to the cells that cover it, so counts shuffle, not pixels."""
    cover = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - patch) / stride) + 1), F.floor(F.col(c) / stride))
    hits = px.select("image_id", F.explode(cover("y")).alias("grid_y"), cover("x").alias("xs")).select("image_id", "grid_y", F.explode("xs").alias("grid_x"))
    n = hits.groupBy("image_id", "grid_y", "grid_x").agg(F.count("*").alias("positive_pixels"))
    g = patch_grid(images, patch, stride).hint("merge").join(n, ["image_id", "grid_y", "grid_x"], "left").na.fill(0, ["positive_pixels"])
    return g.withColumn("positive_pixel_fraction", F.col("positive_pixels") / (patch * patch)).withColumn("is_empty", F.col("positive_pixels") == 0)


def summarise_patches(stats: DataFrame, *keys: str) -> DataFrame:
    """Patches, empty ones, positive pixels and mean fraction, over all or per key."""
    return stats.groupBy(*keys).agg(F.count("*").alias("patches"), F.count_if("is_empty").alias("empty"), F.count_if("is_empty").cast("double").__truediv__(F.count("*")).alias("empty_fraction"), F.sum("positive_pixels").alias("positive_pixels"), F.avg("positive_pixel_fraction").alias("mean_fraction"))


def stitch(patches: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of patches (image_id, y0, x0, y, x, prob) on their images; the largest value wins where
    patches overlap, and what lies outside the frame goes."""
    px = patches.select("image_id", (F.col("y0") + F.col("y")).alias("y"), (F.col("x0") + F.col("x")).alias("x"), "prob")
    return inside(px, height, width).groupBy(*PX).agg(F.max("prob").alias("prob"))


def within_support(px: DataFrame, patches: DataFrame, patch: int) -> DataFrame:
    """Pixels covered by any of the patches (image_id, y0, x0), which may overlap and stand anywhere.

    Each patch goes to the cells of `patch` pixels that it touches (4 at most)."""
    at = lambda c, d: F.floor((F.col(c) + d) / patch)
    cells = patches.select("image_id", "y0", "x0").distinct().select("*", F.explode(F.sequence(at("y0", 0), at("y0", patch - 1))).alias("cy"), F.sequence(at("x0", 0), at("x0", patch - 1)).alias("cxs")).select("image_id", "y0", "x0", "cy", F.explode("cxs").alias("cx"))
    p = px.withColumn("cy", at("y", 0)).withColumn("cx", at("x", 0)).alias("p")
    c = cells.alias("c")
    y, x, y0, x0 = F.col("p.y"), F.col("p.x"), F.col("c.y0"), F.col("c.x0")
    covers = (F.col("p.image_id") == F.col("c.image_id")) & (F.col("p.cy") == F.col("c.cy")) & (F.col("p.cx") == F.col("c.cx")) & (y >= y0) & (y < y0 + patch) & (x >= x0) & (x < x0 + patch)
    return p.hint("merge").join(c, covers, "left_semi").select("p.*").drop("cy", "cx")


def cut_patches(images: DataFrame, frame: DataFrame, mask: DataFrame, patch: int, stride: int) -> DataFrame:
    """(image_id, y0, x0, pixels, mask, positive_pixels): the patches of frames as rows of bytes, row by
    row, with their mask (255 where set); ready to be written as Parquet, a row per patch.

    images (image_id, height, width), frame (image_id, y, x, v: 0 to 255), mask (image_id, y, x).  A
    pixel goes to every patch that covers it, once; pixels that the frame doesn't list are 0.  One task puts
    a patch's pixels in their places, so the cost of a pixel doesn't hang on the patch's size.  Frames in
    files are cut without single pixels by sources.png.training_patches."""
    grid = patch_grid(images, patch, stride).select("image_id", F.col("y").alias("y0"), F.col("x").alias("x0"), "grid_y", "grid_x")
    cover = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - patch) / stride) + 1), F.floor(F.col(c) / stride))
    px = frame.select(*PX, F.col("v").cast("int").alias("v"), F.lit(False).alias("m")).unionByName(mask.select(*PX, F.lit(None).cast("int").alias("v"), F.lit(True).alias("m")))
    px = px.select("*", F.explode(cover("y")).alias("grid_y"), cover("x").alias("xs")).select("image_id", "grid_y", F.explode("xs").alias("grid_x"), "y", "x", "v", "m")
    at = ((F.col("y") - F.col("grid_y") * stride) * patch + F.col("x") - F.col("grid_x") * stride).cast("int").alias("at")
    px = px.select("image_id", F.col("grid_y").cast("int").alias("grid_y"), F.col("grid_x").cast("int").alias("grid_x"), at, "v", "m")

    def put(table: pa.Table) -> pa.Table:
        at, m = table.column("at").to_numpy(), table.column("m").to_numpy(zero_copy_only=False)
        pixels, shown = np.zeros(patch * patch, np.uint8), np.zeros(patch * patch, np.uint8)
        pixels[at[~m]] = table.column("v").filter(pc.invert(table.column("m"))).to_numpy()
        shown[at[m]] = 255
        one = table.select(["image_id", "grid_y", "grid_x"]).slice(0, 1)
        return one.append_column("pixels", pa.array([pixels.tobytes()])).append_column("mask", pa.array([shown.tobytes()])).append_column("positive_pixels", pa.array([np.count_nonzero(shown)]))

    schema = px.select("image_id", "grid_y", "grid_x", F.lit(b"").alias("pixels"), F.lit(b"").alias("mask"), F.lit(0).cast("long").alias("positive_pixels")).schema
    out = grid.hint("merge").join(px.groupBy("image_id", "grid_y", "grid_x").applyInArrow(put, schema), ["image_id", "grid_y", "grid_x"], "left").na.fill(0, ["positive_pixels"])
    empty = F.unhex(F.repeat(F.lit("00"), patch * patch))
    return out.select("image_id", "y0", "x0", F.coalesce("pixels", empty).alias("pixels"), F.coalesce("mask", empty).alias("mask"), "positive_pixels")


def density_map(stats: DataFrame, columns: int) -> DataFrame:
    """The positive fractions of patch_statistics of an image or more as a grid: a row per image_id and
    grid_y, a column per grid_x from 0 to columns - 1."""
    return stats.groupBy("image_id", "grid_y").pivot("grid_x", list(range(columns))).agg(F.first("positive_pixel_fraction"))


def in_windows(px: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Pixels in the windows (name, image_id, y0, x0) of `size`, in window coordinates.

    Each window goes to the cells of `size` that it touches (4 at most); the rest is an equi-join."""
    at = lambda c, d: F.floor((F.col(c) + d) / size)
    w = windows.select("name", "image_id", "y0", "x0", F.explode(F.sequence(at("y0", 0), at("y0", size - 1))).alias("cy"), F.sequence(at("x0", 0), at("x0", size - 1)).alias("cxs")).select("*", F.explode("cxs").alias("cx")).drop("cxs")
    p = px.select(*PX, at("y", 0).alias("cy"), at("x", 0).alias("cx")).hint("merge").join(w, ["image_id", "cy", "cx"])
    dy, dx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    return p.where((dy >= 0) & (dy < size) & (dx >= 0) & (dx < size)).select("name", "image_id", dy.alias("y"), dx.alias("x"))


def crop_window(y: Column, x: Column, height: int, width: int, size: int) -> tuple[Column, Column]:
    """Corner of the window of `size` centred on a point and kept inside the frame (half-even rounding)."""
    if size > min(height, width):
        raise ValueError("the frame is smaller than the window")
    held = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - size), F.bround(c - size / 2).cast("int")))
    return held(y, height), held(x, width)


def soft_target(px: DataFrame, radius: int, band: float, height: int, width: int, train: DataFrame | None = None) -> DataFrame:
    """1 on set pixels, `band` within the square radius; other pixels (0) are not listed.  With train
    (image_id) only those images get a band."""
    wide = px if train is None else px.join(train.select("image_id").distinct(), "image_id", "left_semi")
    grown = dilate(wide, radius, height, width)
    if train is not None:
        grown = union(grown, px)
    grown = grown.hint("merge").join(px.select(*PX).distinct().withColumn("_core", F.lit(1.0)), PX, "left")
    return grown.select(*PX, F.coalesce("_core", F.lit(band)).alias("value"))


def label_sweep(pred: DataFrame, target: DataFrame, radii: list[int], height: int, width: int) -> DataFrame:
    """Precision, recall and Dice with the target grown (radius > 0) or shrunk by an ellipse kernel, all
    radii in one sweep."""
    kernels = {f"t{r}": R.kernel(r, "ellipse") for r in radii if r >= 0}
    target = R.merged(R.runs_of(target))  # whole runs are grown, not pixels
    runs = R.named({"p": R.runs_of(pred)})
    runs = runs.unionByName(R.tagged(target, kernels, height, width)) if kernels else runs
    for r in radii:
        if r < 0:
            runs = runs.unionByName(R.shrunk(target, f"t{r}", R.kernel(-r, "ellipse"), height, width, True))
    s = R.sweep(runs, ["p", *[f"t{r}" for r in radii]])
    p = F.col("p") > 0
    least = lambda r: R.kernel_rows(R.kernel(-r, "ellipse"), height, True) if r < 0 else F.lit(1)
    t = {r: F.col(f"t{r}") >= least(r) for r in radii}
    c = s.agg(F.array(*[F.struct(F.lit(r).alias("radius"), R.size(p & t[r]).alias("tp"), R.size(p).alias("np"), R.size(t[r]).alias("nt")) for r in radii]).alias("c")).select(F.inline("c"))
    tp, np_, nt = F.col("tp"), F.col("np"), F.col("nt")
    return c.select("radius", ratio(tp, np_).alias("precision"), ratio(tp, nt).alias("recall"), ratio(2 * tp, np_ + nt).alias("dice"))


def components(px: DataFrame, connectivity: int = 8, tile: int = L.TILE) -> DataFrame:
    """(image_id, y, x, component): connected components numbered per image in raster order of their
    first pixels, from 1."""
    named = L.component_runs(R.runs_of(px), connectivity, tile)
    return named.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component")


def component_shapes(labelled: DataFrame, least_area: int = 1) -> DataFrame:
    """Per component: area, box, axes (4 times the root of the covariance's eigenvalues), angle of the
    main axis and the length of the projection on it."""
    g = labelled.groupBy("image_id", "component").agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("vy"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("vx"), F.coalesce(F.covar_samp("y", "x"), F.lit(0.0)).alias("c"),
    ).where(F.col("area") >= least_area)
    half, root = (F.col("vy") + F.col("vx")) / 2, F.sqrt(((F.col("vy") - F.col("vx")) / 2) ** 2 + F.col("c") ** 2)
    g = g.select("*", (4 * F.sqrt(half + root)).alias("major"), (4 * F.sqrt(F.greatest(F.lit(0.0), half - root))).alias("minor"), (F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2).alias("angle"))
    along = F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle")
    spans = labelled.hint("merge").join(g.select("image_id", "component", "angle"), ["image_id", "component"]).groupBy("image_id", "component").agg((F.max(along) - F.min(along)).alias("length"))
    return g.hint("merge").join(spans, ["image_id", "component"]).select("image_id", "component", "area", "y0", "x0", "y1", "x1", "major", "minor", "angle", "length")


def cleaned_components(px: DataFrame, radius: int, height: int, width: int, least_area: int, least_length: float) -> DataFrame:
    """Components of the closed mask, with their original pixels, of at least the area and length."""
    named = components(close(px, radius, height, width)).hint("merge").join(px.select(*PX).distinct(), PX, "left_semi")
    kept = component_shapes(named, least_area).where(F.col("length") >= least_length).select("image_id", "component")
    return named.hint("merge").join(kept, ["image_id", "component"], "left_semi").select("image_id", "y", "x", "component")


#: Side of the tiles in which pixels vote for lines and are put on them.
LINE_TILE = 512
TILE = ["image_id", "ty", "tx"]


def _angles(px: DataFrame, thetas: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of all angles, as Spark works them out."""
    rad = F.radians(F.col("id") * (180 / thetas))
    rows = px.sparkSession.range(thetas).select("id", F.cos(rad).alias("c"), F.sin(rad).alias("s")).orderBy("id").collect()
    return np.array([r.c for r in rows]), np.array([r.s for r in rows])


def _tiled(px: DataFrame, extra: list[str]) -> DataFrame:
    """Pixels with their tile (ty, tx) and whether their image has no other (whole)."""
    at = lambda c: F.floor(F.col(c) / LINE_TILE).alias(f"t{c}")
    t = px.where("y IS NOT NULL AND x IS NOT NULL").select("image_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), *extra, at("y"), at("x"))
    one = t.groupBy("image_id").agg(((F.min("ty") == F.max("ty")) & (F.min("tx") == F.max("tx"))).alias("whole"))
    return t.hint("merge").join(one, "image_id")


def _counted_lines(tiled: DataFrame, least_votes: int, thetas: int, levels: list[float] | None = None) -> DataFrame:
    """(image_id, theta, rho, v0, v1, ...): lines that have least_votes, at any level of the column prob where
    levels are given, with their votes at each.

    A tile's pixels vote in arrays, so a pixel never becomes a row for each angle.  An image of one tile
    gives away only the lines with enough votes; the tiles of larger ones add up theirs first."""
    cos, sin = _angles(tiled, thetas)
    names = [f"v{i}" for i in range(len(levels or [0]))]

    def count(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        least = least_votes if table.column("whole")[0].as_py() else 1
        on = [table.column("prob").to_numpy() >= s for s in levels] if levels else [slice(None)]
        out = []
        for theta in range(thetas):
            rho = np.rint(x * cos[theta] + y * sin[theta]).astype(np.int64)
            low, span = rho.min(), int(np.ptp(rho)) + 1
            n = np.stack([np.bincount(rho[i] - low, minlength=span) for i in on])
            hit = np.flatnonzero(n.max(0) >= least)
            out.append((np.full(len(hit), theta, np.int32), (hit + low).astype(np.int32), n[:, hit]))
        theta, rho = (np.concatenate([o[i] for o in out]) for i in range(2))
        n = np.concatenate([o[2] for o in out], 1)
        image = table.column("image_id").combine_chunks().take(pa.array(np.zeros(len(theta), np.int64)))
        return pa.table({"image_id": image, "theta": theta, "rho": rho, **dict(zip(names, n))})

    schema = T.StructType([T.StructField("image_id", tiled.schema["image_id"].dataType), T.StructField("theta", T.IntegerType()), T.StructField("rho", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]])
    votes = tiled.groupBy(*TILE).applyInArrow(count, schema).groupBy("image_id", "theta", "rho").agg(*[F.sum(n).alias(n) for n in names])
    return votes.where(F.array_max(F.array(*names)) >= least_votes)


def line_votes(px: DataFrame, least_votes: int, thetas: int = 180) -> DataFrame:
    """Standard Hough votes: (image_id, theta, rho, votes) of at least least_votes, in steps of a degree
    and a pixel."""
    return _counted_lines(_tiled(px, []), least_votes, thetas).select("image_id", "theta", "rho", F.col("v0").alias("votes"))


def line_runs(px: DataFrame, least_votes: int, max_gap: int, thetas: int = 180, levels: list[float] | None = None) -> DataFrame:
    """(image_id, theta, rho, votes, a, b[, level]): the stretches a to b, along the lines with least_votes, of
    pixels with gaps of at most max_gap between them, within a tile; draw_segments joins them.

    Pixels meet the lines of their image tile by tile, so what is shuffled are stretches, not a row for
    each pixel and line.  With levels (of px's column prob) a stretch belongs to one level: its line has the
    votes there, and so have its pixels."""
    cos, sin = _angles(px, thetas)
    tiled = stored(_tiled(px, ["prob"] if levels else []), "tiled")
    names = [f"v{i}" for i in range(len(levels or [0]))]
    lines = stored(_counted_lines(tiled, least_votes, thetas, levels), "lines")
    own = lines.hint("merge").join(tiled.select("image_id", F.col("ty").alias("ty"), F.col("tx").alias("tx")).distinct(), "image_id")
    kinds = [("theta", T.IntegerType()), ("rho", T.IntegerType()), ("votes", T.LongType()), ("a", T.LongType()), ("b", T.LongType()), ("level", T.DoubleType())]
    schema = T.StructType([T.StructField("image_id", px.schema["image_id"].dataType), *[T.StructField(n, t) for n, t in kinds]])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 4]  # line, level, a, b
        if left.num_rows and right.num_rows:
            right = right.sort_by([("theta", "ascending"), ("rho", "ascending")])
            theta, rho = (right.column(n).to_numpy() for n in ("theta", "rho"))
            y, x = left.column("y").to_numpy(), left.column("x").to_numpy()
            first = np.flatnonzero(np.diff(theta, prepend=-1))
            for i, j in zip(first, [*first[1:], len(theta)]):
                c, s = cos[theta[i]], sin[theta[i]]
                r = np.rint(x * c + y * s).astype(np.int64)
                line = np.minimum(np.searchsorted(rho[i:j], r), j - i - 1) + i
                on = rho[line] == r
                t = np.rint(-x * s + y * c).astype(np.int64)
                for k, name in enumerate(names):
                    kept = on & (right.column(name).to_numpy()[line] >= least_votes)
                    if levels:
                        kept &= left.column("prob").to_numpy() >= levels[k]
                    if not kept.any():
                        continue
                    at, n = t[kept], line[kept]
                    order = np.lexsort((at, n))
                    at, n = at[order], n[order]
                    new = np.flatnonzero((np.diff(n, prepend=-1) > 0) | (np.diff(at, prepend=at[0]) > max_gap + 1))
                    out.append([n[new], np.full(len(new), k), at[new], at[np.append(new[1:], len(at)) - 1]])
        n, k, a, b = (np.concatenate([o[i] for o in out]) for i in range(4))
        level = np.array(levels or [np.nan])[k]
        where = right.take(pa.array(n))
        votes = np.stack([right.column(m).to_numpy() for m in names])[k, n]
        return pa.table({"image_id": where.column("image_id"), "theta": where.column("theta"), "rho": where.column("rho"), "votes": votes, "a": a, "b": b, "level": level})

    runs = tiled.drop("whole").groupBy(*TILE).cogroup(own.groupBy(*TILE)).applyInArrow(place, schema)
    return runs if levels else runs.drop("level")


def line_points(px: DataFrame, least_votes: int, thetas: int = 180, levels: list[float] | None = None) -> DataFrame:
    """(image_id, theta, rho, t[, prob, votes]): the pixels of px on lines with least_votes or more, at
    their place t along the line.  Only the angles of an image's kept lines are tried the second time.

    With levels (of px's column prob), votes are counted for every level at once and a line is kept
    when any level votes for it; `votes` holds the counts in the order of the levels."""
    rad = F.radians(F.col("theta") * (180 / thetas))
    rho = F.rint(F.col("x") * F.cos(rad) + F.col("y") * F.sin(rad)).cast("int").alias("rho")
    extra = ["prob"] if levels else []
    lines = _counted_lines(_tiled(px, extra), least_votes, thetas, levels)
    lines = lines.select("image_id", "theta", "rho", (F.array(*[f"v{i}" for i in range(len(levels))]) if levels else F.col("v0")).alias("votes"))
    lines = stored(lines)
    angles = lines.groupBy("image_id").agg(F.collect_set("theta").alias("thetas"))  # at most `thetas` each
    on = px.join(angles, "image_id").select(*PX, *extra, F.explode("thetas").alias("theta")).select("*", rho).hint("merge").join(lines, ["image_id", "theta", "rho"])
    return on.select("image_id", "theta", "rho", F.rint(-F.col("x") * F.sin(rad) + F.col("y") * F.cos(rad)).cast("int").alias("t"), *extra, "votes")


def draw_segments(points: DataFrame, max_gap: int, least_length: int, height: int, width: int, thickness: int = 1, thetas: int = 180, by: tuple[str, ...] = ()) -> DataFrame:
    """The pixels of the segments of line_runs or line_points, per value of the columns `by`: a gap of more
    than max_gap (not under that of the runs) splits a line; segments of at least least_length are drawn,
    `thickness` wide (square)."""
    rad = F.radians(F.col("theta") * (180 / thetas))
    keys = [*by, "image_id", "theta", "rho"]
    ends = ["a", "b"] if "a" in points.columns else ["t", "t"]
    on = points.select(*keys, *[F.col(c).alias(n) for c, n in zip(ends, "ab")])
    # Lines beside one another cover the same pixels, so they are drawn in the same task: most repeats end there.
    near = ["image_id", "_theta", "_rho"]
    on = on.withColumns({"_theta": F.floor(F.col("theta") * 6 / thetas), "_rho": F.floor(F.col("rho") / 256)}).repartition(*near)
    line = Window.partitionBy(*near, *[k for k in keys if k not in near]).orderBy("a", "b")
    on = on.withColumn("new", (F.col("a") - F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1)) > max_gap + 1).cast("int"))
    on = on.withColumn("segment", F.sum(F.coalesce("new", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    seg = on.groupBy(*near, *[k for k in keys if k not in near], "segment").agg(F.min("a").alias("a"), F.max("b").alias("b")).where(F.col("b") - F.col("a") >= least_length)
    drawn = seg.select(*keys, F.explode(F.sequence("a", "b")).alias("t"))
    drawn = drawn.select(*by, "image_id", F.rint(F.col("rho") * F.sin(rad) + F.col("t") * F.cos(rad)).cast("long").alias("y"), F.rint(F.col("rho") * F.cos(rad) - F.col("t") * F.sin(rad)).cast("long").alias("x")).distinct()
    if thickness > 1:
        side = range(-((thickness - 1) // 2), thickness // 2 + 1)
        at = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in side for b in side]))
        drawn = drawn.select("*", at.alias("s")).select(*by, "image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    return inside(drawn, height, width)


#: Pixels of whole images that one task draws lines for: their rows are few for the work in them.
DRAWN_ROWS = 50_000


def _image_lines(table: pa.Table, cases: list[dict], cos: np.ndarray, sin: np.ndarray) -> pa.Table:
    """drawn_runs of one image that has one tile: all arrays are as large as a tile at most."""
    y, x = (table.column(n).to_numpy() for n in ("y", "x"))
    edge = max(c.get("thickness", 1) for c in cases) + 2
    y0, x0 = int(np.floor(y.min())) - edge, int(np.floor(x.min())) - edge
    seen = np.zeros((len(cases), int(np.ceil(y.max())) + edge + 1 - y0, int(np.ceil(x.max())) + edge + 1 - x0), bool)
    by_level: dict = {}
    for k, case in enumerate(cases):
        by_level.setdefault(case.get("level"), []).append(k)
    on = {s: slice(None) if s is None else np.flatnonzero(table.column("prob").to_numpy() >= s) for s in by_level}
    for c, s in zip(cos, sin):
        rho, t = np.rint(x * c + y * s).astype(np.int64), np.rint(-x * s + y * c).astype(np.int64)
        r0, t0 = rho.min(), t.min()
        rho, t = rho - r0, t - t0
        h, w = int(rho.max()) + 1, int(t.max()) + 1
        for level, of in by_level.items():
            r = rho[on[level]]
            votes = np.bincount(r, minlength=h)
            line = votes >= min(cases[k]["least_votes"] for k in of)
            kept = line[r]
            grid = np.zeros(h * w, bool)
            grid[r[kept] * w + t[on[level]][kept]] = True
            all_ = np.flatnonzero(grid)
            for k in of:
                p = all_[(votes >= cases[k]["least_votes"])[all_ // w]]
                if not len(p):
                    continue
                n = p // w
                new = np.flatnonzero((np.diff(n, prepend=-1) > 0) | (np.diff(p, prepend=p[0]) > cases[k]["max_gap"] + 1))
                a, b = p[new], p[np.append(new[1:], len(p)) - 1]
                long = b - a >= cases[k]["least_length"]
                step = np.zeros(h * w + 1, np.int8)
                step[a[long]] += 1
                step[b[long] + 1] -= 1
                at_r, at_t = np.divmod(np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8)), w)
                at_r, at_t = at_r + r0, at_t + t0
                seen[k, np.rint(at_r * s + at_t * c).astype(np.int64) - y0, np.rint(at_r * c - at_t * s).astype(np.int64) - x0] = True
    out = []
    for k, case in enumerate(cases):
        mask, thick = seen[k], case.get("thickness", 1)
        side = range(-((thick - 1) // 2), thick // 2 + 1)
        for axis in (0, 1):  # nothing set comes round the border of `edge` pixels
            mask = np.logical_or.reduce([np.roll(mask, d, axis) for d in side])
        mask = mask[max(0, -y0) : max(0, case["height"] - y0), max(0, -x0) : max(0, case["width"] - x0)]
        d = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(d == 1)
        out.append((np.full(len(row), k, np.int32), row + max(0, y0), first + max(0, x0), np.nonzero(d == -1)[1] - 1 + max(0, x0)))
    k, row, first, last = (np.concatenate([o[i] for o in out]) for i in range(4))
    image = table.column("image_id").combine_chunks().take(pa.array(np.zeros(len(k), np.int64)))
    return pa.table({"image_id": image, "y": row, "x0": first, "x1": last, "case": k})


def drawn_runs(px: DataFrame, cases: list[dict], thetas: int = 180) -> DataFrame:
    """(image_id, y, x0, x1, case): runs of the pixels of the segments found in each of some cases (by number),
    as complete_lines has them.  A case may have a `level` of px's column prob, for all or for none.

    An image of one tile votes, is cut into segments and is drawn in one task, for all cases, and only what is
    drawn leaves it.  The stretches of larger images are joined by draw_segments."""
    levels = sorted({c["level"] for c in cases}) if cases[0].get("level") is not None else None
    cos, sin = _angles(px, thetas)
    extra = ["prob"] if levels else []
    tiled = stored(_tiled(px, extra), "tiled")
    schema = R.run_schema(px.schema["image_id"].dataType).add("case", T.IntegerType())
    parts = max(1, -(-tiled.count() // DRAWN_ROWS))
    out = tiled.where("whole").repartition(parts, *TILE).groupBy(*TILE).applyInArrow(lambda table: _image_lines(table, cases, cos, sin), schema)
    rest = tiled.where("NOT whole").select(*PX, *extra)
    if rest.isEmpty():
        return out
    points = stored(line_runs(rest, min(c["least_votes"] for c in cases), min(c["max_gap"] for c in cases), thetas, levels))
    for k, c in enumerate(cases):
        own = points.where(F.col("votes") >= c["least_votes"])
        own = own.where(F.col("level") == c["level"]) if levels else own
        drawn = draw_segments(own, thetas=thetas, **{n: v for n, v in c.items() if n not in ("least_votes", "level")})
        out = out.unionByName(drawn.select("image_id", "y", F.col("x").alias("x0"), F.col("x").alias("x1"), F.lit(k).alias("case")))
    return out


def complete_lines(px: DataFrame, least_votes: int, max_gap: int, least_length: int, height: int, width: int, thickness: int = 1, thetas: int = 180) -> DataFrame:
    """Pixels of the straight segments found in px: a deterministic standard Hough transform.

    The pixels of each line with enough votes are ordered along it; a gap of more than max_gap splits
    it; segments of at least least_length are drawn, `thickness` wide (square)."""
    case = {"least_votes": least_votes, "max_gap": max_gap, "least_length": least_length, "height": height, "width": width, "thickness": thickness}
    return R.pixels_of(drawn_runs(px, [case], thetas))


def image_accounting(pred: DataFrame, post: DataFrame, target: DataFrame, patch: int) -> DataFrame:
    """Per image, before (pre) and after (post) line completion: target pixels, predicted ones, hits,
    false positives and those added, positive patches and missed ones, whether the image is positive
    and detected (a prediction must meet a target), and precision (null without predictions).

    One sweep over the runs of all three sets; stretches are cut where patches end."""
    sets = ["pre", "post", "gt"]
    f = R.sweep(R.named({n: R.runs_of(d) for n, d in zip(sets, (pred, post, target))}), sets)
    cell = lambda c: F.floor(F.col(c) / patch)
    f = f.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumns({"x0": F.greatest("x0", F.col("cx") * patch), "x1": F.least("x1", (F.col("cx") + 1) * patch - 1)})
    on = lambda *names: R.size(F.forall(F.array(*[F.col(n) for n in names]), lambda k: k > 0))
    per = f.groupBy("image_id", cell("y").alias("cy"), "cx").agg(on("gt").alias("gt"), *[on(c, "gt").alias(f"tp_{c}") for c in ("pre", "post")], *[on(c).alias(f"n_{c}") for c in ("pre", "post")])
    hit = lambda c: F.sum(F.when((F.col("gt") > 0) & (F.col(f"tp_{c}") == 0), 1).otherwise(0)).alias(f"missed_{c}")
    im = per.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("gt", "tp_pre", "tp_post", "n_pre", "n_post")], F.count_if(F.col("gt") > 0).alias("patches"), hit("pre"), hit("post"))
    fp = {c: F.col(f"n_{c}") - F.col(f"tp_{c}") for c in ("pre", "post")}
    im = im.withColumns({"is_positive": F.col("gt") > 0, **{f"detected_{c}": F.col(f"tp_{c}") > 0 for c in fp}, **{f"fp_{c}": v for c, v in fp.items()}, "fp_added": fp["post"] - fp["pre"]})
    return im.withColumns({f"precision_{c}": F.when(F.col(f"n_{c}") != 0, F.col(f"tp_{c}") / F.col(f"n_{c}")) for c in fp})


def line_accounting(pred: DataFrame, post: DataFrame, target: DataFrame, patch: int) -> DataFrame:
    """Before and after line completion: missed images and patches, recall over positive images,
    precision over all images, false positives added.  Ratios without a denominator are null."""
    im = image_accounting(pred, post, target, patch)
    pos = F.col("is_positive")
    null_ratio = lambda a, b: F.when(b != 0, a / b)
    s = lambda c: F.sum(F.when(pos, F.col(c)))
    out = [F.count_if(pos).alias("positive_images"), F.sum("patches").alias("positive_patches"), F.sum("fp_added").alias("fp_added")]
    for c in ("pre", "post"):
        out += [
            null_ratio(F.count_if(pos & ~F.col(f"detected_{c}")), F.count_if(pos)).alias(f"image_fnr_{c}"), null_ratio(F.sum(f"missed_{c}"), F.sum("patches")).alias(f"patch_fnr_{c}"),
            null_ratio(s(f"tp_{c}"), s("gt")).alias(f"recall_{c}"), null_ratio(F.sum(f"tp_{c}"), F.sum(f"n_{c}")).alias(f"precision_{c}"),
        ]
    return im.agg(*out)
