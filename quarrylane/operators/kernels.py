"""Small numpy helpers for what SQL can't express: skeletons, widths, the edge detector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as L
from . import runs as R
from .metrics import ratio


def skeleton(g: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Thinning of Zhang and Suen: two passes that peel edge pixels until none changes, or so many passes."""
    g = np.pad(g.astype(bool), 1)
    done = 0
    while True:
        gone = False
        for step in (0, 1):
            n, ne, e, se, s, sw, w, nw = (np.roll(g, d, (0, 1)) for d in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)))
            ring = [n, ne, e, se, s, sw, w, nw, n]
            around = sum(x.astype(np.int8) for x in ring[:8])
            turns = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:]))
            sides = (~(n & e & s) & ~(e & s & w)) if step == 0 else (~(n & e & w) & ~(n & s & w))
            peel = g & (around >= 2) & (around <= 6) & (turns == 1) & sides
            gone |= bool(peel.any())
            g = g & ~peel
        done += 2
        if not gone or done == steps:
            return g[1:-1, 1:-1]


def skeletons(px: DataFrame, keys: list[str], tile: int = 256, steps: int = 32) -> DataFrame:
    """The skeleton pixels of each group of pixels (keys, y, x); a group is a patch, a component or an image
    of any size."""
    return L.with_keys(L.thinned(L.distinct_images(px, keys), skeleton, tile, steps), keys)


def centreline_dice(pred: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Per patch: the harmonic mean of the share of the prediction's skeleton within the target and the
    other way round; 0 where one side is empty.  Patches with both sides empty are not listed (1)."""
    at = [*keys, "y", "x"]
    part = lambda a, b, n: skeletons(a, keys).hint("merge").join(b.select(*at).distinct().withColumn("hit", F.lit(1)), at, "left").groupBy(*keys).agg((F.count("hit") / F.count("*")).alias(n))
    both = part(pred, target, "p").hint("merge").join(part(target, pred, "r"), keys, "full").na.fill(0.0, ["p", "r"])
    return both.select(*keys, ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")).alias("centreline_dice"))


def component_widths(labelled: DataFrame, tile: int = 256, steps: int = 32) -> DataFrame:
    """Per component twice the median distance of its skeleton to the nearest pixel outside it, for
    components of any size; what is beyond the frame counts as outside."""
    keys = ["image_id", "component"]
    px = L.distinct_images(labelled, keys)
    # The nearest pixel outside is next to the component, by a side.
    ring = R.sweep(R.tagged(R.runs_of(px), {"own": R.POINT, "grown": R.kernel(1, "ellipse")}), ["own", "grown"]).where("own = 0")
    d = L.nearest(L.thinned(px, skeleton, tile, steps), R.pixels_of(ring))
    return L.with_keys(d, keys).groupBy(*keys).agg((2 * F.percentile(F.sqrt("d2"), 0.5)).alias("width"))


def mean_centreline_dice(scores: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over the patches (keys) with targets; one without any score counts as 0."""
    t = target.select(*keys).distinct().hint("merge").join(scores, keys, "left")
    return t.agg(F.count("*").alias("patches"), F.avg(F.coalesce("centreline_dice", F.lit(0.0))).alias("centreline_dice"))


def edges(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """0, 1 (weak) or 2 (strong) for each pixel: 5x5 Gaussian, Sobel, thinning across the gradient."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(v.astype(float), 2, mode="edge")
    p = sum(k[i] * p[i : i + v.shape[0]] for i in range(5))
    p = sum(k[i] * p[:, i : i + v.shape[1]] for i in range(5))
    q = np.pad(p, 1, mode="edge")
    dx = (q[:-2, 2:] + 2 * q[1:-1, 2:] + q[2:, 2:]) - (q[:-2, :-2] + 2 * q[1:-1, :-2] + q[2:, :-2])
    dy = (q[2:, :-2] + 2 * q[2:, 1:-1] + q[2:, 2:]) - (q[:-2, :-2] + 2 * q[:-2, 1:-1] + q[:-2, 2:])
    m = np.hypot(dx, dy)
    sector = np.round(np.arctan2(dy, dx) / (np.pi / 4)).astype(int) % 4
    r = np.pad(m, 1)
    at = lambda a, b: r[1 + a : r.shape[0] - 1 + a, 1 + b : r.shape[1] - 1 + b]
    ahead = np.choose(sector, [at(0, 1), at(1, 1), at(1, 0), at(1, -1)])
    behind = np.choose(sector, [at(0, -1), at(-1, -1), at(-1, 0), at(-1, 1)])
    top = (m >= ahead) & (m > behind)
    return np.where(top & (m >= high), 2, np.where(top & (m >= low), 1, 0)).astype(np.int8)


def edge_pixels(px: DataFrame, tile: int, low: float, high: float, halo: int = 4, size: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, y, x, strong) of edge pixels of frames (image_id, y, x, v).

    Tiles get a halo wider than the filters reach, so a tile's own pixels come out as in the frame.  Frames
    are dense, or of the `size` (height, width) given, with the pixels that aren't listed at the value in the
    column `rest` (one for an image); there is no edge where none is listed."""
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda d: F.floor((F.col(c) + d) / tile)))
    t = px.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"), *(["rest"] if size else []))
    t = t.withColumn("ty", F.explode(near("y"))).withColumn("txs", near("x")).withColumn("tx", F.explode("txs")).drop("txs")
    if size:  # beyond the frame there is nothing to find
        t = t.where((F.col("ty") >= 0) & (F.col("ty") * tile < size[0]) & (F.col("tx") >= 0) & (F.col("tx") * tile < size[1]))

    def find(table: pa.Table) -> pa.Table:
        y, x = (table.column(n).to_numpy() for n in ("y", "x"))
        ty, tx = (table.column(n)[0].as_py() for n in ("ty", "tx"))
        if size:
            (y0, y1), (x0, x1) = ((max(0, i * tile - halo), min(n, (i + 1) * tile + halo)) for i, n in ((ty, size[0]), (tx, size[1])))
        else:
            y0, y1, x0, x1 = y.min(), y.max() + 1, x.min(), x.max() + 1
        g = np.full((y1 - y0, x1 - x0), float(table.column("rest")[0].as_py()) if size else 0.0)
        g[y - y0, x - x0] = table.column("v").to_numpy()
        e = edges(g, low, high)
        y, x = np.nonzero(e)
        s = e[y, x] == 2
        y, x = y + y0, x + x0
        own = (y // tile == ty) & (x // tile == tx)
        image = table.column("image_id").combine_chunks().take(pa.array(np.zeros(int(own.sum()), np.int64)))
        return pa.table({"image_id": image, "y": y[own], "x": x[own], "strong": s[own]})

    schema = t.select("image_id", "y", "x", F.lit(True).alias("strong")).schema
    return t.groupBy("image_id", "ty", "tx").applyInArrow(find, schema)
