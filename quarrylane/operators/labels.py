"""Connected components and nearest pixels, tile by tile: numpy works inside tiles or rows of bounded size,
Spark joins what crosses their borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs as R
from .shared import stored

TILE = 512


def touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (sorted by y, x0, not touching within a row) of neighbouring rows that touch; reach 1 also
    counts corners."""
    span = int(x1.max(initial=0) - x0.min(initial=0)) + 4
    base = int(x0.min(initial=0)) - 2
    first, last = y * span + x0 - base, y * span + x1 - base
    low = np.searchsorted(last, first + span - reach)
    high = np.searchsorted(first, last + span + reach, side="right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n numbers is linked with, by hooking roots and halving paths."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up


def tile_runs(runs: DataFrame, tile: int) -> DataFrame:
    """Runs cut where tiles end, with their tile (ty, tx)."""
    at = lambda c: F.floor(F.col(c) / tile)
    out = runs.select(*R.RUN, at("y").alias("ty"), F.explode(F.sequence(at("x0"), at("x1"))).alias("tx"))
    return out.withColumns({"x0": F.greatest("x0", F.col("tx") * tile), "x1": F.least("x1", (F.col("tx") + 1) * tile - 1)})


def _place(y: Column, x: Column) -> Column:
    """A number for a pixel that grows in raster order."""
    return F.shiftleft(y, 32) + x + (1 << 31)


def component_runs(runs: DataFrame, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """(image_id, y, x0, x1, component): merged runs within tiles, with the connected component, numbered per
    image in raster order of their first pixels, from 1.

    Each tile labels its own runs in one task of bounded size.  Labels that meet across the border of two
    tiles are joined by alternating large and small stars on the border labels alone, of which there are
    far fewer than runs; each round is written, and only a count and a checksum come to the driver."""
    reach = 1 if connectivity == 8 else 0
    image = runs.schema["image_id"].dataType

    def label(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(i).to_numpy() for i in (1, 2, 3))
        ty, tx = table.column(4)[0].as_py(), table.column(5)[0].as_py()
        # Painting merges runs that overlap or touch.
        grid = np.zeros((tile, tile + 1), np.int32)
        np.add.at(grid, (y - ty * tile, x0 - tx * tile), 1)
        np.add.at(grid, (y - ty * tile, x1 - tx * tile + 1), -1)
        on = np.zeros((tile, tile + 2), np.int8)
        on[:, 1:-1] = np.cumsum(grid, 1)[:, :tile] > 0
        edge = np.diff(on, axis=1)
        y, x0 = np.nonzero(edge == 1)
        x1 = np.nonzero(edge == -1)[1] - 1
        root = linked(len(y), *touching(y, x0, x1, reach))
        y, x0, x1 = y + ty * tile, x0 + tx * tile, x1 + tx * tile
        place = (y << 32) + x0 + (1 << 31)
        return pa.table({"image_id": table.column(0).combine_chunks().take(pa.array(np.zeros(len(y), np.int64))), "y": y, "x0": x0, "x1": x1, "label": place[root]})

    kinds = R.run_schema(image).add("label", "long")
    local = stored(tile_runs(runs, tile).groupBy("image_id", "ty", "tx").applyInArrow(label, kinds), "tiles")
    edges = stored(_border_edges(local, reach, tile), "borders")
    roots = joined_labels(edges)
    labels = local.select("image_id", "label").distinct().hint("merge").join(roots, ["image_id", "label"], "left").withColumn("root", F.coalesce("root", "label"))
    ids = labels.where("root = label").select("image_id", "root", F.row_number().over(Window.partitionBy("image_id").orderBy("root")).alias("component"))
    ids = labels.hint("merge").join(ids, ["image_id", "root"]).select("image_id", "label", "component")
    return local.hint("merge").join(ids, ["image_id", "label"]).select(*R.RUN, "component")


def _border_edges(local: DataFrame, reach: int, tile: int) -> DataFrame:
    """(image_id, v, u): labels, v > u, of runs that touch across the border of tiles."""
    last, first = tile - 1, 0
    row = F.pmod("y", F.lit(tile))
    at = lambda c: F.floor(c / tile)
    a = local.select("image_id", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("a"))
    b = local.select("image_id", F.col("y").alias("by"), "x0", "x1", F.col("label").alias("b"))
    down = a.where(row == last).select("image_id", (F.col("y") + 1).alias("by"), "a0", "a1", "a", F.explode(F.sequence(at(F.col("a0") - reach), at(F.col("a1") + reach))).alias("tx"))
    down = down.hint("merge").join(b.where(F.pmod("by", F.lit(tile)) == first).withColumn("tx", at(F.col("x0"))), ["image_id", "by", "tx"]).where((F.col("x0") <= F.col("a1") + reach) & (F.col("a0") <= F.col("x1") + reach))
    side = a.where(F.pmod("a1", F.lit(tile)) == last).select("image_id", (F.col("a1") + 1).alias("x0"), "a", F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("by"))
    side = side.hint("merge").join(b.where(F.pmod("x0", F.lit(tile)) == first), ["image_id", "by", "x0"])
    both = down.select("image_id", "a", "b").union(side.select("image_id", "a", "b")).where("a <> b")
    return both.select("image_id", F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()


def joined_labels(edges: DataFrame) -> DataFrame:
    """(image_id, label, root) of the linked labels v, u of edges: the smallest label that each is linked with."""
    mark = None
    while not edges.isEmpty():
        both = edges.union(edges.select("image_id", F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("image_id", "v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.hint("merge").join(least, ["image_id", "v"]).where("u > v").select("image_id", F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("image_id", "v").agg(F.min("u").alias("m"))
        small = large.hint("merge").join(least, ["image_id", "v"])
        small = small.select("image_id", F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("image_id", "v", F.col("m").alias("u"))).where("u <> v").distinct()
        edges = stored(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("image_id", "v", "u").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.groupBy("image_id", F.col("v").alias("label")).agg(F.min("u").alias("root"))


#: Rows of an image that one task searches together.
BAND = 64


def row_nearest(at: np.ndarray, columns: np.ndarray, height2: np.ndarray) -> np.ndarray:
    """For each of some sorted places of a row the least of (place - column)**2 + height2 over all columns.

    The parabola that is lowest moves to the right with the place, so halves are searched in turn: the work
    grows with the columns times the logarithm of the places."""
    out = np.empty(len(at), np.int64)
    todo = [(0, len(at), 0, len(columns))]
    while todo:
        a, b, low, high = todo.pop()
        if a >= b:
            continue
        m = (a + b) // 2
        d = (columns[low:high] - at[m]) ** 2 + height2[low:high]
        j = int(d.argmin())
        out[m] = d[j]
        todo += [(a, m, low, low + j + 1), (m + 1, b, low + j, high)]
    return out


def nearest(queries: DataFrame, targets: DataFrame, band: int = BAND) -> DataFrame:
    """(image_id, y, x, d2): the squared Euclidean distance of each query pixel to the nearest target pixel of
    its image, at any distance; images without targets have no rows.

    Separable and exact: along each column every stretch of targets owns the rows that are nearest to it; a
    band of rows with queries gets what each column has for it (one stretch or a few), and each of its
    rows takes the lowest of its columns' parabolas.  Rows shuffled follow columns times bands, pixels
    are never paired."""
    q = queries.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct().withColumn("band", F.floor(F.col("y") / band))
    column = Window.partitionBy("image_id", "x").orderBy("y")
    t = targets.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    t = t.withColumn("_new", F.coalesce(F.col("y") > F.lag("y").over(column) + 1, F.lit(True)).cast("int"))
    t = t.withColumn("_n", F.sum("_new").over(column.rowsBetween(Window.unboundedPreceding, 0))).groupBy("image_id", "x", "_n").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    nth = Window.partitionBy("image_id", "x").orderBy("y0")
    between = lambda a, b: F.floor((a + b) / 2)
    t = t.select("image_id", "x", "y0", "y1", (between(F.lag("y1").over(nth), F.col("y0")) + 1).alias("from"), between(F.col("y1"), F.lead("y0").over(nth)).alias("to"))
    rows = q.groupBy("image_id").agg(F.min("band").alias("low"), F.max("band").alias("high"))
    t = t.hint("merge").join(rows, "image_id").withColumns({"from": F.greatest(F.coalesce("from", F.col("low") * band), F.col("low") * band), "to": F.least(F.coalesce("to", (F.col("high") + 1) * band - 1), (F.col("high") + 1) * band - 1)}).where("from <= to")
    t = t.withColumn("band", F.explode(F.sequence(F.floor(F.col("from") / band), F.floor(F.col("to") / band)))).hint("merge").join(q.select("image_id", "band").distinct(), ["image_id", "band"], "left_semi")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        b = (left if left.num_rows else right).column("band")[0].as_py() if left.num_rows or right.num_rows else 0
        y, x = (left.column(n).to_numpy() for n in ("y", "x"))
        out = np.zeros(len(y) if right.num_rows else 0, np.int64)
        if len(out):
            cx, y0, y1, a, z = (right.column(n).to_numpy() for n in ("x", "y0", "y1", "from", "to"))
            a, z = np.maximum(a, b * band), np.minimum(z, (b + 1) * band - 1)
            columns, k = np.unique(cx, return_inverse=True)
            n = z - a + 1
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            far = np.maximum(0, np.maximum(np.repeat(y0, n) - row, row - np.repeat(y1, n)))
            height2 = np.zeros((band, len(columns)), np.int64)
            height2[row - b * band, np.repeat(k, n)] = far * far
            order = np.lexsort((x, y))
            cut = np.flatnonzero(np.diff(y[order], prepend=y[order[0]] - 1))
            for i, j in zip(cut, [*cut[1:], len(order)]):
                out[order[i:j]] = row_nearest(x[order[i:j]], columns, height2[y[order[i]] - b * band])
        keep = left if len(out) else left.slice(0, 0)
        return keep.select(["image_id", "y", "x"]).append_column("d2", pa.array(out))

    schema = q.select("image_id", "y", "x", F.lit(0).cast("long").alias("d2")).schema
    return q.groupBy("image_id", "band").cogroup(t.groupBy("image_id", "band")).applyInArrow(search, schema)


def thinned(px: DataFrame, thin, tile: int = 256, steps: int = 32) -> DataFrame:
    """Pixels left of px (image_id, y, x) when `thin` (array of bool, sub-iterations -> array) has peeled until
    nothing changes, as on whole images.

    A peeling sub-iteration looks one pixel around, so tiles with a border of `steps` pixels from their
    neighbours do `steps` of them exactly; then borders are exchanged anew, through the pixels written.
    Rounds follow the widest part, not the length of what is thinned."""
    if steps % 2 or steps < 2:
        raise ValueError("steps must be even: two sub-iterations make a whole one")
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-steps), F.lit(0), F.lit(steps)), lambda d: F.floor((F.col(c) + d) / tile)))
    left = stored(px.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct(), "thin")
    schema = left.schema

    def peel(key: tuple, table: pa.Table) -> pa.Table:
        ty, tx = key[1].as_py(), key[2].as_py()
        y, x = (table.column(n).to_numpy() for n in ("y", "x"))
        y0, x0 = int(y.min()) - 1, int(x.min()) - 1
        grid = np.zeros((int(y.max()) - y0 + 2, int(x.max()) - x0 + 2), bool)
        grid[y - y0, x - x0] = True
        y, x = np.nonzero(thin(grid, steps))
        y, x = y + y0, x + x0
        own = (y // tile == ty) & (x // tile == tx)
        n = int(own.sum())
        return pa.table({"image_id": table.column("image_id").combine_chunks().take(pa.array(np.zeros(n, np.int64))), "y": y[own], "x": x[own]})

    count = left.count()
    while True:
        t = left.select("*", F.explode(near("y")).alias("ty"), near("x").alias("txs")).select("image_id", "y", "x", "ty", F.explode("txs").alias("tx"))
        left = stored(t.groupBy("image_id", "ty", "tx").applyInArrow(peel, schema), "thin")
        now = left.count()
        if now == count:
            return left
        count = now


def distinct_images(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x) with the keys as one image_id."""
    return px.select(F.struct(*keys).alias("image_id"), "y", "x")


def with_keys(px: DataFrame, keys: list[str]) -> DataFrame:
    return px.select(*[F.col("image_id")[k].alias(k) for k in keys], *[c for c in px.columns if c != "image_id"])
