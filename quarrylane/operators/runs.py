"""Masks as runs: rows (image_id, y, x0, x1) of set pixels from x0 to x1, both included.

Sets of runs are combined by sweeping: where a run begins counts 1, where it ends -1, and the running
sums along a row of an image say how many runs of each set lie over each stretch.  One shuffle by
(image_id, y) serves any number of sets, and dilation copies a run once per row of its kernel.
Runs may overlap or touch unless `merged`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = ["image_id", "y", "x0", "x1"]
POINT = {0: 0}
#: Pixels that a task makes runs of together.
PACKED = 1 << 19


def kernel(radius: int, shape: str = "square") -> dict[int, int]:
    """Half widths of a kernel by row: a square (Chebyshev), a disc (Euclidean) or an ellipse (radius 1: a plus)."""
    rows = range(-radius, radius + 1)
    if shape == "square" or not radius:
        return dict.fromkeys(rows, radius)
    if shape == "disc":
        return {dy: int((radius * radius - dy * dy) ** 0.5 + 1e-9) for dy in rows}
    return {dy: int(round(radius * max(0.0, 1 - (dy / radius) ** 2) ** 0.5)) for dy in rows}


def run_schema(image: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("image_id", image)] + [T.StructField(n, T.LongType()) for n in RUN[1:]])


def codes(values: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, which may be structs."""
    if not pa.types.is_struct(values.type):
        return pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy().astype(np.int64)
    out = np.zeros(len(values), np.int64)
    for field in values.flatten():
        own = codes(field)
        out = np.unique(out * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return out


def row_runs(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of pixels sorted by image, y and x; repeated pixels count once."""
    new = np.ones(len(x), bool)
    new[1:] = (image[1:] != image[:-1]) | (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(x))[: len(first)] - 1


def runs_of(px: DataFrame) -> DataFrame:
    """Runs of pixels (image_id, y, x), made of PACKED pixels at a time without a shuffle: whole ones where a
    part of px has whole rows of images, in any order, and single pixels where it has not."""
    schema = run_schema(px.schema["image_id"].dataType)

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        image, y, x = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
        code, y, x = codes(image), y.to_numpy(), x.to_numpy()
        order = np.lexsort((x, y, code))
        first, last = row_runs(code[order], y[order], x[order])
        at = order[first]
        return pa.RecordBatch.from_arrays([image.take(pa.array(at)), pa.array(y[at]), pa.array(x[at]), pa.array(x[order[last]])], names=RUN)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return px.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).where("y IS NOT NULL AND x IS NOT NULL").mapInArrow(pack, schema)


def pixels_of(runs: DataFrame) -> DataFrame:
    """The pixels of merged runs."""
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def tagged(runs: DataFrame, kernels: dict[str, dict[int, int]], height: int | None = None, width: int | None = None) -> DataFrame:
    """Runs grown by each of some kernels (half widths by row), inside the frame where one is given; `tag`
    names the kernel."""
    at = [F.struct(F.lit(name).alias("tag"), F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for name, k in kernels.items() for dy, dx in k.items()]
    y, x0, x1 = F.col("y") + F.col("s.dy"), F.col("x0") - F.col("s.dx"), F.col("x1") + F.col("s.dx")
    if width is not None:
        x0, x1 = F.greatest(F.lit(0).cast("long"), x0), F.least(F.lit(width - 1).cast("long"), x1)
    out = runs.select(*RUN, F.explode(F.array(*at)).alias("s")).select("image_id", y.alias("y"), x0.alias("x0"), x1.alias("x1"), "s.tag")
    return out.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x0") <= F.col("x1"))) if height is not None else out


def shrunk(runs: DataFrame, name: str, k: dict[int, int], height: int, width: int, outside: bool) -> DataFrame:
    """Merged runs in which a row of the kernel fits, at the rows it speaks for; a pixel of the erosion has one
    of each kernel row.  outside: what is beyond the frame counts as set."""
    at = F.explode(F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in k.items()])).alias("s")
    x0, x1 = F.col("x0") + F.col("s.dx"), F.col("x1") - F.col("s.dx")
    if outside:
        x0, x1 = F.when(F.col("x0") <= 0, F.col("x0")).otherwise(x0), F.when(F.col("x1") >= width - 1, F.col("x1")).otherwise(x1)
    out = runs.select(*RUN, at).select("image_id", (F.col("y") - F.col("s.dy")).alias("y"), x0.alias("x0"), x1.alias("x1"), F.lit(name).alias("tag"))
    return out.where((F.col("x0") <= F.col("x1")) & (F.col("y") >= 0) & (F.col("y") < height))


def kernel_rows(k: dict[int, int], height: int, outside: bool) -> Column:
    """How many rows of the kernel must fit at row y."""
    if not outside:
        return F.lit(len(k))
    return sum((F.when((F.col("y") + dy < 0) | (F.col("y") + dy >= height), 0).otherwise(1) for dy in k), F.lit(0))


def sweep(runs: DataFrame, tags: list[str]) -> DataFrame:
    """(image_id, y, x0, x1, <tag>...): the stretches of each row between places where a run begins or ends,
    and how many runs of each tag lie over them; stretches under no run are left out.

    A task sorts narrow rows once and keeps nothing else: of ends at one place the last has the full sums."""
    nth = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag")).cast("int")
    edge = F.explode(F.array(F.struct(F.col("x0").alias("x0"), nth.alias("k")), F.struct((F.col("x1") + 1).alias("x0"), (-nth).alias("k")))).alias("e")
    e = runs.select("image_id", "y", edge).select("image_id", "y", "e.x0", "e.k").repartition("image_id", "y")
    row = Window.partitionBy("image_id", "y").orderBy("x0")
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    over = [F.sum(F.when(F.col("k") == i, 1).when(F.col("k") == -i, -1).otherwise(0)).over(upto).alias(t) for i, t in enumerate(tags, 1)]
    s = e.select("image_id", "y", "x0", (F.lead("x0").over(row) - 1).alias("x1"), *over).where("x0 <= x1")
    some = F.lit(False)
    for t in tags:
        some |= F.col(t) > 0
    return s.where(some)


def where(stretches: DataFrame, rule: Column) -> DataFrame:
    """Merged runs of the stretches where a rule holds: their first and last stretches, in the order of the sweep."""
    row = Window.partitionBy("image_id", "y").orderBy("x0")
    on = F.coalesce(F.lag("x1").over(row) == F.col("x0") - 1, F.lit(False)).alias("on")
    goes = F.coalesce(F.lead("x0").over(row) == F.col("x1") + 1, F.lit(False)).alias("goes")
    ends = stretches.where(rule).select(*RUN, on, goes).where("NOT on OR NOT goes")
    ends = ends.select(*RUN[:3], F.when(F.col("goes"), F.lead("x1").over(row)).otherwise(F.col("x1")).alias("x1"), "on")
    return ends.where("NOT on").select(*RUN)


def named(sets: dict[str, DataFrame]) -> DataFrame:
    """Several sets of runs under one tag each."""
    out = None
    for name, runs in sets.items():
        one = runs.select(*RUN, F.lit(name).alias("tag"))
        out = one if out is None else out.unionByName(one)
    return out


def merged(runs: DataFrame) -> DataFrame:
    """The same pixels in runs that neither overlap nor touch."""
    return where(sweep(named({"a": runs}), ["a"]), F.col("a") > 0)


def union(*sets: DataFrame) -> DataFrame:
    names = [f"s{i}" for i in range(len(sets))]
    return where(sweep(named(dict(zip(names, sets))), names), F.lit(True))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return where(sweep(named({"a": a, "b": b}), ["a", "b"]), (F.col("a") > 0) & (F.col("b") > 0))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return where(sweep(named({"a": a, "b": b}), ["a", "b"]), (F.col("a") > 0) & (F.col("b") == 0))


def dilate(runs: DataFrame, k: dict[int, int], height: int, width: int) -> DataFrame:
    return where(sweep(tagged(runs, {"a": k}, height, width), ["a"]), F.col("a") > 0)


def erode(runs: DataFrame, k: dict[int, int], height: int, width: int, outside: bool = True) -> DataFrame:
    """Pixels whose whole kernel is set, from merged runs."""
    return where(sweep(shrunk(runs, "a", k, height, width, outside), ["a"]), F.col("a") == kernel_rows(k, height, outside))


def boundaries(sets: dict[str, DataFrame], height: int, width: int) -> DataFrame:
    """Tagged runs of the set pixels of each set (merged runs) with an unset neighbour among eight; outside
    the frame counts as unset.  One sweep serves all sets."""
    k, all_ = kernel(1), named(sets)
    for name, runs in sets.items():
        all_ = all_.unionByName(shrunk(runs, f"{name}_in", k, height, width, False))
    s = sweep(all_, [t for name in sets for t in (name, f"{name}_in")])
    kept = F.array(*[F.when((F.col(name) > 0) & (F.col(f"{name}_in") < len(k)), F.lit(name)) for name in sets])
    return s.select(*RUN, F.explode(F.filter(kept, lambda t: t.isNotNull())).alias("tag"))


def size(rule: Column) -> Column:
    """Pixels of the stretches where a rule holds, as an aggregate."""
    return F.coalesce(F.sum(F.when(rule, F.col("x1") - F.col("x0") + 1)), F.lit(0)).cast("long")
