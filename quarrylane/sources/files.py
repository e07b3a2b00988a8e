"""Sources and sinks: frame and mask pairs, rasters, manifests, catalogues, result documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "split string, source_image string, patch_path string, mask_path string, positive_pixel_fraction double"
CATALOGUE = ("Length", "Start_RA", "End_RA", "Start_DEC", "End_DEC", "Satellite_Name")
VERDICTS = ("trail", "no_trail", "uncertain")


def images(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Image files of a folder: path, height, width, channels, data (row-major bytes)."""
    i = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return i.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def pair_frames(frames: DataFrame, masks: DataFrame, frame_end: str, mask_end: str, strict: bool = True) -> DataFrame:
    """(image_id, image_path, mask_path, height, width) of frames and masks (path, height, width) with
    equal stems.  A frame without mask fails when strict and is left out otherwise; different sizes
    fail.  Reads sizes only."""
    stem = lambda path, end: F.regexp_extract(path, r"([^/]+)" + end + "$", 1)
    f = frames.select(stem(F.col("path"), frame_end).alias("image_id"), F.col("path").alias("image_path"), "height", "width").where("image_id <> ''")
    m = masks.select(stem(F.col("path"), mask_end).alias("image_id"), F.col("path").alias("mask_path"), F.col("height").alias("mh"), F.col("width").alias("mw")).where("image_id <> ''")
    p = f.join(m, "image_id", "left" if strict else "inner")
    fail = lambda why, c: F.raise_error(F.concat(F.lit(why), F.col(c)))
    checked = F.when(F.col("mask_path").isNull(), fail("no mask for ", "image_path")).when((F.col("height") != F.col("mh")) | (F.col("width") != F.col("mw")), fail("sizes differ: ", "image_path")).otherwise(F.col("mask_path"))
    return p.select("image_id", "image_path", checked.alias("mask_path"), "height", "width")


def luma(px: np.ndarray) -> np.ndarray:
    """Grey of an (h, w, c) raster in BGR order, rounded."""
    if px.shape[2] == 1:
        return px[:, :, 0]
    return np.rint(px[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def tiles(rasters: DataFrame, size: int) -> DataFrame:
    """(path, ty, tx, y0, x0, h, w, data): rasters cut into square tiles, so no later row is as large
    as a frame; the last tiles of a row or column may be smaller."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                g = luma(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels))
                rows = [(r.path, y // size, x // size, y, x, *(t := np.ascontiguousarray(g[y : y + size, x : x + size])).shape, t.tobytes()) for y in range(0, r.height, size) for x in range(0, r.width, size)]
                yield pd.DataFrame(rows, columns=["path", "ty", "tx", "y0", "x0", "h", "w", "data"])

    return rasters.select("path", "height", "width", "channels", "data").mapInPandas(cut, "path string, ty int, tx int, y0 int, x0 int, h int, w int, data binary")


def tile_pixels(tiled: DataFrame, above: int | None = None) -> DataFrame:
    """(path, y, x, v) of all pixels of tiles, or of those above a value (0 for a mask)."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                g = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)
                y, x = np.nonzero(g > above) if above is not None else np.indices(g.shape).reshape(2, -1)
                yield pd.DataFrame({"path": r.path, "y": y + r.y0, "x": x + r.x0, "v": g[y, x].astype(np.int64)})

    return tiled.mapInPandas(spread, "path string, y int, x int, v long")


def score_tiles(tiled: DataFrame, make_model, batch: int = 32) -> DataFrame:
    """Adds `prob`, the scores of tiles (h, w, data) by a model, as little-endian floats.

    make_model() runs once per task and gives a callable from (N, H, W) floats of 0 to 1 to (N, H, W)
    logits; tiles of one size go through it together, at most `batch` at a time."""
    schema = T.StructType([*tiled.schema.fields]).add("prob", "binary")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            out: list[bytes | None] = [None] * len(b)
            for (h, w), i in b.groupby(["h", "w"]).indices.items():
                for a in range(0, len(i), batch):
                    at = i[a : a + batch]
                    x = np.stack([np.frombuffer(b["data"].iloc[k], np.uint8).reshape(h, w) for k in at]) / 255.0
                    p = 1 / (1 + np.exp(-np.asarray(model(x), float)))
                    for k, one in zip(at, p):
                        out[k] = one.astype("<f4").tobytes()
            yield b.assign(prob=out)

    return tiled.mapInPandas(score, schema)


def reflected(n: int, size: int) -> np.ndarray:
    """Source places of an axis of n, padded by reflection to a multiple of size."""
    full = -(-n // size) * size
    p = np.arange(full)
    if n == 1:
        return np.zeros(full, int)
    p = p % (2 * n - 2)
    return np.where(p < n, p, 2 * n - 2 - p)


def padded_tiles(rasters: DataFrame, size: int) -> DataFrame:
    """As tiles, of rasters padded by reflection to whole tiles; height and width keep the true size."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                g = luma(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels))
                ys, xs = reflected(r.height, size), reflected(r.width, size)
                rows = [(r.path, r.height, r.width, y, x, size, size, g[np.ix_(ys[y : y + size], xs[x : x + size])].tobytes()) for y in range(0, len(ys), size) for x in range(0, len(xs), size)]
                yield pd.DataFrame(rows, columns=["path", "height", "width", "y0", "x0", "h", "w", "data"])

    return rasters.select("path", "height", "width", "channels", "data").mapInPandas(cut, "path string, height int, width int, y0 int, x0 int, h int, w int, data binary")


def scored_pixels(scored: DataFrame, least: float = 0.0) -> DataFrame:
    """(path, y, x, prob) of scored padded tiles, cropped to the true size; only scores of at least `least`."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                p = np.frombuffer(r.prob, "<f4").reshape(r.h, r.w)
                y, x = np.nonzero(p >= least)
                ok = (y + r.y0 < r.height) & (x + r.x0 < r.width)
                y, x = y[ok], x[ok]
                yield pd.DataFrame({"path": r.path, "y": y + r.y0, "x": x + r.x0, "prob": p[y, x].astype(float)})

    return scored.mapInPandas(spread, "path string, y int, x int, prob double")


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A manifest in Parquet or CSV (by name), one split of it or all; partitions are pruned."""
    m = spark.read.csv(path, header=True, schema=MANIFEST) if path.endswith(".csv") else spark.read.parquet(path)
    return m.where(F.col("split") == split) if split else m


def write_manifest(m: DataFrame, path: str) -> None:
    m.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.partitionBy("split").parquet(path)


def write_audited_manifest(m: DataFrame, path: str) -> dict[str, int]:
    """Writes a manifest and returns, counted while it is written, its rows and those with an unknown split, a
    fraction outside 0 to 1 or a missing value; nothing is read twice."""
    seen = Observation()
    ok = F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False))
    fraction = F.col("positive_pixel_fraction")
    gone = F.col("source_image").isNull() | F.col("patch_path").isNull() | F.col("mask_path").isNull()
    write_manifest(m.observe(seen, F.count("*").alias("rows"), F.count_if(~ok).alias("split_values"), F.count_if(fraction.isNull() | (fraction < 0) | (fraction > 1)).alias("fraction_range"), F.count_if(gone).alias("missing_values")), path)
    return dict(seen.get)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue; fails when one of its columns is missing."""
    c = spark.read.csv(path, header=True)
    if missing := sorted(set(CATALOGUE) - set(c.columns)):
        raise ValueError(f"missing columns: {missing}")
    return c


#: Keys of test metrics, which a selection among results may not see.
TEST_KEYS = ("test_precision", "test_recall", "test_dice", "test_iou", "test_counts", "test_metrics", "test_loss")


def read_results(spark: SparkSession, pattern: str, forbidden: tuple[str, ...] = TEST_KEYS) -> DataFrame:
    """Result documents with their file; fails when one holds a key that selection may not see."""
    r = spark.read.option("multiLine", "true").json(pattern).withColumn("file", F.input_file_name())
    if seen := sorted(set(forbidden) & set(r.columns)):
        raise ValueError(f"results hold {seen}")
    return r


def read_documents(spark: SparkSession, pattern: str, fields: dict[str, str], forbidden: tuple[str, ...] = TEST_KEYS) -> DataFrame:
    """(file, document, <field>...): whole JSON documents as variants, whatever their shapes, in one pass
    without inferring a schema; fields are given as {name: "path type"}, such as {"f1": "$.best.f1
    double"}, and null where a document lacks them or holds another kind.  A file that is no JSON, or has
    a key that selection may not see, fails when it is read."""
    text = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), F.expr("try_parse_json(value)").alias("document"))
    seen = [F.when(F.expr(f"try_variant_get(document, '$.{k}', 'variant')").isNotNull(), F.lit(k)) for k in forbidden]
    fail = lambda *why: F.raise_error(F.concat(F.col("file"), *why)).cast("string")
    keys = F.array_join(F.filter(F.array(*seen), lambda k: k.isNotNull()), ", ") if forbidden else F.lit("")
    bad = F.when(F.col("document").isNull(), fail(F.lit(" is no JSON"))).when(keys != "", fail(F.lit(" holds "), keys))
    get = lambda spec: F.expr(f"try_variant_get(document, '{spec.split(maxsplit=1)[0]}', '{spec.split(maxsplit=1)[1]}')")
    return text.select(F.coalesce(bad, "file").alias("file"), "document").select("*", *[get(s).alias(n) for n, s in fields.items()])


def document_points(documents: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """(file, place, <field>...): one row per element of an array in documents of read_documents (a curve, the
    results of all images), fields as there, within the element."""
    each = documents.select("file", F.posexplode(F.expr(f"try_variant_get(document, '{path}', 'array<variant>')")).alias("place", "_v"))
    get = lambda spec: F.expr(f"try_variant_get(_v, '{spec.split(maxsplit=1)[0]}', '{spec.split(maxsplit=1)[1]}')")
    return each.select("file", "place", *[get(s).alias(n) for n, s in fields.items()])


def curve_rows(results: DataFrame, curve: str = "pr_curve") -> DataFrame:
    """One row per point of the documents' curves (an array of structs), with the other columns;
    documents without a curve have no rows."""
    rest = [c for c in results.columns if c != curve]
    return results.select(*rest, F.explode(curve).alias("_point")).select(*rest, "_point.*")


def no_nan(df: DataFrame) -> DataFrame:
    """Nulls in place of NaN and infinities in every double."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    return df.select(*[ok(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    no_nan(df).write.mode("overwrite").format(kind).save(path)


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def below(path: str | Column, root: str = "") -> Column:
    """A path without scheme, host and the root folder, so that names in a manifest (absolute or relative to
    the root) and listed files compare."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"/+", "/")
    top = plain(F.lit(root.rstrip("/") + "/"))
    p = plain(F.col(path) if isinstance(path, str) else path)
    p = F.when(F.startswith(p, top), F.substring(p, F.length(top) + 1, F.length(p))).otherwise(p) if root else p
    return F.regexp_replace(p, r"^(\./)+", "")


def absent_files(manifest: DataFrame, listing: DataFrame, columns: str | list[str], root: str = "") -> DataFrame:
    """Rows of a manifest with `absent_column` and `absent_path` for each of its files that is not in a listing
    (path); files are the same when their paths below the root are, so equal names in other folders
    don't count.  A null path is absent."""
    columns = [columns] if isinstance(columns, str) else columns
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("absent_column"), F.col(c).alias("absent_path")) for c in columns]))
    rows = manifest.withColumn("_f", each).select(*manifest.columns, "_f.*").withColumn("_p", below("absent_path", root))
    return rows.join(listing.select(below("path", root).alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def check_verdicts(v: DataFrame) -> DataFrame:
    """Trimmed verdicts (crop_name, verdict); fails on a repeated or missing name and on an unknown or missing
    verdict (an empty field of a CSV file is null)."""
    v = v.select(F.trim(F.coalesce("crop_name", F.lit(""))).alias("crop_name"), F.trim(F.coalesce("verdict", F.lit(""))).alias("verdict"))
    one = v.groupBy("crop_name").agg(F.count("*").alias("n"), F.max("verdict").alias("verdict"))
    fail = lambda why, c: F.raise_error(F.concat(F.lit(why), F.col(c)))
    bad = F.when(F.col("crop_name") == "", fail("no name for the verdict ", "verdict")).when(F.col("n") > 1, fail("repeated: ", "crop_name")).when(~F.col("verdict").isin(*VERDICTS), fail("unknown verdict: ", "verdict"))
    return one.select("crop_name", F.coalesce(bad.cast("string"), F.col("verdict")).alias("verdict"))


def mask_values(strips: DataFrame) -> DataFrame:
    """(name, height, width, unset, full, other): pixels of each mask file at 0, at 255 and at other values,
    from its strips."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [np.bincount(np.frombuffer(d, np.uint8), minlength=256) for d in b["data"]]
            yield b[["path", "height", "width"]].assign(unset=[x[0] for x in n], full=[x[255] for x in n], other=[x[1:255].sum() for x in n])

    one = strips.select("path", "height", "width", "data").mapInPandas(count, "path string, height int, width int, unset long, full long, other long")
    return one.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "height", "width").agg(*[F.sum(c).alias(c) for c in ("unset", "full", "other")])


def annotation_problems(expected: DataFrame, masks: DataFrame, verdicts: DataFrame, size: int) -> DataFrame:
    """(name, problem) of everything that keeps an annotation set from being used: expected (name), masks as
    mask_values, verdicts (crop_name, verdict).  An empty result means that the masks and verdicts have
    just the expected names, once each, the masks are `size` pixels wide and high, hold 0 and 255 alone
    and are not all 255, and the verdicts are known ones."""
    e = expected.select("name").distinct().withColumn("_e", F.lit(True))
    m = masks.groupBy("name").agg(F.count("*").alias("_m"), F.max((F.col("height") != size) | (F.col("width") != size)).alias("_size"), F.max(F.col("other") > 0).alias("_other"), F.max((F.col("full") > 0) & (F.col("unset") + F.col("other") == 0)).alias("_all"))
    v = verdicts.select(F.trim(F.coalesce("crop_name", F.lit(""))).alias("name"), F.trim(F.coalesce("verdict", F.lit(""))).alias("verdict"))
    v = v.groupBy("name").agg(F.count("*").alias("_v"), F.max(~F.col("verdict").isin(*VERDICTS)).alias("_unknown"))
    j = e.join(m, "name", "full").join(v, "name", "full")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    wanted, mask, verdict = is_("_e"), F.col("_m").isNotNull(), F.col("_v").isNotNull()
    rules = [
        ("missing mask", wanted & ~mask), ("extra mask", mask & ~wanted), ("repeated mask", F.coalesce(F.col("_m") > 1, F.lit(False))), ("wrong size", is_("_size")), ("other values", is_("_other")), ("all set", is_("_all")),
        ("missing verdict", wanted & ~verdict), ("extra verdict", verdict & ~wanted), ("repeated verdict", F.coalesce(F.col("_v") > 1, F.lit(False))), ("unknown verdict", is_("_unknown")),
    ]
    return j.select("name", F.explode(F.array(*[F.when(rule, F.lit(what)) for what, rule in rules])).alias("problem")).where("problem IS NOT NULL")


def reconcile(expected: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Names that are expected but missing, or found but not expected."""
    e, f = expected.select(name).distinct().withColumn("e", F.lit(1)), found.select(name).distinct().withColumn("f", F.lit(1))
    return e.join(f, name, "full").where("e IS NULL OR f IS NULL").select(name, F.when(F.col("f").isNull(), "missing").otherwise("extra").alias("problem"))
