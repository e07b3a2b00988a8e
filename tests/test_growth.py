"""Work that must grow no faster than the tables: sizes of tasks, joins of frames, lines in tiles."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import dataset as D
from quarrylane.operators import kernels as K
from quarrylane.operators import pixels as P
from quarrylane.operators import runs as R
from quarrylane.operators import streaks as T
from quarrylane.operators import studies as S
from quarrylane.plans import queries as Q
from quarrylane.plans import views as V

PX = "image_id long, y long, x long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_file_of_streaks_is_cut_before_it_becomes_pixels(spark, tmp_path):
    spark.range(2_500).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    px = V.view(spark, str(tmp_path), "v_gt_px")
    assert "RoundRobin" in plan(px) or "REPARTITION_BY_NUM" in plan(px)
    assert V.spread(spark.read.parquet(f"{tmp_path}/supplier.parquet"), "s_suppkey", 1_000).rdd.getNumPartitions() == 3
    assert px.where("image_id = 249").select("image_id").distinct().count() == 1


def test_images_come_whole_from_pixel_views(spark, tmp_path):
    spark.range(1_500).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(40_000).select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("user_id"), (F.col("id") % 100).cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    for name, parts in (("v_gt_px", 6), ("v_pred_px", 8), ("v_prob_px", 8)):
        px = V.view(spark, str(tmp_path), name)
        assert px.rdd.getNumPartitions() == parts  # by the tables' rows, not by a setting
        runs = R.runs_of(px)
        assert runs.count() == R.merged(runs).count() < px.count()


def test_runs_are_whole_over_arrow_batches(spark):
    px = spark.range(25_000).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % 5).alias("y"), F.floor(F.col("id") / 5).alias("x")).coalesce(1)
    assert {tuple(r) for r in R.runs_of(px).collect()} == {(0, y, 0, 4_999) for y in range(5)}


def test_pixels_are_not_broadcast(spark):
    px = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 2, 3)], PX)
    score = px.select("image_id", F.col("x").alias("component"), "y", "x")
    for df in (P.soft_target(px, 1, 0.5, 8, 8), P.cleaned_components(px, 1, 8, 8, 1, 0.0), K.centreline_dice(px, px, ["image_id"]), P.patch_statistics(px.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width")).distinct(), px, 4, 4), K.component_widths(score), T.component_recall(score, px, px)):
        assert "BroadcastHashJoin" not in plan(df)


def test_draws_are_merged(spark):
    c = spark.createDataFrame([(i, 1, 1, 1, i / 7, i / 9) for i in range(5)], "image_id long, tp long, fp long, fn long, a double, b double")
    for df in (S.cluster_bootstrap(c, "image_id", 3, 1), S.cluster_mean(c, "image_id", "a", 3, 1), S.paired_bootstrap(c, "image_id", "a", "b", 3, 1), S.bootstrap_mean(c.withColumn("g", F.lit(1)), "g", "image_id", "a", 3, 1)):
        assert "SortMergeJoin" in plan(df)


def test_ratios_of_splits_are_exact(spark):
    # 0.7 of 90 is 63; in doubles it is less.
    images = spark.range(90).select(F.col("id").cast("string").alias("image"), F.lit(5).cast("long").alias("positives"))
    n = Counter(r.split for r in D.image_splits(images, 0.7, 0.15, 1).collect())
    assert n == {"train": 63, "val": 13, "test": 14}


@pytest.mark.parametrize("tile", [512, 20])
def test_lines_do_not_depend_on_tiles(spark, monkeypatch, tile):
    """Stretches of tiles join into the segments of points, and votes of tiles add up."""
    monkeypatch.setattr(P, "LINE_TILE", tile)
    rng = np.random.default_rng(4)
    rows = sorted({(i, int(10 + x // 2), int(x), 0.9 if x % 3 else 0.3) for i in (0, 1) for x in range(60) if x % 11} | {(0, int(a), int(b), 0.6) for a, b in rng.integers(0, 60, (150, 2)) if b % 2})
    px = spark.createDataFrame(list({r[:3]: r for r in rows}.values()), PX + ", prob double")
    votes = Counter()
    for i, y, x in px.select("image_id", "y", "x").toLocalIterator():
        for t in range(180):
            votes[i, t, int(np.rint(x * np.cos(np.radians(t)) + y * np.sin(np.radians(t))))] += 1
    assert {(r.image_id, r.theta, r.rho): r.votes for r in P.line_votes(px, 12).collect()} == {k: n for k, n in votes.items() if n >= 12}
    line = {"max_gap": 3, "least_length": 10, "height": 60, "width": 60}
    got = {tuple(r) for r in P.complete_lines(px, 12, **line).select("image_id", "y", "x").collect()}
    assert got and got == {tuple(r) for r in P.draw_segments(P.line_points(px, 12), **line).select("image_id", "y", "x").collect()}
    kept = {tuple(r) for r in T.strata_lines(px, [0.2, 0.5], least_votes=12, **line).collect()}
    each = {s: {tuple(r) for r in P.complete_lines(px.where(F.col("prob") >= s), 12, **line).select("image_id", "y", "x").collect()} for s in (0.2, 0.5)}
    assert kept == {(*p, min(s for s in each if p in each[s])) for p in each[0.2] | each[0.5]}


def test_discs_are_marked_across_tiles(spark):
    rng = np.random.default_rng(7)
    own, a, b = ([(int(i), int(y), int(x)) for i, y, x in np.unique(rng.integers((0, -3, -3), (3, 40, 40), (n, 3)), axis=0)] for n in (300, 60, 40))
    df = [spark.createDataFrame(r, PX) for r in (own, [r for r in a if r[0] != 2], b)]
    got = P.disc_marks(df[0], {"a": (df[1], {"a0": 0, "a3": 3}), "b": (df[2], {"b2": 2})}, tile=8).collect()
    near = lambda p, s, r: any(q[0] == p[0] and (q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2 <= r * r for q in s)
    left = [r for r in a if r[0] != 2]
    assert sorted(tuple(r) for r in got) == sorted((*p, near(p, left, 0), near(p, left, 3), near(p, b, 2)) for p in own)


def test_lines_of_an_image_are_drawn_in_one_task(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(0, int(10 + x // 2), int(x)) for x in range(60) if x % 11} | {(1, int(a), int(b)) for a, b in rng.integers(0, 60, (700, 2))})
    px = spark.createDataFrame(rows, PX)
    cases = [{"least_votes": v, "max_gap": g, "least_length": 9, "height": 50, "width": 58, "thickness": k} for v, g, k in ((12, 3, 1), (15, 1, 2), (12, 2, 3))]
    drawn = P.drawn_runs(px, cases)
    assert "Window" not in plan(drawn) and "MapInArrow" not in plan(drawn)
    got = [{tuple(r) for r in P.R.pixels_of(drawn.where(F.col("case") == k)).collect()} for k in range(3)]
    for k, c in enumerate(cases):
        whole = {n: v for n, v in c.items() if n != "least_votes"}
        assert got[k] and got[k] == {tuple(r) for r in P.draw_segments(P.line_points(px, c["least_votes"]), **whole).select("image_id", "y", "x").collect()}


@pytest.mark.parametrize("tile", [256, 16])
def test_classical_detector_takes_sparse_frames(spark, tile):
    lit = [(i, 10 + x // 3 + i, x, 120 + x % 40) for i in (0, 1) for x in range(2, 60)] + [(0, 3, 50, 255), (1, 39, 0, 90)]
    sparse = spark.createDataFrame(lit, PX + ", v int")
    known = {r[:3]: r[3] for r in lit}
    dense = spark.createDataFrame([(i, y, x, known.get((i, y, x), 0)) for i in (0, 1) for y in range(40) for x in range(64)], PX + ", v int")
    line = {"tile": tile, "least_votes": 20, "max_gap": 3, "least_length": 15}
    a, b = ({tuple(r) for r in T.classical_detector(d, 40, 64, (100.0, 300.0), missing=m, **line).collect()} for d, m in ((sparse, 0), (dense, None)))
    assert a and a == b


def test_audit_crops_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(Q.QUERIES["audit_crop_list"](spark, "/root/testdata/sf0.001"))


def test_order_of_audit_crops_takes_two_levels(spark):
    px = spark.range(3_000).select((F.col("id") % 7).alias("image_id"), (F.col("id") % 50).alias("y"), F.col("id").alias("x"))
    got = T.audit_crops([("a", px.where("x < 900")), ("b", px.where("x >= 900"))], 10, 60, 4_000, 2)
    assert "row_number() windowspecdefinition(_all" in plan(got) and "SinglePartition" not in plan(got)
    points = sorted((hashlib.md5(f"2|{'a' if i < 900 else 'b'}|{i % 7}|{i % 50}|{i}".encode()).hexdigest(), i) for i in range(3_000))
    assert {(r.name, r.image_id, r.stratum) for r in got.collect()} == {(f"crop_{n:04}", i % 7, "a" if i < 900 else "b") for n, (_, i) in enumerate(points, 1)}


def test_sweeps_keep_no_hash_table(spark):
    runs = spark.createDataFrame([(0, 1, a, b, t) for a, b, t in ((0, 3, "a"), (2, 5, "a"), (4, 4, "b"), (6, 7, "a"), (9, 9, "b"))], "image_id long, y long, x0 long, x1 long, tag string")
    s = R.sweep(runs, ["a", "b"])
    merged = R.where(s, F.col("a") > 0)
    assert "HashAggregate" not in plan(merged) and plan(merged).count("Sort [") == 1
    assert {tuple(r) for r in s.collect()} == {(0, 1, 0, 1, 1, 0), (0, 1, 2, 3, 2, 0), (0, 1, 4, 4, 1, 1), (0, 1, 5, 5, 1, 0), (0, 1, 6, 7, 1, 0), (0, 1, 9, 9, 0, 1)}
    assert [tuple(r) for r in merged.collect()] == [(0, 1, 0, 7)]


def test_label_sweep_grows_runs_not_pixels(spark):
    px = spark.createDataFrame([(0, 2, x) for x in range(1, 5)], PX)
    got = P.label_sweep(px, px, [0, 1], 6, 6)
    assert plan(got).count("REPARTITION_BY_COL") == 2  # the target's pixels become runs in a sweep of their own
    assert {r.radius: (r.precision, r.recall) for r in got.collect()} == {0: (1.0, 1.0), 1: (1.0, 4 / 14)}
