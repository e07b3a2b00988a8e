import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import dataset as D
from quarrylane.operators import metrics as M
from quarrylane.operators import pixels as P
from quarrylane.operators import studies as S
from quarrylane.sources import files as S_
from quarrylane.sources.png import png_strips

PX = "image_id int, y int, x int"


def px(spark, points, image=0):
    return spark.createDataFrame([(image, y, x) for y, x in points], PX)


def points(df):
    return {(r.y, r.x) for r in df.collect()}


def test_patch_statistics_hand_case(spark):
    images = spark.createDataFrame([(0, 4, 4), (1, 4, 4), (2, 1, 9)], "image_id int, height int, width int")
    st = P.patch_statistics(images, px(spark, [(0, 0), (0, 1), (1, 0), (1, 1)]), 2, 2)
    r = P.summarise_patches(st).first()
    assert (r.patches, r.empty, r.mean_fraction, r.positive_pixels) == (8, 7, 0.125, 4)


def test_overlapping_stride_counts_each_cover(spark):
    images = spark.createDataFrame([(0, 6, 6)], "image_id int, height int, width int")
    got = {(r.grid_y, r.grid_x): r.positive_pixels for r in P.patch_statistics(images, px(spark, [(2, 3), (5, 5)]), 4, 1).collect()}
    want = {(gy, gx): sum(gy <= y < gy + 4 and gx <= x < gx + 4 for y, x in [(2, 3), (5, 5)]) for gy in range(3) for gx in range(3)}
    assert got == want


def test_one_pixel_offset(spark):
    a, b = px(spark, [(30, x) for x in range(10, 50)]), px(spark, [(31, x) for x in range(10, 50)])
    got = {r.tolerance: (r.precision, r.recall, r.f1) for r in P.tolerant_metrics(P.tolerant_counts(a, b, [0, 1], 64, 64)).collect()}
    assert got == {0: (0.0, 0.0, 0.0), 1: (1.0, 1.0, 1.0)}


def test_distance_strata_hand_case(spark):
    got = {r.stratum: r.n for r in P.distance_strata(px(spark, [(5, 7), (5, 8), (5, 11)]), px(spark, [(5, 5)]), 2, 5).collect()}
    assert got == {"near": 1, "ambiguous": 1, "far": 1}


def test_cleaned_components_hand_case(spark):
    mask = px(spark, [(10, x) for x in range(3, 25)] + [(2, 2)])
    assert P.components(mask).select("component").distinct().count() == 2
    kept = P.cleaned_components(mask, 1, 32, 32, 5, 10)
    shape = P.component_shapes(kept).first()
    assert kept.count() == 22 and shape.area == 22 and shape.length >= 20


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_equal_flood_fill(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    g = rng.random((30, 30)) < 0.45
    g[5, :] = True
    g[:, 7] = True
    got = {(r.y, r.x): r.component for r in P.components(px(spark, list(zip(*(a.tolist() for a in np.nonzero(g))))), connectivity).collect()}
    label, want = 0, {}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not (a and b))]
    for y, x in zip(*np.nonzero(g)):
        if (y, x) in want:
            continue
        label += 1
        todo = [(y, x)]
        while todo:
            p = todo.pop()
            if p in want or not (0 <= p[0] < 30 and 0 <= p[1] < 30) or not g[p]:
                continue
            want[p] = label
            todo += [(p[0] + a, p[1] + b) for a, b in steps]
    assert got == {(int(y), int(x)): c for (y, x), c in want.items()}


def test_morphology_equals_arrays(spark):
    rng = np.random.default_rng(0)
    g = rng.random((20, 20)) < 0.6
    src = px(spark, list(zip(*(a.tolist() for a in np.nonzero(g)))))
    for shape in ("square", "ellipse"):
        for r in (1, 2):
            steps = P.offsets(r, shape)
            big = {(y + a, x + b) for y, x in zip(*np.nonzero(g)) for a, b in steps if 0 <= y + a < 20 and 0 <= x + b < 20}
            assert points(P.dilate(src, r, 20, 20, shape)) == big
            for outside in (True, False):
                at = lambda y, x: bool(g[y, x]) if 0 <= y < 20 and 0 <= x < 20 else outside  # noqa: B023, E731
                small = {(y, x) for y in range(20) for x in range(20) if g[y, x] and all(at(y + a, x + b) for a, b in steps)}
                assert points(P.erode(src, r, 20, 20, shape, outside)) == small


def test_soft_bands_only_in_train(spark):
    both = px(spark, [(5, 5)]).union(px(spark, [(5, 5)], 1))
    got = {}
    for r in P.soft_target(both, 1, 0.5, 9, 9, train=spark.createDataFrame([(0,)], "image_id int")).collect():
        got.setdefault(r.image_id, []).append(r.value)
    assert sorted(got[0]) == [0.5] * 8 + [1.0] and got[1] == [1.0]


def test_identical_masks_have_full_surface_score(spark):
    a = px(spark, [(y, x) for y in range(5, 12) for x in range(5, 12)])
    assert {r.nsd for r in P.surface_counts(a, a, [1, 2], 20, 20).collect()} == {1.0}
    assert P.boundary(a, 20, 20).count() == 24


def test_line_completion_bridges_a_gap(spark):
    rows = [(30, x) for x in range(10, 200) if not 90 <= x < 100]
    lines = P.complete_lines(px(spark, rows), 60, 12, 50, 64, 256)
    assert {(30, x) for x in range(10, 200)} <= points(lines)
    acc = P.line_accounting(px(spark, rows), P.union(px(spark, rows), lines), px(spark, [(30, x) for x in range(10, 200)]), 64).first()
    assert acc.recall_post == 1.0 and acc.recall_pre < 1 and acc.image_fnr_pre == 0


def test_detection_needs_overlap(spark):
    pred, target = px(spark, [(0, 0)]), px(spark, [(9, 9)])
    acc = P.line_accounting(pred, pred, target, 4).first()
    assert acc.image_fnr_pre == 1.0 and acc.precision_pre == 0.0
    none = P.line_accounting(px(spark, []), px(spark, []), px(spark, []), 4).first()
    assert none.recall_pre is None and none.precision_pre is None


def scored(spark, rows):
    return spark.createDataFrame(rows, "image_id int, patch_id int, prob double, target boolean, gate double")


def test_sweep_hand_case(spark):
    s = scored(spark, [(0, 0, 0.7, i < 8, 0.5) for i in range(32)])
    got = {round(r.threshold, 2): (r.recall, r.precision) for r in M.sweep(s).collect()}
    assert len(got) == 91 and got[0.5] == (1.0, 0.25) and got[0.8] == (0.0, 0.0) and got[0.7] == (1.0, 0.25) and got[0.71] == (0.0, 0.0)
    assert M.best_threshold(M.sweep(s)).first().threshold == 0.05
    assert M.operating_points(M.sweep(s), 0.9).first().best_f1 == 0.7


def test_auc_ties_and_one_class(spark):
    assert M.roc_auc(scored(spark, [(0, 0, 0.5, True, 0.0), (0, 0, 0.5, False, 0.0)])).first().auc == 0.5
    assert M.roc_auc(scored(spark, [(0, 0, 0.5, True, 0.0)])).first().auc is None


def test_fp_labels(spark):
    none = M.fp_decomposition(scored(spark, [(0, 0, 0.1, False, 0.0)])).first()
    assert none.label == "insufficient-data" and none.inter_fraction == 0
    rows = [(0, p, 0.9, False, 0.0) for p in range(8) for _ in range(16)] + [(0, 8 + p, 0.9, i == 0, 0.0) for p in range(8) for i in range(9)]
    r = M.fp_decomposition(scored(spark, rows)).first()
    assert (r.inter_patch_fp, r.intra_patch_fp, r.label) == (128, 64, "gate-favourable")


def test_fp_label_at_the_limit(spark):
    rows = [(0, 0, 0.9, False, 0.0)] * 2 + [(0, 1, 0.9, i == 0, 0.0) for i in range(3)]
    assert M.fp_decomposition(scored(spark, rows)).first().label == "gate-favourable"  # a half is enough
    assert M.fp_decomposition(scored(spark, rows[1:])).first().label == "gate-limited"


def test_fired_and_quiet(spark):
    s = scored(spark, [(0, 0, 0.95, False, 0.0), (0, 1, 0.5, False, 0.0), (0, 2, 0.1, False, 0.0), (0, 3, 0.9, True, 0.0)])
    assert {(r.patch_id, r.fired) for r in M.fired_patches(s, 0.9, 0.3).collect()} == {(0, True), (2, False)}


def test_losses_weigh_a_half_each(spark):
    r = M.patch_losses(scored(spark, [(0, 0, 0.5, True, 0.0), (0, 0, 0.5, False, 0.0)]), ["patch_id"]).first()
    dice = 1 - (2 * 0.5 + 1e-4) / (0.5 + 1 + 1e-4)
    assert r.bce == pytest.approx(np.log(2)) and r.dice_loss == pytest.approx(dice) and r.loss == pytest.approx((np.log(2) + dice) / 2)


def test_threshold_chosen_on_one_part_and_scored_on_another(spark):
    val = [(0, 0, 0.6, True, 0.0), (0, 0, 0.4, False, 0.0), (0, 0, 0.3, False, 0.0)]
    test = [(1, 1, 0.45, True, 0.0), (1, 1, 0.42, False, 0.0), (1, 1, 0.2, True, 0.0), (1, 1, 0.1, False, 0.0)]
    s = scored(spark, val + test)
    r = M.tuned_scores(s, F.col("image_id") == 0, F.col("image_id") == 1).first()
    assert (r.threshold, r.chosen_f1, r.tp, r.fp, r.tn, r.fn) == (0.41, 1.0, 1, 1, 1, 1)
    fixed = M.tuned_scores(s, F.lit(False), F.col("image_id") == 1, threshold=0.15).first()
    assert (fixed.tp, fixed.fp, fixed.tn, fixed.fn, fixed.chosen_f1) == (2, 1, 1, 0, None)
    assert M.tuned_scores(s, F.lit(False), F.col("image_id") == 1).first().threshold == 0.05


def test_views_are_turned_back(spark):
    v = spark.createDataFrame([(0, k, y, x, p, "fixed") for k, y, x, p in [("as_is", 1, 2, 0.2), ("flip_x", 1, 1, 0.4), ("flip_y", 4, 2, 0.6), ("turned", 4, 1, 0.8)]], "image_id int, view string, y int, x int, prob double, normalisation string")
    r = M.view_mean(v, 6, 4).collect()
    assert len(r) == 1 and (r[0].y, r[0].x) == (1, 2) and r[0].prob == pytest.approx(0.5)
    with pytest.raises(Exception, match="normalisation"):
        M.view_mean(v.withColumn("normalisation", F.col("view")), 6, 4).collect()


def test_running_sums_cross_parts(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(200)], "v double, n long").repartition(7)
    assert all(r.n_before == sum(range(int(r.v))) for r in M.running_before(df, "v", ["n"], 8).collect())


def test_binarise_kinds(spark):
    b = spark.range(1).select(M.binarise(F.lit(2), 0.5, kind="int").alias("a"), M.binarise(F.lit(0), 0.5, kind="int").alias("b"), M.binarise(F.lit(True), 2, kind="bool").alias("c"), M.binarise(F.lit(0.5), 0.5).alias("d"), M.binarise(F.lit(0), 0.5, True, "int").alias("e"), M.binarise(F.lit(-1), 0.5, True).alias("f")).first()
    assert tuple(b) == (True, False, True, True, True, False)


def test_metrics_without_denominators(spark):
    r = M.metrics(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")).first()
    assert all(v == 0 for v in r)


@pytest.mark.parametrize("parts", [1, 8])
def test_bootstrap_does_not_hang_on_order(spark, parts):
    c = spark.createDataFrame([("a", 10, 2, 1), ("b", 5, 1, 0), ("c", 0, 0, 0)], "image_id string, tp long, fp long, fn long").repartition(parts)
    r = S.cluster_bootstrap(c, "image_id", 200, 1).first()
    assert r == S.cluster_bootstrap(c.orderBy(F.desc("image_id")), "image_id", 200, 1).first() and r.dice_lo <= 30 / 34 <= r.dice_hi
    one = S.cluster_bootstrap(c.where("image_id = 'a'"), "image_id", 50, 1).first()
    assert one.dice_lo == one.dice_hi == pytest.approx(20 / 23)
    assert S.cluster_mean(c.where("image_id = 'a'"), "image_id", "tp", 50, 1).first().mean_lo is None


def test_names_and_dates(spark):
    df = spark.createDataFrame([("ML1_20190602_181454_red.fits_full.png",), ("unexpected_name.png",)], "n string")
    got = [r.t for r in df.select(D.parse_observation(F.col("n")).alias("t")).collect()]
    assert str(got[0]) == "2019-06-02 18:14:54" and got[1] is None
    with pytest.raises(Exception, match="no mask rule"):
        df.select(D.mask_path(F.col("n"))).collect()
    y, x = D.parse_patch(F.lit("a_12_34_image.png"))
    assert tuple(spark.range(1).select(y, x).first()) == (12, 34)


def manifest(spark):
    rows = [("train" if i < 10 else "val", f"i{i}", 10 * i + j, 0.0 if j else 0.5) for i in range(14) for j in range(10)]
    return spark.createDataFrame(rows, "split string, source_image string, patch long, fraction double")


def test_nested_subsets(spark):
    m = manifest(spark)
    kept = [{r.source_image for r in D.image_subset(m, f, 3).where("split = 'train'").collect()} for f in (0.3, 0.5, 1.0)]
    assert [len(k) for k in kept] == [3, 5, 10] and kept[0] < kept[1] < kept[2]
    assert D.image_subset(m, 0.3, 3).where("split = 'val'").count() == 40


def test_hard_negatives_join_train_only(spark):
    m = manifest(spark)
    assert D.append_hard_negatives(m, spark.createDataFrame([(1,)], "patch long"), 2).where("patch = 1").count() == 3
    with pytest.raises(Exception, match="not in train"):
        D.append_hard_negatives(m, spark.createDataFrame([(139,)], "patch long"), 2).collect()


def test_negative_quota(spark):
    got = D.sample_negatives(manifest(spark), 3, 5).groupBy("split").agg(F.count_if(F.col("fraction") > 0).alias("p"), F.count("*").alias("n")).collect()
    assert {(r.split, r.p, r.n) for r in got} == {("train", 10, 40), ("val", 4, 16)}


def test_splits_are_disjoint_and_repeat(spark):
    c = spark.createDataFrame([(f"i{i}", i * 3) for i in range(40)], "image string, positives long")
    a = {(r.image, r.split) for r in D.image_splits(c, 0.7, 0.15, 1).collect()}
    assert a == {(r.image, r.split) for r in D.image_splits(c.repartition(5), 0.7, 0.15, 1).collect()} and len(a) == 40
    assert sum(s == "train" for _, s in a) == 28
    with pytest.raises(ValueError):
        D.image_splits(c, 0.9, 0.2, 1)


def test_noise_calibration_numbers(spark):
    # mu and sigma of the background give alpha = sigma**2 / (2 mu) and beta = sigma / sqrt(2).
    r = D.noise_calibration(spark.createDataFrame([(0, 0, x, v) for x, v in enumerate([51, 51, 102, 204])], "image_id int, y int, x int, v int")).first()
    mu, sd = 0.4, np.std([0.2, 0.2, 0.4, 0.8])
    assert (r.mu, r.sigma, r.alpha, r.beta) == (pytest.approx(mu), pytest.approx(sd), pytest.approx(sd * sd / (2 * mu)), pytest.approx(sd / 2**0.5))
    # The published pair: alpha 0.020920 and beta 0.088592 belong to one mu and sigma.
    sigma = 0.088592 * 2**0.5
    assert sigma**2 / (2 * 0.020920) == pytest.approx(0.375, abs=1e-2)
    with pytest.raises(Exception, match="mean"):
        D.noise_calibration(spark.createDataFrame([(0, 0, 0, 0)], "image_id int, y int, x int, v int")).collect()


def test_normalise_modes(spark):
    px = spark.createDataFrame([(0, 0, 0, 0.2), (0, 0, 1, 0.4), (1, 0, 0, 0.2), (1, 0, 1, 0.6)], "image_id int, y int, x int, v double")
    st = spark.createDataFrame([(0, 0.3, 0.1), (1, float("nan"), 0.1)], "image_id int, image_mean double, image_std double")
    z = lambda df: {(r.image_id, r.x): r.z for r in df.collect()}
    assert z(D.normalise(px, "fixed"))[0, 1] == pytest.approx(-0.2)
    full, own = z(D.normalise(px, "full_image", stats=st)), z(D.normalise(px))
    assert full[0, 1] == pytest.approx(0.1 / (0.1 + 1e-6)) and full[1, 0] == own[1, 0] == pytest.approx(-0.2 / (0.2828427 + 1e-6), rel=1e-5)
    with pytest.raises(ValueError):
        D.normalise(px, "other")


def test_audit_of_statistics_masks_and_files(spark):
    m = spark.createDataFrame([("train", "a", 1, 0.1, 0.5, 0.1), ("train", "a", 2, 0.0, None, None), ("val", "b", 3, 0.2, 1.5, 0.0), ("test", "c", 4, 0.3, None, 0.1)], "split string, source_image string, patch long, fraction double, image_mean double, image_std double")
    masks = spark.createDataFrame([(1, 10, 100), (3, 21, 100)], "patch long, positive_pixels long, pixels long")
    files = spark.createDataFrame([(1, 528, 528, 528, 528), (2, 528, 500, 528, 528), (3, 528, 528, 528, 528)], "patch long, height int, width int, mask_height int, mask_width int")
    got = {r.check: r.failing for r in D.audit(m, masks, files, strict=True).collect()}
    assert {k: got[k] for k in ("statistics_pattern", "statistics_range", "statistics_missing", "fraction_recomputed", "absent_files", "patch_shapes")} == {"statistics_pattern": 2, "statistics_range": 1, "statistics_missing": 2, "fraction_recomputed": 1, "absent_files": 1, "patch_shapes": 1}
    assert all(r.failing == 0 for r in D.audit(m.select("split", "source_image", "patch", "fraction")).collect())


def test_mechanism_rule(spark):
    cases = [(0.5, 0.5, 2.0, 4.0, 4.5), (0.5, 0.5, 2.0, 2.5, 4.0), (0.9, 0.5, 2.0, 4.0, 4.5), (0.5, 0.5, None, 4.0, 4.5), (0.5, 0.5, 2.0, 4.0, 5.5)]
    df = spark.createDataFrame(cases, "a double, b double, o double, r double, m double")
    got = [r.k for r in df.select(S.mechanism(*[F.col(c) for c in "abohm".replace("h", "r")]).alias("k")).collect()]
    assert got == ["thin-original support", "model-overpaint support"] + ["mixed/inconclusive"] * 3


def test_control_summary(spark):
    rows = [("q", "trail", True, True, 10), ("q", "no_trail", False, True, 30), ("q", "no_trail", False, True, 50), ("q", "no_trail", False, False, 0), ("n", "trail", True, False, 4)]
    got = {r.stratum: r for r in S.control_summary(spark.createDataFrame(rows, "stratum string, verdict string, reference_has_trail boolean, model_fired boolean, fp_pixels long"), 100).collect()}
    q = got["q"]
    assert (q.crops, q.verdict_trail, q.verdict_no_trail, q.reference_has_trail, q.model_fired, q.median_fp, q.max_fp, q.median_fp_fraction) == (4, 1, 3, 1, 3, 20, 50, 0.2)
    assert (q.over_fired, q.over_fired_median_fp, q.over_fired_max_fp, q.over_fired_median_fp_fraction) == (2, 40, 50, 0.4)
    assert got["n"].over_fired == 0 and got["n"].over_fired_median_fp is None


def test_trials_in_several_seeds(spark):
    rows = [("net", 1, s, s, 0.8 + s / 100, s == 2, 0.5, s, 1) for s in (1, 2)] + [("net", 2, 1, 3, None, False, None, 0, 0)]
    df = spark.createDataFrame(rows, "prefix string, trial int, seed int, run int, val_f1 double, bad_loss boolean, last_dice double, longest_zero long, spikes long")
    got = {r.trial: r for r in S.trial_aggregate(df, [1, 2, 3], 50, 1, [1, 2]).collect()}
    assert (got[1].n, got[1].missing_seeds, got[1].failures, got[1].longest_zero, got[1].spikes) == (2, 1, 2, 2, 2) and got[1].lo <= got[1]["mean"] <= got[1].hi
    assert (got[2].n, got[2]["mean"], got[2]["std"], got[2].failures, got[2].lo) == (0, None, None, 3, None)
    with pytest.raises(Exception, match="missing expected trial"):
        S.trial_aggregate(df, [1], 5, 1, [1, 2, 9]).collect()
    with pytest.raises(Exception, match="mixed prefixes"):
        S.trial_aggregate(df.union(df.withColumn("prefix", F.lit("other"))), [1], 5, 1).collect()
    tag = spark.createDataFrame([("a_b_t44_s2804",)], "t string").select(*S.parse_tag(F.col("t"))).first()
    assert tuple(tag) == ("a_b", 44, 2804)
    with pytest.raises(Exception, match="not a run tag"):
        spark.createDataFrame([("a_t4",)], "t string").select(*S.parse_tag(F.col("t"))).collect()


def test_tiers_need_enough(spark):
    rows = [(f"i{i % 4}", float(i), i / 20) for i in range(15)]
    df = spark.createDataFrame(rows, "source_image string, contrast double, recall double")
    got = {r.tier: r for r in S.tier_summary(df, "source_image", "contrast", ["recall"], 30, 1).collect()}
    assert [got[t].components for t in ("low", "medium", "high")] == [5, 5, 5] and all(r.recall_lo <= r.recall_mean <= r.recall_hi for r in got.values())
    assert S.tier_summary(df.limit(14), "source_image", "contrast", ["recall"], 5, 1).count() == 0
    assert S.tier_summary(df.withColumn("source_image", F.lit("x")), "source_image", "contrast", ["recall"], 5, 1).count() == 0


def test_false_positives_at_any_distance(spark):
    rng = np.random.default_rng(1)
    t, f = {(int(a), int(b)) for a, b in rng.integers(0, 30, (12, 2))}, {(int(a), int(b)) for a, b in rng.integers(0, 900, (60, 2))}
    got = {(r.y, r.x): (r.d2, r.has_target) for r in P.fp_distances(px(spark, sorted(f | t)).union(px(spark, [(5, 5)], 1)), px(spark, sorted(t))).where("image_id = 0").collect()}
    assert got == {p: (min((p[0] - a) ** 2 + (p[1] - b) ** 2 for a, b in t), True) for p in f - t}
    d = P.fp_distances(px(spark, [(5, 7), (5, 8), (5, 99)]).union(px(spark, [(1, 1)], 1)), px(spark, [(5, 5)]))
    r = P.fp_distance_summary(d).first()
    assert (r.with_target, r.without_target, r.within_2, r.within_2_of_all, r.overflow, r.median) == (3, 1, pytest.approx(1 / 3), 0.25, 1, 3.0)


def test_support_of_patches_that_overlap(spark):
    pts = [(y, x) for y in range(12) for x in range(12)]
    got = points(P.within_support(px(spark, pts), spark.createDataFrame([(0, 1, 2), (0, 3, 5)], "image_id int, y0 int, x0 int"), 4))
    assert got == {(y, x) for y, x in pts if (1 <= y < 5 and 2 <= x < 6) or (3 <= y < 7 and 5 <= x < 9)}


def test_patches_are_cut_whole(spark):
    images = spark.createDataFrame([(0, 6, 6)], "image_id int, height int, width int")
    frame = spark.createDataFrame([(0, y, x, 10 * y + x) for y in range(6) for x in range(6)], PX + ", v int")
    got = {(r.y0, r.x0): r for r in P.cut_patches(images, frame, px(spark, [(2, 3), (5, 5)]), 4, 2).collect()}
    assert set(got) == {(a, b) for a in (0, 2) for b in (0, 2)}
    for (a, b), r in got.items():
        assert list(r.pixels) == [10 * (a + i) + b + j for i in range(4) for j in range(4)]
        assert [i for i, v in enumerate(r["mask"]) if v == 255] == [(y - a) * 4 + x - b for y, x in [(2, 3), (5, 5)] if a <= y < a + 4 and b <= x < b + 4]
        assert r.positive_pixels == sum(v == 255 for v in r["mask"])


def test_surface_categories(spark):
    a, far = px(spark, [(5, 5)]), px(spark, [(9, 9)])
    images = spark.createDataFrame([(i,) for i in range(4)], "image_id int")
    pred, target = a.union(px(spark, [(1, 1)], 1)), a.union(px(spark, [(2, 2)], 2))
    r = P.surface_summary(P.surface_counts(pred, target, [1], 12, 12), pred, target, images).first()
    assert (r.scored, r.empty_both, r.empty_target, r.empty_prediction) == (1, 1, 1, 1)
    assert r.nsd_all == pytest.approx(2 / 4) and r.nsd_positive == pytest.approx(2 / 3) and far.count() == 1


def test_summaries_joined(spark):
    st = P.patch_statistics(spark.createDataFrame([(0, 4, 4), (1, 4, 4)], "image_id int, height int, width int"), px(spark, [(0, 0)]), 2, 2)
    im = spark.createDataFrame([(0, 9), (1, 8), (2, 7)], "image_id int, n int")
    assert [(r.image_id, r.non_empty_patches) for r in D.image_patch_summary(im, st).collect()] == [(2, None), (1, 0), (0, 1)]
    m = {(r.image_id, r.grid_y): (r["0"], r["1"]) for r in P.density_map(st, 2).collect()}
    assert m[0, 0] == (0.25, 0.0) and m[1, 1] == (0.0, 0.0)
    lists = D.patch_lists(st, spark.createDataFrame([(0, "train"), (1, "val")], "image_id int, split string"))
    assert {(r.split, r.n) for r in lists.where("is_positive").groupBy("split").agg(F.count("*").alias("n")).collect()} == {("train", 1)}
    with pytest.raises(Exception, match="no split"):
        D.patch_lists(st, spark.createDataFrame([(0, "train")], "image_id int, split string")).collect()


def test_noise_has_the_asked_deviation(spark):
    flat = spark.range(20_000).select(F.lit(0).alias("image_id"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.lit(0.5).alias("p"))
    sd = D.add_noise(flat, 0.02, 0.05, 1.0, 3).agg(F.stddev("p").alias("s")).first().s
    assert abs(sd - (0.02 * 0.5 + 0.0025) ** 0.5) < 0.003


def test_augment_keeps_pixels(spark):
    a = px(spark, [(y, x) for y in range(4) for x in range(4)])
    assert points(D.augment(a, 4, 9)) == points(a)


def test_catalogue_hand_case(spark):
    c = spark.createDataFrame([("10", 1.0, 2.0, -1.0, 0.5, "A"), ("20", 2.0, 3.5, 0.0, 1.5, "B"), ("30", 1.5, 3.0, 0.2, 1.0, "A"), ("bad", 2.0, 2.0, 0.0, 0.0, None)], "length string, start_ra double, end_ra double, start_dec double, end_dec double, satellite_name string")
    assert S.length_summary(c).first().median == 20
    assert tuple(S.coordinate_ranges(c).first()) == (1.0, 3.5, -1.0, 1.5)
    assert [(r.satellite_name, r.n) for r in S.name_frequency(c, 5).collect()] == [("A", 2), ("B", 1)]
    with pytest.raises(ValueError):
        S.require(c.drop("length"))


def png(path, g):
    h, w = g.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.tobytes() for r in g)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def rasters(tmp_path):
    rng = np.random.default_rng(0)
    g = {n: rng.integers(0, 256, s, dtype=np.uint8) for n, s in (("a", (5, 7)), ("b", (4, 4)))}
    for n, v in g.items():
        png(tmp_path / f"{n}_red.fits_full.png", v)
        png(tmp_path / f"{n}_red_mask.png", (v > 200).astype(np.uint8) * 255)
    return tmp_path, g


ENDS = (r"_red\.fits_full\.png", r"_red_mask\.png")


def test_pairs_and_tiles(spark, rasters):
    folder, g = rasters
    frames, masks = S_.images(spark, str(folder), "*full.png"), S_.images(spark, str(folder), "*mask.png")
    assert [r.image_id for r in S_.pair_frames(frames, masks, *ENDS).orderBy("image_id").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no mask"):
        S_.pair_frames(frames, masks.where("path LIKE '%/a_%'"), *ENDS).collect()
    assert S_.pair_frames(frames, masks.where("path LIKE '%/a_%'"), *ENDS, strict=False).count() == 1
    with pytest.raises(Exception, match="sizes differ"):
        S_.pair_frames(frames, masks.withColumn("width", F.lit(99)), *ENDS).collect()
    back = S_.tile_pixels(S_.tiles(frames, 3)).collect()
    for n, v in g.items():
        assert {(r.y, r.x): r.v for r in back if f"/{n}_" in r.path} == {(y, x): int(v[y, x]) for y in range(v.shape[0]) for x in range(v.shape[1])}
    assert S_.tile_pixels(S_.tiles(masks, 3), above=0).count() == sum((v > 200).sum() for v in g.values())


def test_pad_score_crop_round_trip(spark, rasters):
    folder, g = rasters
    tiled = S_.padded_tiles(S_.images(spark, str(folder), "*full.png"), 4)
    back = S_.scored_pixels(S_.score_tiles(tiled, lambda: lambda x: x)).collect()
    for n, v in g.items():
        own = {(r.y, r.x): r.prob for r in back if f"/{n}_" in r.path}
        assert len(own) == v.size and all(abs(p - 1 / (1 + np.exp(-float(v[k]) / 255))) < 1e-6 for k, p in own.items())
    assert list(S_.reflected(5, 4)) == [0, 1, 2, 3, 4, 3, 2, 1]


def test_documents_manifests_and_verdicts(spark, tmp_path):
    S_.write_results(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double"), f"{tmp_path}/r")
    assert sorted(str(r.b) for r in S_.read_results(spark, f"{tmp_path}/r").collect()) == ["0.5", "None"]
    with pytest.raises(ValueError):
        S_.read_results(spark, f"{tmp_path}/r", forbidden=("a",))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text('{"tag": "n_t1_s2", "pr_curve": [{"threshold": 0.5, "f1": 0.1}, {"threshold": 0.6, "f1": 0.2}]}')
    curve = S_.curve_rows(S_.read_results(spark, f"{tmp_path}/c"))
    assert sorted((r.tag, r.threshold, r.f1) for r in curve.collect()) == [("n_t1_s2", 0.5, 0.1), ("n_t1_s2", 0.6, 0.2)]
    (tmp_path / "c" / "y.json").write_text('{"tag": "n_t1_s3", "test_dice": 0.5}')
    with pytest.raises(ValueError, match="test_dice"):
        S_.read_results(spark, f"{tmp_path}/c")
    m = spark.createDataFrame([("train", "i", "p.png", "m.png", 0.1), ("val", "j", "q.png", "n.png", 0.0)], S_.MANIFEST)
    S_.write_manifest(m, f"{tmp_path}/m")
    assert S_.read_manifest(spark, f"{tmp_path}/m", "val").first().source_image == "j"
    bad = m.unionByName(spark.createDataFrame([("other", "i", "p.png", None, 1.5)], S_.MANIFEST))
    assert S_.write_audited_manifest(bad, f"{tmp_path}/audited") == {"rows": 3, "split_values": 1, "fraction_range": 1, "missing_values": 1}
    assert S_.read_manifest(spark, f"{tmp_path}/audited").count() == 3
    listing = spark.createDataFrame([("file:/r/p.png",), ("file:///r/x/q.png",), ("hdfs://h:9/r//m.png",)], "path string")
    got = S_.absent_files(m, listing, ["patch_path", "mask_path"], "/r/").collect()
    assert sorted((r.absent_column, r.absent_path) for r in got) == [("mask_path", "n.png"), ("patch_path", "q.png")]  # q.png stands in another folder
    assert S_.absent_files(m.withColumn("patch_path", F.concat(F.lit("/r/./"), "patch_path")), listing, "patch_path", "/r").count() == 1
    v = lambda rows: spark.createDataFrame(rows, "crop_name string, verdict string")
    assert S_.check_verdicts(v([("a ", " trail")])).first() == ("a", "trail")
    for bad in ([("a", "trail"), ("a ", "trail")], [("a", "maybe")], [("a", None)], [("a", " ")], [(None, "trail")]):
        with pytest.raises(Exception, match="repeated|unknown|no name"):
            S_.check_verdicts(v(bad)).collect()
    assert {(r.crop_name, r.problem) for r in S_.reconcile(v([("a", ""), ("b", "")]), v([("b", ""), ("c", "")]), "crop_name").collect()} == {("a", "missing"), ("c", "extra")}
    assert S_.file_hashes(spark, f"{tmp_path}/r").count() >= 1


def test_annotations_are_checked(spark, tmp_path):
    mask = np.zeros((6, 6), np.uint8)
    mask[2, 1:4] = 255
    grids = {"c001": mask, "c002": mask * 0, "c003": mask * 0 + 255, "c004": mask // 2, "c005": mask[:5], "extra": mask}
    for n, g in grids.items():
        png(tmp_path / f"{n}.png", g)
    masks = S_.mask_values(png_strips(spark, str(tmp_path), "*.png", 4))
    assert {(r.name, r.unset, r.full, r.other) for r in masks.collect()} >= {("c001.png", 33, 3, 0), ("c003.png", 0, 36, 0), ("c004.png", 33, 0, 3)}
    names = [f"c00{i}.png" for i in range(1, 7)]
    expected = spark.createDataFrame([(n,) for n in names], "name string")
    verdicts = spark.createDataFrame([(n, v) for n, v in zip(names[:5], [" trail", "no_trail", "maybe", None, "uncertain"])] + [("c001.png ", "trail"), ("other.png", "trail")], "crop_name string, verdict string")
    got = {(r.name, r.problem) for r in S_.annotation_problems(expected, masks, verdicts, 6).collect()}
    assert got == {
        ("c003.png", "all set"), ("c004.png", "other values"), ("c005.png", "wrong size"), ("c006.png", "missing mask"), ("extra.png", "extra mask"), ("c006.png", "missing verdict"),
        ("other.png", "extra verdict"), ("c001.png", "repeated verdict"), ("c003.png", "unknown verdict"), ("c004.png", "unknown verdict"),
    }
    two = lambda d, c: d.where(F.col(c).isin("c001.png", "c002.png"))
    assert S_.annotation_problems(two(expected, "name"), two(masks, "name"), two(verdicts, "crop_name"), 6).count() == 0


def test_documents_of_many_shapes(spark, tmp_path):
    for n, text in (("a", '{"tag": "x", "best": {"f1": 0.5}, "pr_curve": [{"t": 0.1, "p": 1}, {"t": 0.2}]}'), ("b", '{"tag": 7, "best": [1], "pr_curve": null}'), ("c", '{"best": {"f1": "high"}, "pr_curve": [{"t": "z", "p": 0.25}]}')):
        (tmp_path / f"{n}.json").write_text(text)
    read = lambda: S_.read_documents(spark, f"{tmp_path}/*.json", {"tag": "$.tag string", "f1": "$.best.f1 double"})
    docs = read()
    assert {(r.file[-6], r.tag, r.f1) for r in docs.collect()} == {("a", "x", 0.5), ("b", "7", None), ("c", None, None)}
    points_ = S_.document_points(docs, "$.pr_curve", {"t": "$.t double", "p": "$.p double"})
    assert {(r.file[-6], r.place, r.t, r.p) for r in points_.collect()} == {("a", 0, 0.1, 1.0), ("a", 1, 0.2, None), ("c", 0, None, 0.25)}
    (tmp_path / "d.json").write_text('{"test_dice": 1}')
    with pytest.raises(Exception, match="d.json holds test_dice"):
        read().collect()
    (tmp_path / "d.json").write_text("{")
    with pytest.raises(Exception, match="no JSON"):
        read().collect()
