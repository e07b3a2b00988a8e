import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from quarrylane.operators import kernels as K
from quarrylane.operators import pixels as P
from quarrylane.operators import streaks as T
from quarrylane.sources import sqlite

PX = "image_id int, y int, x int"


def px(spark, points, image=0):
    return spark.createDataFrame([(image, y, x) for y, x in points], PX)


def test_skeleton_of_bars():
    g = np.zeros((20, 40), bool)
    g[8:13, 5:35] = True
    s = K.skeleton(g)
    assert s.any() and not (s & ~g).any() and s.sum(0).max() == 1 and s.sum() >= 24
    assert not K.skeleton(np.zeros((4, 4), bool)).any()


def test_widths_of_bars(spark):
    wide = px(spark, [(y, x) for y in (10, 11, 12) for x in range(5, 60)])
    thin = px(spark, [(30, x) for x in range(5, 60)], 1)
    got = {r.image_id: r.width for r in K.component_widths(P.components(wide.union(thin))).collect()}
    assert got[0] == pytest.approx(4, abs=1) and got[1] == pytest.approx(2)


def test_centreline_dice_edges(spark):
    a, b = px(spark, [(10, x) for x in range(20)]), px(spark, [(15, x) for x in range(20)])
    keys = ["image_id"]
    assert K.centreline_dice(a, a, keys).first().centreline_dice == 1
    assert K.centreline_dice(a, b, keys).first().centreline_dice == 0
    assert K.centreline_dice(a, a.limit(0), keys).first().centreline_dice == 0


def test_tiles_find_the_same_edges_as_the_frame(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 40, (40, 50)).astype(float)
    v[18:22] += 150
    frame = spark.createDataFrame([(0, y, x, float(v[y, x])) for y in range(40) for x in range(50)], "image_id int, y int, x int, v double")
    e = K.edges(v, 60, 200)
    for tile in (16, 64):
        got = {(r.y, r.x): r.strong for r in K.edge_pixels(frame, tile, 60, 200).collect()}
        assert got == {(int(y), int(x)): bool(e[y, x] == 2) for y, x in zip(*np.nonzero(e))}
    kept = {(r.y, r.x) for r in T.edge_mask(frame, 16, 60, 200).collect()}
    assert {k for k, s in got.items() if s} <= kept <= set(got)


def test_profile_of_a_gaussian(spark):
    rows = [(0, 1, o, 12 + 30 * float(np.exp(-o * o / 18)) + (1 if o > 12 else 0)) for o in range(-20, 21)]
    r = T.profile_metrics(spark.createDataFrame(rows, "image_id int, component int, offset int, v double"), 12).first()
    assert 4 <= r.fwhm <= 10 and r.contrast > 10 and not r.saturated and r.excess > 0
    assert r.fwhm == 6 and r.peak == pytest.approx(42 - r.background)


def test_profiles_without_sideband_or_scatter(spark):
    df = lambda v: spark.createDataFrame([(0, 1, o, float(x)) for o, x in v], "image_id int, component int, offset int, v double")
    flat = T.profile_metrics(df([(-1, 10), (0, 251), (1, 10), (9, 10), (10, 10), (11, 10)]), 9).first()
    assert flat.contrast is None and flat.scatter == 0 and flat.saturated and flat.fwhm == 0 and flat.excess == pytest.approx(241)
    near = T.profile_metrics(df([(-1, 10), (0, 30), (1, 20)]), 9).first()
    assert near.background == 20 and near.peak == 10 and near.scatter == pytest.approx(14.826)
    low = T.profile_metrics(df([(0, 5), (9, 10), (10, 12)]), 9).first()
    assert low.peak == 1 and not low.saturated
    none = T.profile_metrics(df([(0, 5), (9, 10), (10, 10)]), 9).first()
    assert none.peak == 0 and none.fwhm is None


def widths(points):
    """Twice the median distance of a component's skeleton to the nearest place outside it, on one array."""
    y0, x0 = min(y for y, _ in points) - 1, min(x for _, x in points) - 1
    g = np.zeros((max(y for y, _ in points) - y0 + 2, max(x for _, x in points) - x0 + 2), bool)
    for y, x in points:
        g[y - y0, x - x0] = True
    oy, ox = np.nonzero(~g)
    d = [np.sqrt(((y - oy) ** 2 + (x - ox) ** 2).min()) for y, x in zip(*np.nonzero(K.skeleton(g)))]
    return 2 * np.median(d)


@pytest.mark.parametrize("tile, steps", [(16, 2), (16, 8), (512, 32)])
def test_widths_of_any_size(spark, tile, steps):
    streak = [(y + x // 3, x) for y in range(5) for x in range(90)]
    blob = [(y, x) for y in range(0, 81) for x in range(0, 81) if (y - 40) ** 2 + (x - 40) ** 2 <= 1600 and (y, x) != (20, 25)]
    named = P.components(px(spark, streak, 0).union(px(spark, blob, 1)))
    got = {r.image_id: r.width for r in K.component_widths(named, tile, steps).collect()}
    assert got == {0: pytest.approx(widths(streak)), 1: pytest.approx(widths(blob))}


@pytest.mark.parametrize("tile, steps", [(16, 4), (24, 10), (256, 32)])
def test_skeletons_of_tiles_are_those_of_the_whole(spark, tile, steps):
    rng = np.random.default_rng(tile)
    g = np.zeros((70, 90), bool)
    for y, x, r in zip(rng.integers(5, 65, 12), rng.integers(5, 85, 12), rng.integers(2, 17, 12)):
        yy, xx = np.ogrid[:70, :90]
        g |= (yy - y) ** 2 + (xx - x) ** 2 <= r * r
    pts = [(int(y), int(x)) for y, x in zip(*np.nonzero(g))]
    got = {(r.y, r.x) for r in K.skeletons(px(spark, pts), ["image_id"], tile, steps).collect()}
    assert got == {(int(y), int(x)) for y, x in zip(*np.nonzero(K.skeleton(g)))}


def test_centreline_dice_equals_arrays(spark):
    rng = np.random.default_rng(3)
    rows = {n: [(i, int(y), int(x)) for i in range(4) for y, x in zip(*np.nonzero(np.kron(rng.random((5, 5)) < 0.5, np.ones((6, 6), bool))))] for n in "ab"}
    frames = {n: spark.createDataFrame(r, PX) for n, r in rows.items()}
    got = {r.image_id: r.centreline_dice for r in K.centreline_dice(frames["a"], frames["b"], ["image_id"]).collect()}
    for i in range(4):
        g = {n: np.zeros((30, 30), bool) for n in "ab"}
        for n in "ab":
            for k, y, x in rows[n]:
                g[n][y, x] |= k == i
        s = {n: K.skeleton(g[n]) for n in "ab"}
        p, r = (s["a"] & g["b"]).sum() / s["a"].sum(), (s["b"] & g["a"]).sum() / s["b"].sum()
        assert got[i] == pytest.approx(2 * p * r / (p + r))


def test_two_samples_share_nothing(spark):
    c = spark.createDataFrame([(i % 6, i, t) for i, t in enumerate(["low", "mid", "high"] * 8)], "image_id int, component int, tier string")
    got = T.two_component_samples(c, 9, 5, 2804, least_images=3).collect()
    assert len(got) == 14 and len({(r.image_id, r.component) for r in got}) == 14
    tiers = [r.tier for r in got if r["sample"] == 1]
    assert tiers.count("low") == tiers.count("mid") == tiers.count("high") == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, T.two_component_samples(c.repartition(7), 9, 5, 2804, least_images=3).collect()))
    # What doesn't divide goes to the first tiers; what is left is all there is.
    tiers = [r.tier for r in T.stratified_components(c, 11, 1).collect()]
    assert (tiers.count("high"), tiers.count("low"), tiers.count("mid")) == (4, 4, 3)
    assert T.two_component_samples(c, 20, 9, 1).groupBy("sample").count().where("sample = 2").first()["count"] == 4


def test_images_out_of_reach_fail(spark):
    c = spark.createDataFrame([(0, i, t) for i, t in enumerate(["low", "mid", "high"] * 2)], "image_id int, component int, tier string")
    with pytest.raises(ValueError, match="200 has 2 images"):
        T.stratified_components(c, 3, 0, least_images=2)


def test_ends_of_a_column(spark):
    r = T.component_ends(P.components(px(spark, [(y, 300) for y in range(100, 500)])), 0.25).first()
    assert {(r.y0, r.x0), (r.y1, r.x1)} == {(100, 300), (499, 300)} and (r.y, r.x) in ((200, 300), (399, 300))


def test_recall_crops_and_strata(spark):
    t = px(spark, [(10, x) for x in range(40)])
    pre, post = px(spark, [(10, x) for x in range(10)]), px(spark, [(10, x) for x in range(30)])
    r = T.component_recall(P.components(t), pre, post).first()
    assert (r.area, r.recall_pre, r.recall_post, r.recall_added) == (40, 0.25, 0.75, 0.5)
    box = T.recovered_crop(P.recovered(post, pre, t).union(px(spark, [(30, 30)])), t, t, 64, 64, 5).first()
    assert (box.area, box.y0, box.x0, box.y1, box.x1) == (20, 5, 5, 15, 34)
    # The fat block survives the erosion, the long sliver doesn't; elsewhere the fallback or nothing counts.
    sliver, block = [(10, x) for x in range(10, 40)], [(y, x) for y in range(70, 82) for x in range(64, 80)]
    images = spark.createDataFrame([(i,) for i in range(4)], "image_id int")
    added, fallback = px(spark, sliver + block).union(px(spark, sliver, 1)), px(spark, [(0, 0)]).union(px(spark, block, 2))
    got = {r.image_id: tuple(r)[1:] for r in T.recovered_crop(added, fallback, images, 120, 140, 8).collect()}
    assert got == {0: (140, 63, 57, 88, 86), 1: (30, 2, 2, 18, 47), 2: (192, 62, 56, 89, 87), 3: (0, 0, 0, 120, 140)}
    prob = spark.createDataFrame([(0, 20, x, 0.9 if x < 40 else 0.4) for x in range(80)] + [(0, 40, x, 0.4) for x in range(60)], PX + ", prob double")
    line = {"least_votes": 30, "max_gap": 2, "least_length": 20, "height": 64, "width": 96}
    levels = {(q.y, q.x): q.level for q in T.strata_lines(prob, [0.3, 0.8], **line).collect()}
    assert levels[20, 70] == 0.3 and levels[40, 10] == 0.3
    assert {k for k in levels} >= {(q.y, q.x) for q in P.complete_lines(prob.where("prob >= 0.8"), **line).collect()}
    grid = T.detector_grid(prob, px(spark, [(20, x) for x in range(80)]), [line, line | {"least_votes": 70}], 64 * 96).collect()
    assert grid[0].setting == 1 and grid[0].recall == 1.0 and len(grid) == 2


def test_gate_annotations_and_tables(spark):
    prob = spark.createDataFrame([(0, 4, x, 0.9) for x in range(8)] + [(0, 40, x, 0.9) for x in range(8)], PX + ", prob double")
    gates = spark.createDataFrame([(0, 0, 0, 0.9), (0, 1, 0, 0.1)], "image_id int, cy int, cx int, gate double")
    acc = T.gated_line_pass(prob, gates, 0.5, 0.5, 0.1, px(spark, [(4, x) for x in range(8)] + [(40, 0)]), 32, least_votes=99, max_gap=1, least_length=5, height=64, width=64).first()
    assert acc.precision_pre == 1.0 and acc.recall_pre == pytest.approx(8 / 9) and acc.patch_fnr_pre == 0.5
    crops = spark.createDataFrame([("c", 0, 0, 0)], "name string, image_id int, y0 int, x0 int")
    a, b = px(spark, [(5, x) for x in range(10)]), px(spark, [(6, x) for x in range(10)])
    got = {(r.pairing, r.tolerance): r.f1 for r in T.annotation_scores(a, b, a, crops, 16, [0, 1]).collect()}
    assert got["first-second", 0] == 0 and got["first-second", 1] == 1 and got["first-third", 0] == 1
    th = spark.createDataFrame([(0, 0.8), (1, 0.7), (2, 0.5), (3, 0.4)], "thickness int, precision double")
    rec = {r.thickness: round(r.recovered, 6) for r in T.thickness_recovery(th).collect()}
    assert rec == {1: 0.75, 2: 0.25, 3: 0.0}
    tab = T.stratum_table(spark.createDataFrame([("s", "p", 0, 0.2), ("s", "p", 0, 0.4), ("s", "p", 1, 1.0)], "stratum string, pairing string, tolerance int, f1 double"), [0, 1]).first()
    assert (round(tab.f1_0, 6), tab.f1_1) == (0.3, 1.0)


def test_component_scores_in_support(spark):
    named = P.components(px(spark, [(10, x) for x in range(40)] + [(60, 60)]))
    patches = spark.createDataFrame([(0, 0, 0), (0, 0, 8)], "image_id int, y0 int, x0 int")
    pred = px(spark, [(10, x) for x in range(6)] + [(12, 3), (12, 23), (10, 39), (0, 0)])
    lines = px(spark, [(10, x) for x in range(12)])
    got = {r.component: r for r in T.component_scores(named, pred, lines, patches, 16, 2, 64, 64).collect()}
    a = got[1]  # x 0 to 23 are supported; (12, 3) and (12, 23) lie in the box, (0, 0) doesn't
    assert (a.supported, a.support_fraction, a.recall_pre, a.recall_post, a.added) == (24, 0.6, 0.25, 0.5, 6)
    assert a.dice_pre == pytest.approx(12 / (8 - 0 + 24)) and a.dice_post == pytest.approx(24 / (14 + 24))
    assert (got[2].supported, got[2].support_fraction, got[2].recall_pre, got[2].dice_pre) == (0, 0.0, None, None)


def test_display_excess_hand_case(spark):
    frame = spark.createDataFrame([(0, y, x, 60.0 if y == 5 or (y, x) == (7, 5) else 10.0) for y in range(12) for x in range(24)], PX + ", v double")
    target, pred = px(spark, [(5, x) for x in range(24)]), px(spark, [(5, 3), (7, 5), (11, 20), (9, 9)])
    d = T.display_excess(frame, pred, target, spark.createDataFrame([(0, 0, 0), (0, 0, 12)], "image_id int, y0 int, x0 int"), 12, 2, 5)
    got = {r.category: (r.n, r.m) for r in d.groupBy("category").agg(F.count("*").alias("n"), F.expr("percentile(excess, 0.5)").alias("m")).collect()}
    assert got["gt_trail"] == (24, 50.0) and got["near_gt_fp"] == (1, 50.0) and got["ambiguous_fp"] == (1, 0.0) and got["far_fp"] == (1, 0.0) and got["background"] == (12 * 24 - 27, 0.0)
    one = T.display_excess(frame.where("y = 5"), pred, target, spark.createDataFrame([(0, 0, 0)], "image_id int, y0 int, x0 int"), 12, 2, 5)
    assert {(r.fallback, r.excess) for r in one.collect()} == {(True, 0.0)}


def test_audit_leaves_out_uncertain_and_invisible(spark):
    crops = spark.createDataFrame([("a", "edge", 0, 0, 0, "trail"), ("b", "edge", 0, 20, 20, "trail"), ("c", "edge", 0, 0, 40, "uncertain"), ("d", "quiet", 0, 40, 40, "no_trail")], "name string, stratum string, image_id int, y0 int, x0 int, verdict string")
    ref, orig = px(spark, [(5, x) for x in range(10)]), px(spark, [(6, x) for x in range(10)] + [(25, 25), (45, 45)])
    s = T.audit_scores(crops, orig, ref, ref, 16, [0, 1], ("edge",))
    assert {(r.name, r.status) for r in s.collect()} == {("a", "scored"), ("b", "not_visible"), ("c", "uncertain"), ("d", "scored")}
    t = {(r.pairing, r.tolerance): r.f1 for r in T.audit_totals(s, ("edge",)).collect()}
    assert t["original_vs_reference", 0] == 0 and t["original_vs_reference", 1] == 1 and t["model_vs_reference", 0] == 1 and len(t) == 6
    w = {(r.name, r.source): r.width for r in T.crop_widths(crops, {"reference": ref, "original": orig}, 16).collect()}
    assert w["a", "reference"] == pytest.approx(2) and ("b", "reference") not in w and ("d", "original") in w


def test_classical_detector_finds_a_bright_line(spark):
    rows = [(0, y, x, 200 if y in (30, 31) and 5 <= x < 90 else 10 + (y * 7 + x * 3) % 5) for y in range(64) for x in range(96)]
    target = px(spark, [(y, x) for y in (29, 30, 31, 32) for x in range(4, 91)])
    mask = T.classical_detector(spark.createDataFrame(rows, PX + ", v int"), 64, 96, (200.0, 400.0), tile=32, least_votes=40, max_gap=3, least_length=30)
    got = {r.image_id: r for r in T.detector_scores(mask, target, 64 * 96).collect()}
    assert got[0].precision > 0.8 and got[0].tp >= 80 and got[None].tp == got[0].tp


FLOAT, CHOICE = '{"name": "FloatDistribution", "attributes": {"low": 0.0}}', '{"name": "CategoricalDistribution", "attributes": {"choices": [8, 16, "32"]}}'


def study(spark):
    rows = {
        "trials": ("trial_id long, number long, state string", [(1, 0, "COMPLETE"), (2, 1, "FAIL"), (3, 2, "COMPLETE"), (4, 3, "COMPLETE"), (5, 4, "RUNNING")]),
        "values": ("trial_id long, objective long, value double", [(1, 0, 0.5), (2, 0, 0.9), (3, 0, 0.7), (4, 0, 0.7), (3, 1, 0.99)]),
        "params": ("trial_id long, param_name string, param_value double, distribution_json string", [(t, n, v, d) for t in (1, 2, 3, 4) for n, v, d in (("lr", t / 10, FLOAT), ("bs", float(t % 3), CHOICE))]),
        "attributes": ("trial_id long, key string, value_json string", [(3, "bs", "64"), (1, "val_f1", "0.95"), (4, "note", '"x"'), (9, "note", "1"), (3, "odd", "{")]),
    }
    return {k: spark.createDataFrame(r, kind) for k, (kind, r) in rows.items()}


def test_best_trials_by_the_stored_objective(spark):
    s = study(spark)
    got = T.top_trials(s["trials"], s["values"], s["params"], s["attributes"], 2, ("lr",), ("bs",)).collect()
    assert [(r.trial_id, r.value, r.lr, r.bs) for r in got] == [(3, 0.7, 0.3, 64.0), (4, 0.7, 0.4, 16.0)]
    last = T.top_trials(s["trials"], s["values"], s["params"], s["attributes"], 9, ("lr", "bs")).collect()[-1]
    assert (last.trial_id, last.value, last.bs) == (1, 0.5, 16.0)  # not by val_f1
    for lacking in (s["params"].where("param_name = 'lr'"), s["params"].where("param_name = 'bs'")):
        with pytest.raises(Exception, match="lacks"):
            T.top_trials(s["trials"], s["values"], lacking, s["attributes"], 2, ("lr",), ("bs",)).collect()


def test_trial_table(spark):
    s = study(spark)
    got = T.trial_table(s["trials"], s["values"], s["attributes"], ["note", "bs"]).collect()
    assert [(r.number, r.state, r.objective, r.note, r.bs, r.val_f1) for r in got] == [
        (0, "COMPLETE", 0.5, None, None, 0.95), (1, "FAIL", 0.9, None, None, 0.9), (2, "COMPLETE", 0.7, None, "64", 0.7), (3, "COMPLETE", 0.7, "x", None, 0.7), (4, "RUNNING", None, None, None, None),
    ]


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_study_from_its_database(spark, tmp_path, partitions):
    path, s = f"{tmp_path}/study {partitions}.db", study(spark)
    con = sqlite3.connect(path)
    for name, table in (("trials", "trials"), ("values", "trial_values"), ("params", "trial_params"), ("attributes", "trial_user_attributes")):
        kinds = {"bigint": "INTEGER", "double": "FLOAT", "string": "VARCHAR(9)"}
        con.execute(f"CREATE TABLE {table} ({', '.join(f'{n} {kinds[k]}' for n, k in s[name].dtypes)})")
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(s[name].columns))})", [tuple(r) for r in s[name].collect()])
    con.execute("DELETE FROM trial_values WHERE trial_id = 2")
    con.execute("CREATE TABLE none (x, y TEXT)")
    con.commit()
    d = sqlite.study_tables(spark, path, partitions)
    assert d["trials"].schema == s["trials"].schema and sorted(d["params"].collect()) == sorted(s["params"].collect())
    got = T.top_trials(d["trials"], d["values"], d["params"], d["attributes"], 2, ("lr",), ("bs",)).collect()
    assert [(r.trial_id, r.lr, r.bs) for r in got] == [(3, 0.3, 64.0), (4, 0.4, 16.0)]
    done = d["values"].where("value > 0.6 AND objective = 0 AND trial_id IS NOT NULL")
    assert sorted(r.trial_id for r in done.collect()) == [3, 4]
    reader = sqlite.TableReader(d["values"].schema, {"path": path, "table": "trial_values", "partitions": "2"})
    left = list(reader.pushFilters([EqualTo(("objective",), 0), GreaterThan(("value",), 0.6), EqualTo(("value",), "x"), EqualTo(("a", "b"), 1)]))
    assert len(left) == 2 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    assert sqlite.sqlite_table(spark, path, "none").count() == 0
    con.execute("DROP TABLE trial_user_attributes")
    con.commit()
    assert sqlite.study_tables(spark, path)["attributes"].count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.sqlite_table(spark, path, "absent").count()


def test_reviews_of_nothing(spark):
    inf = spark.createDataFrame([(1, 1)], "expnum int, detector int")
    rev = spark.createDataFrame([(1, 1, True, "a"), (2, 1, True, "a")], "expnum int, detector int, hit boolean, reviewer string")
    with pytest.raises(Exception, match="nothing"):
        T.merge_reviews(inf, rev, ["expnum", "detector"], ["hit"]).collect()
    one = T.merge_reviews(inf, rev.where("expnum = 1"), ["expnum", "detector"], ["hit"])
    assert tuple(T.review_summary(one, ["hit"]).first()) == (1, 1)


def test_profile_reads_across_the_line(spark):
    line = P.components(px(spark, [(20, x) for x in range(5, 35)]))
    frame = spark.createDataFrame([(0, y, x, 100.0 if y == 20 else 10.0) for y in range(40) for x in range(40)], PX + ", v double")
    got = {r.offset: r.v for r in T.profile(line, frame, 3).collect()}
    assert got[0] == pytest.approx(100) and all(got[o] == pytest.approx(10) for o in (-3, -2, -1, 1, 2, 3))


def slanted(spark, length):
    """Lines at forty slopes, one to an image."""
    return P.components(spark.createDataFrame([(i, 30 + x * i // 40 + d, 10 + x) for i in range(40) for x in range(length) for d in (0, 1, 2)], PX))


def test_flat_profiles_are_flat_to_the_last_bit(spark):
    one = spark.createDataFrame([(99, 0, 0, 1.0)], PX + ", v double")
    prof = T.profile(slanted(spark, 8), one, 4, size=(120, 120), missing=20.3)
    assert [r.v for r in prof.select("v").distinct().collect()] == [20.3]
    got = T.profile_metrics(prof, 2)
    assert got.count() == 40 and got.where("peak <> 0 OR fwhm IS NOT NULL OR scatter <> 0").isEmpty()


def test_profiles_do_not_depend_on_the_order_of_rows(spark):
    line = slanted(spark, 60)
    frame = line.select("image_id", "y", "x", (F.pmod(F.xxhash64("image_id", "y", "x"), F.lit(1000)) / 7).alias("v"))
    a, b = ({tuple(r) for r in T.profile(line.repartition(n, F.rand(n)), frame.repartition(n, F.rand(n)), 3, size=(120, 120), missing=20.3).collect()} for n in (3, 7))
    assert len(a) == 280 and a == b


@pytest.mark.parametrize("missing", [20.3, None])
def test_profiles_do_not_depend_on_tiles(spark, monkeypatch, missing):
    monkeypatch.setattr(T, "ALONG", 8)
    line = slanted(spark, 60)
    frame = line.where("x % 9 > 0").select("image_id", "y", "x", (F.pmod(F.xxhash64("image_id", "y", "x"), F.lit(1000)) / 7).alias("v"))
    a, b, c = ({tuple(r) for r in T.profile(line, frame, 9, stride, size=(95, 64), missing=missing, tile=tile).collect()} for tile, stride in ((512, 1), (16, 1), (16, 3)))
    assert len(a) == (760 if missing else len({r[:3] for r in a})) and a == b and a != c
    pixel = {(r.image_id, r.y, r.x): r.v for r in frame.collect()}
    one = [(y, x) for i, y, x, _ in line.collect() if i == 17]
    (sy, sx), n = np.sum(one, 0), len(one)
    cov = np.cov(np.array(one).T)
    angle = np.arctan2(2 * cov[0, 1], cov[1, 1] - cov[0, 0]) / 2
    sin, cos, cy, cx = np.sin(angle), np.cos(angle), sy / n, sx / n
    low, high = np.percentile([(x - cx) * cos + (y - cy) * sin for y, x in one], [5, 95])
    for o in range(-9, 10):
        values = []
        for t in range(int(np.ceil(low)), int(np.floor(high)) + 1):
            y, x = np.clip(cy + t * sin + o * cos, 0, 94), np.clip(cx + t * cos - o * sin, 0, 63)
            at = [(min(94, int(y) + i), min(63, int(x) + j), (y % 1 if i else 1 - y % 1) * (x % 1 if j else 1 - x % 1)) for i in (0, 1) for j in (0, 1)]
            if missing or any((17, p, q) in pixel for p, q, _ in at):
                values.append(sum(w * pixel.get((17, p, q), missing or 0) for p, q, w in at))
        got = [r[3] for r in a if r[0] == 17 and r[2] == o]
        assert got == (pytest.approx([np.median(values)]) if values else [])


def test_points_of_profiles_are_not_shuffled(spark):
    line = px(spark, [(20, x) for x in range(5, 35)])
    frame = line.withColumn("v", F.lit(1.0))
    prof = T.profile(P.components(line), frame, 12, size=(64, 64), missing=20.0)
    metrics = T.profile_metrics(prof, 8)
    text = metrics._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "FlatMapCoGroupsInArrow" in text
    assert text.split("FlatMapCoGroupsInArrow")[0].count("Exchange") == 2  # of medians: by offset, by component
    assert prof.count() == 25


def test_reviews(spark):
    inf = spark.createDataFrame([(1, 1), (1, 2)], "expnum int, detector int")
    rev = lambda rows: spark.createDataFrame(rows, "expnum int, detector int, hit boolean, reviewer string")
    assert T.merge_reviews(inf, rev([(1, 1, True, "a"), (1, 2, False, "a")]), ["expnum", "detector"], ["hit"]).count() == 2
    for bad in ([(1, 1, True, "a")], [(1, 1, True, "a"), (1, 2, None, "a")], [(1, 1, True, " "), (1, 2, True, "a")], [(1, 1, True, "a"), (1, 1, True, "a"), (1, 2, True, "a")]):
        with pytest.raises(Exception, match="review|answer"):
            T.merge_reviews(inf, rev(bad), ["expnum", "detector"], ["hit"]).collect()


def test_stratified_sample_tops_up(spark):
    rows = [(i % 12, i, t) for i, t in enumerate(["faint"] * 2 + ["medium"] * 8 + ["bright"] * 8)]
    c = spark.createDataFrame(rows, "image_id int, component int, tier string")
    got = T.stratified_components(c, 12, 1, least_images=3)
    n = {r.tier: r["count"] for r in got.groupBy("tier").count().collect()}
    assert sum(n.values()) == 12 and n["faint"] == 2 and got.exceptAll(T.stratified_components(c.repartition(5), 12, 1, least_images=3)).count() == 0


def test_median_of_a_histogram(spark):
    h = spark.createDataFrame([(0, 2), (1, 4), (5, 2)], "bin int, n int")
    assert T.histogram_median(h).first().median == 1.5


def test_crops_stay_inside(spark):
    got = T.audit_crops([("a", px(spark, [(0, 0), (99, 99)])), ("b", px(spark, [(50, 50)]))], 20, 100, 100, 1).collect()
    assert sorted((r.y0, r.x0) for r in got) == [(0, 0), (40, 40), (80, 80)] and sorted(r.name for r in got) == ["crop_0001", "crop_0002", "crop_0003"]
    with pytest.raises(ValueError):
        P.crop_window(F.col("y"), F.col("x"), 10, 10, 20)


def test_runs_compared(spark):
    r = lambda rows: spark.createDataFrame(rows, "k int, v double")
    got = {x.k: (x.v_change, x.same) for x in T.compare_runs(r([(1, 1.0), (2, None)]), r([(1, 3.0), (2, None)]), ["k"], ["v"]).collect()}
    assert got == {1: (2.0, False), 2: (None, True)}
