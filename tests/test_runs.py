import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import labels as L
from quarrylane.operators import pixels as P
from quarrylane.operators import quantiles as Q
from quarrylane.operators import runs as R
from quarrylane.operators import shared
from quarrylane.sources import files as S_
from quarrylane.sources import png

PX = "image_id string, y int, x int"
SHAPE = (23, 31)


def px(spark, g, image="a"):
    return spark.createDataFrame([(image, int(y), int(x)) for y, x in zip(*np.nonzero(g))], PX).repartition(3)


def array(df):
    g = np.zeros(SHAPE, bool)
    for r in df.collect():
        assert not g[r.y, r.x]  # each pixel once
        g[r.y, r.x] = True
    return g


def masks(n=2, seed=0):
    rng = np.random.default_rng(seed)
    out = [rng.random(SHAPE) < 0.6 for _ in range(n)]
    for g in out:
        g[0, :9] = g[5:9, -3:] = g[-1, 4:20] = True
    return out


def grown(g, k, outside=False):
    """Pixels with a set pixel of the kernel, on a padded array."""
    r = max(k)
    p = np.pad(g, r, constant_values=outside)
    out = np.zeros_like(g)
    for dy, half in k.items():
        for dx in range(-half, half + 1):
            out |= p[r + dy : r + dy + g.shape[0], r + dx : r + dx + g.shape[1]]
    return out


def test_set_algebra(spark):
    a, b = masks()
    ra, rb = R.runs_of(px(spark, a)), R.runs_of(px(spark, b))
    for got, want in ((R.union(ra, rb), a | b), (R.intersection(ra, rb), a & b), (R.difference(ra, rb), a & ~b), (R.merged(ra), a)):
        assert (array(R.pixels_of(got)) == want).all()
        rows = sorted((r.y, r.x0, r.x1) for r in got.collect())
        assert all(p[0] != q[0] or p[2] + 1 < q[1] for p, q in zip(rows, rows[1:]))  # apart from one another
    assert R.union(ra, ra).count() == R.merged(ra).count()
    assert R.merged(R.runs_of(px(spark, a & False))).count() == 0


@pytest.mark.parametrize("shape", ["square", "disc", "ellipse"])
@pytest.mark.parametrize("radius", [0, 1, 3])
def test_morphology_on_runs(spark, shape, radius):
    g = masks(1, radius)[0]
    k = R.kernel(radius, shape)
    assert sorted((dy, dx) for dy, half in k.items() for dx in range(-half, half + 1)) == sorted(P.offsets(radius, shape))
    assert (array(P.dilate(px(spark, g), radius, *SHAPE, shape)) == grown(g, k)).all()
    for outside in (True, False):
        assert (array(P.erode(px(spark, g), radius, *SHAPE, shape, outside)) == ~grown(~g, k, not outside)).all()


def test_scores_on_runs(spark):
    a, b = masks(2, 5)
    a, b = a & (np.arange(31) % 3 > 0), b & (np.arange(23) % 4 > 0)[:, None]
    pa, pb = px(spark, a), px(spark, b)
    for r in P.tolerant_counts(pa, pb, [0, 1, 3], *SHAPE).collect():
        na, nb = (grown(g, R.kernel(r.tolerance)) for g in (a, b))
        assert (r.ptp, r.fp, r.rtp, r.fn) == ((a & nb).sum(), (a & ~nb).sum(), (b & na).sum(), (b & ~na).sum())
    edge = [g & grown(~g, R.kernel(1), True) for g in (a, b)]
    for r in P.surface_counts(pa, pb, [1, 2], *SHAPE).collect():
        near = sum((x & grown(y, R.kernel(r.tau, "disc"))).sum() for x, y in (edge, edge[::-1]))
        assert (r.near, r.n) == (near, edge[0].sum() + edge[1].sum())
    sizes = {r.stratum: r.n for r in P.distance_strata(pa, pb, 1, 2).collect()}
    near, far = (grown(b, R.kernel(k, "disc")) for k in (1, 2))
    want = {"near": (a & ~b & near).sum(), "ambiguous": (a & ~b & far & ~near).sum(), "far": (a & ~b & ~far).sum()}
    assert sizes == {k: v for k, v in want.items() if v}
    swept = {r.radius: r for r in P.label_sweep(pa, pb, [-1, 0, 2], *SHAPE).collect()}
    for k, t in ((-1, ~grown(~b, R.kernel(1, "ellipse"))), (0, b), (2, grown(b, R.kernel(2, "ellipse")))):
        assert swept[k].precision == pytest.approx((a & t).sum() / a.sum()) and swept[k].recall == pytest.approx((a & t).sum() / t.sum())


def spiral(n):
    g = np.zeros((n, n), bool)
    a, b, c, d = 0, 0, n - 1, n - 1
    while a <= c and b <= d:
        g[a, max(0, b - 2) : d + 1] = g[a : c + 1, d] = g[c, b : d + 1] = True
        g[a + 2 : c + 1, b] = True
        a, b, c, d = a + 2, b + 2, c - 2, d - 2
    return g


def flooded(g, connectivity):
    """Labels in raster order of first pixels."""
    out = np.zeros(g.shape, int)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not (a and b))]
    for y, x in zip(*np.nonzero(g)):
        if not out[y, x]:
            todo, label = [(y, x)], out.max() + 1
            out[y, x] = label
            while todo:
                y, x = todo.pop()
                for a, b in steps:
                    if 0 <= y + a < g.shape[0] and 0 <= x + b < g.shape[1] and g[y + a, x + b] and not out[y + a, x + b]:
                        out[y + a, x + b] = label
                        todo.append((y + a, x + b))
    return out


@pytest.mark.parametrize("connectivity, tile", [(4, 5), (8, 5), (8, 16), (4, 512)])
def test_components_across_tiles(spark, connectivity, tile):
    rng = np.random.default_rng(tile)
    comb = np.zeros((40, 40), bool)
    comb[:, ::2], comb[-1] = True, True
    grids = {"spiral": spiral(40), "comb": comb, "noise": rng.random((40, 40)) < 0.42, "checks": np.indices((40, 40)).sum(0) % 2 == 0}
    rows = [(n, int(y), int(x)) for n, g in grids.items() for y, x in zip(*np.nonzero(g))]
    got = {n: np.zeros((40, 40), int) for n in grids}
    for r in P.components(spark.createDataFrame(rows + rows[:50], PX), connectivity, tile).collect():
        assert not got[r.image_id][r.y, r.x]
        got[r.image_id][r.y, r.x] = r.component
    for n, g in grids.items():
        assert (got[n] == flooded(g, connectivity)).all()


@pytest.mark.parametrize("band", [3, 64])
def test_nearest_equals_brute_force(spark, band):
    rng = np.random.default_rng(band)
    q = {(int(i), int(y), int(x)) for i, y, x in zip(rng.integers(0, 3, 300), rng.integers(0, 500, 300), rng.integers(0, 700, 300))}
    t = {(int(i), int(y), int(x)) for i, y, x in zip(rng.integers(0, 2, 80), rng.integers(100, 400, 80), rng.integers(0, 700, 80))} | {(0, 250, x) for x in range(300, 360)} | {(1, y, 9) for y in range(40, 90)}
    kind = "image_id int, y int, x int"
    got = {(r.image_id, r.y, r.x): r.d2 for r in L.nearest(spark.createDataFrame(sorted(q), kind), spark.createDataFrame(sorted(t), kind), band).collect()}
    assert got == {(i, y, x): min((y - a) ** 2 + (x - b) ** 2 for j, a, b in t if j == i) for i, y, x in q if i < 2}


def test_lowest_parabolas():
    rng = np.random.default_rng(2)
    columns, height2 = np.sort(rng.choice(400, 60, False)), rng.integers(0, 900, 60) ** 2
    at = np.arange(0, 400, 3)
    assert (L.row_nearest(at, columns, height2) == ((at[:, None] - columns) ** 2 + height2).min(1)).all()


def write_png(path, g, kinds=None):
    """A PNG with the given filter of each row (0 to 4, by turns without)."""
    g = g if g.ndim == 3 else g[:, :, None]
    h, w, n = g.shape
    flat = np.zeros((h + 1, (w + 1) * n), int)
    flat[1:, n:] = g.reshape(h, -1)
    raw = bytearray()
    for y in range(1, h + 1):
        k = kinds[y - 1] if kinds else y % 5
        x, a, b, c = flat[y, n:], flat[y, :-n], flat[y - 1, n:], flat[y - 1, :-n]
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        raw += bytes([k]) + ((x - [0, a, b, (a + b) // 2, paeth][k]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(bytes(raw))
    colour = {1: 0, 3: 2, 2: 4, 4: 6}[n]
    path.write_bytes(png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"x\0y") + chunk(b"IDAT", data[: len(data) // 2]) + chunk(b"IDAT", data[len(data) // 2 :]) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(7)
    frames = {n: rng.integers(0, 256, s, dtype=np.uint8) for n, s in (("a", (37, 50)), ("b", (20, 64)))}
    masks_ = {n: (rng.random(g.shape) < 0.1).astype(np.uint8) * 200 for n, g in frames.items()}
    for n in frames:
        write_png(tmp_path / f"{n}_red.fits_full.png", frames[n])
        write_png(tmp_path / f"{n}_red_mask.png", masks_[n])
    return tmp_path, frames, masks_


def whole(strips):
    out = {}
    for r in sorted(strips.collect(), key=lambda r: (r.path, r.y0)):
        n = r.path.rsplit("/", 1)[1].split("_")[0]
        out.setdefault(n, []).append(np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.width))
    return {n: np.concatenate(v) for n, v in out.items()}


@pytest.mark.parametrize("rows", [1, 8, 500])
def test_strips_hold_the_frame(spark, folder, rows):
    back = whole(png.png_strips(spark, str(folder[0]), "*full.png", rows))
    assert all((back[n] == g).all() for n, g in folder[1].items())
    # The same bytes as the reader of whole images.
    for r in S_.images(spark, str(folder[0]), "*full.png").collect():
        n = r.path.rsplit("/", 1)[1].split("_")[0]
        assert bytes(r.data) == back[n].tobytes()
    assert {(r.height, r.width) for r in png.png_sizes(spark, str(folder[0]), "*.png").collect()} == {(37, 50), (20, 64)}
    assert {(r.y0, r.h) for r in png.png_strips(spark, str(folder[0]), "a*full.png", 8, 9, 17).collect()} == {(8, 8), (16, 8)}


def test_colours_filters_and_bad_files(tmp_path):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        g = rng.integers(0, 256, (11, 13, n), dtype=np.uint8)
        for kinds in ([0] * 11, [1, 2, 0] * 4, [4] * 11, [3, 4, 2, 1, 0] * 3):
            write_png(tmp_path / "x.png", g, kinds[:11])
            data = (tmp_path / "x.png").read_bytes()
            got = np.concatenate([px for _, px in png.strips_of(data, 4)])
            assert (got == (g[:, :, 0] if n < 3 else np.rint(g[:, :, :3] @ np.array([0.299, 0.587, 0.114])))).all()
    with pytest.raises(ValueError, match="missing"):
        list(png.strips_of(data[: len(data) // 2], 4))
    for bad in (b"GIF89a" + data, data[:24] + b"\x10" + data[25:]):
        with pytest.raises(ValueError):
            png.header(bad)


@pytest.mark.parametrize("rows, patch, stride", [(8, 8, 8), (5, 12, 7), (3, 40, 1)])
def test_patches_from_strips(spark, folder, rows, patch, stride):
    path, frames, masks_ = folder
    read = lambda end: png.png_strips(spark, str(path), end, rows)
    pairs = S_.pair_frames(png.png_sizes(spark, str(path), "*full.png"), png.png_sizes(spark, str(path), "*mask.png"), r"_red\.fits_full\.png", r"_red_mask\.png")
    got = {(r.image_id, r.y0, r.x0): r for r in png.training_patches(read("*full.png"), read("*mask.png"), pairs, patch, stride).collect()}
    want = {(n, y, x) for n, g in frames.items() for y in range(0, g.shape[0] - patch + 1, stride) for x in range(0, g.shape[1] - patch + 1, stride)}
    assert set(got) == want
    for (n, y, x), r in got.items():
        m = masks_[n][y : y + patch, x : x + patch]
        assert bytes(r.pixels) == frames[n][y : y + patch, x : x + patch].tobytes() and bytes(r["mask"]) == ((m > 0) * np.uint8(255)).tobytes() and r.positive_pixels == (m > 0).sum()


@pytest.mark.parametrize("rows, size", [(8, 8), (5, 16), (64, 48), (3, 7)])
def test_padded_tiles_of_strips(spark, folder, rows, size):
    key = lambda r: (r.path.rsplit("/", 1)[1], r.height, r.width, r.y0, r.x0, r.h, r.w, bytes(r.data))
    want = sorted(key(r) for r in S_.padded_tiles(S_.images(spark, str(folder[0]), "*full.png"), size).collect())
    tiles = png.padded_strip_tiles(png.png_strips(spark, str(folder[0]), "*full.png", rows), size)
    assert sorted(key(r) for r in tiles.collect()) == want
    back = S_.scored_pixels(S_.score_tiles(tiles, lambda: lambda v: v)).where("path LIKE '%b_red%'").collect()
    assert len(back) == folder[1]["b"].size and all(abs(r.prob - 1 / (1 + np.exp(-float(folder[1]["b"][r.y, r.x]) / 255))) < 1e-6 for r in back)


def test_tiles_and_runs_of_strips(spark, folder):
    path, frames, masks_ = folder
    back = {(r.path.rsplit('/', 1)[1], r.ty, r.tx): np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w) for r in png.strip_tiles(png.png_strips(spark, str(path), "*full.png", 16), 16).collect()}
    assert len(back) == 3 * 4 + 2 * 4
    runs = R.pixels_of(png.strip_runs(png.png_strips(spark, str(path), "*mask.png", 7))).collect()
    for n, g in masks_.items():
        assert {(r.y, r.x) for r in runs if f"/{n}_" in r.image_id} == {(int(y), int(x)) for y, x in zip(*np.nonzero(g))}


def test_a_full_size_patch_is_cut(spark):
    images = spark.createDataFrame([("a", 528, 528), ("b", 600, 528)], "image_id string, height int, width int")
    frame = spark.range(528 * 528).select(F.lit("a").alias("image_id"), (F.col("id") / 528).cast("int").alias("y"), (F.col("id") % 528).cast("int").alias("x"), (F.col("id") % 251).cast("int").alias("v"))
    got = {r.image_id: r for r in P.cut_patches(images, frame, frame.where("v = 7"), 528, 528).collect()}
    v = np.arange(528 * 528) % 251
    assert bytes(got["a"].pixels) == v.astype(np.uint8).tobytes() and got["a"].positive_pixels == (v == 7).sum()
    assert not any(got["b"].pixels) and got["b"].positive_pixels == 0


def test_stored_tables_are_cleared(spark):
    shared.clear_stored(spark)
    t = shared.stored(spark.range(5))
    assert t.count() == 5 and shared.clear_stored(spark) == 1 and shared.clear_stored(spark) == 0


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-12, 12, 300), [0.0, -0.0, np.inf, -np.inf, 5e-324, -1e308], np.repeat(7.25, 50)])
    rows = [("a" if i % 3 else None, float(v), int(i) - 100, None if i % 2 else float(v)) for i, v in enumerate(values)] + [("b", 1.5, 3, None), ("a", float("nan"), None, None)]
    df = spark.createDataFrame(rows, "g string, v double, k int, half double").repartition(3)
    shares = [0.0, 0.05, 1 / 3, 0.5, 0.99, 1.0]
    got = {(r.g, r.column, r.share): r.value for r in Q.percentiles(df, ["v", "k", "half"], shares, ["g"]).collect()}
    want = {}
    for g in ("a", "b", None):
        for j, c in ((1, "v"), (2, "k"), (3, "half")):
            own = sorted(r[j] for r in rows if r[0] == g and r[j] is not None and r[j] == r[j])
            for s in shares if own else ():
                at = s * (len(own) - 1)
                low, high = own[int(np.floor(at))], own[int(np.ceil(at))]
                want[g, c, s] = low if low == high else low * (1 - at % 1) + high * (at % 1)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True) for k in want)
    two = {r.g: (r.m, r.top) for r in Q.percentile_columns(df, {"m": ("k", 0.5), "top": ("half", 1.0)}, ["g"]).collect()}
    assert two["b"] == (3.0, None) and two["a"][0] == want["a", "k", 0.5]
    assert Q.percentiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_percentiles_of_many_groups_meet_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_BROADCAST", 5)
    df = spark.range(400).select((F.col("id") % 20).alias("g"), (F.col("id") * 7 % 400).alias("v"))
    got = {r.g: r.value for r in Q.percentiles(df, ["v"], [0.25], ["g"]).collect()}
    assert got == {g: pytest.approx(np.percentile([i * 7 % 400 for i in range(g, 400, 20)], 25)) for g in range(20)}


@pytest.mark.parametrize("thetas", [180, 12])
def test_line_votes_equal_plain_counts(spark, thetas):
    from collections import Counter

    rng = np.random.default_rng(thetas)
    rows = [(str(i), int(y), int(x), float(p)) for i, y, x, p in zip(rng.integers(0, 4, 500), rng.integers(0, 300, 500), rng.integers(0, 200, 500), rng.random(500).round(1))]
    rows += [(f"many{i}", 70_000 + i, 90_000 - i, 0.5) for i in range(40)]  # many images far from the corner
    px_ = spark.createDataFrame(rows, PX + ", prob double").repartition(3)
    want, level = Counter(), Counter()
    angles = [(np.cos(np.radians(t * (180 / thetas))), np.sin(np.radians(t * (180 / thetas)))) for t in range(thetas)]
    for i, y, x, p in rows:
        for t, (c, s) in enumerate(angles):
            line = (i, t, int(np.rint(x * c + y * s)))
            want[line] += 1
            level[line] += p >= 0.5
    got = {(r.image_id, r.theta, r.rho): r.votes for r in P.line_votes(px_, 2, thetas).collect()}
    assert got == {k: n for k, n in want.items() if n >= 2}
    two = {(r.image_id, r.theta, r.rho): list(r.votes) for r in P.line_points(px_, 2, thetas, [0.0, 0.5]).select("image_id", "theta", "rho", "votes").distinct().collect()}
    assert two == {k: [n, level[k]] for k, n in want.items() if n >= 2}
