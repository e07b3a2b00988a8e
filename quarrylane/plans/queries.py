"""The registered queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import metrics as M
from ..operators import pixels as P
from ..operators import studies as S
from ..operators import streaks as T
from ..operators.kernels import centreline_dice, component_widths
from ..sources import files
from .views import FRAME, hash_sql, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, views: tuple[str, ...], sql: str | None = None):
    """Registers a function of the views as a query, with its SQL over the same views."""

    def keep(make):
        QUERIES[name] = lambda spark, sf: rounded(make(*[view(spark, sf, v) for v in views]))
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return make

    return keep


def q0(a: str, b: str) -> str:
    """A ratio that is 0 without a denominator, to 6 places."""
    return f"round(CASE WHEN ({b}) = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"


def eight(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    return f"""{q0(tp, f'{tp}+{fp}')} AS precision, {q0(tp, f'{tp}+{fn}')} AS recall, {q0(f'2*{tp}', f'2*{tp}+{fp}+{fn}')} AS f1, {q0(f'2*{tp}', f'2*{tp}+{fp}+{fn}')} AS dice,
        {q0(tp, f'{tp}+{fp}+{fn}')} AS iou, {q0(f'{tp}+{tn}', f'{tp}+{tn}+{fp}+{fn}')} AS accuracy, {q0(tn, f'{tn}+{fp}')} AS specificity, {q0(f'{tp}+{fn}', f'{tp}+{tn}+{fp}+{fn}')} AS positive_fraction"""


CONFUSION = "count(*) FILTER (prob >= 5e-1 AND target) AS tp, count(*) FILTER (prob >= 5e-1 AND NOT target) AS fp, count(*) FILTER (prob < 5e-1 AND NOT target) AS tn, count(*) FILTER (prob < 5e-1 AND target) AS fn"
SWEEP = f"""h AS (SELECT greatest(4, least(95, CAST(floor(round(prob * 100, 9)) AS INT))) AS bin, target FROM v_scored),
    curve AS (SELECT t / 100 AS threshold, count(*) FILTER (bin >= t AND target) AS tp, count(*) FILTER (bin >= t AND NOT target) AS fp, count(*) FILTER (bin < t AND NOT target) AS tn, count(*) FILTER (bin < t AND target) AS fn
        FROM h, (SELECT unnest(range(5, 96)) AS t) g GROUP BY t),
    m AS (SELECT threshold, tp, fp, tn, fn, {q0('tp', 'tp+fp')} AS precision, {q0('tp', 'tp+fn')} AS recall, CASE WHEN 2*tp+fp+fn = 0 THEN 0e0 ELSE 2e0*tp/(2*tp+fp+fn) END AS f FROM curve)"""


def sweep_sql(tail: str) -> str:
    return ", " + SWEEP + " " + tail


@query("threshold_sweep", ("v_scored",), sweep_sql("SELECT threshold, tp, fp, tn, fn, precision, recall, round(f, 6) AS f1 FROM m"))
def _(s):
    return M.sweep(s)


@query("best_threshold_metrics", ("v_scored",), sweep_sql("SELECT threshold, tp, fp, tn, fn, precision, recall, round(f, 6) AS f1 FROM m ORDER BY f DESC, threshold LIMIT 1"))
def _(s):
    return M.best_threshold(M.sweep(s))


@query("pareto_front", ("v_scored",), sweep_sql(", w AS (SELECT *, max(precision) OVER (ORDER BY recall DESC, threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m) SELECT threshold, tp, fp, tn, fn, precision, recall, round(f, 6) AS f1 FROM w WHERE best IS NULL OR precision >= best"))
def _(s):
    return M.pareto_front(rounded(M.sweep(s)))


@query("operating_points", ("v_scored",), sweep_sql("SELECT (SELECT threshold FROM m ORDER BY round(f, 6) DESC, threshold DESC LIMIT 1) AS best_f1, (SELECT max(threshold) FROM m WHERE recall >= 0.8) AS target_recall"))
def _(s):
    return M.operating_points(rounded(M.sweep(s)), 0.8)


@query("confusion_per_image", ("v_scored",), f", c AS (SELECT image_id, {CONFUSION} FROM v_scored GROUP BY image_id) SELECT *, {eight()} FROM c")
def _(s):
    return M.metrics(M.dense_counts(s, ["image_id"]))


@query("confusion_second_model", ("v_scored",), f", c AS (SELECT {CONFUSION.replace('prob', 'prob2')} FROM v_scored) SELECT *, {eight()} FROM c")
def _(s):
    return M.metrics(M.dense_counts(s, [], prob="prob2"))


@query("combined_counts", ("v_scored",), f"SELECT image_id, patch_id, {CONFUSION}, CAST(2 - grouping(image_id) - grouping(patch_id) AS INT) AS level FROM v_scored GROUP BY ROLLUP (image_id, patch_id)")
def _(s):
    return M.combine(M.dense_counts(s, ["image_id", "patch_id"]), "image_id", "patch_id")


@query(
    "patch_losses", ("v_scored",),
    """, c AS (SELECT patch_id, CASE WHEN target THEN 1e0 ELSE 0e0 END AS t, prob, greatest(1e-7, least(1 - 1e-7, prob)) AS p FROM v_scored),
    d AS (SELECT patch_id, -avg(t * ln(p) + (1 - t) * ln(1 - p)) AS bce, 1 - (2 * sum(prob * t) + 1e-4) / (sum(prob * prob) + sum(t) + 1e-4) AS dice_loss FROM c GROUP BY patch_id)
    SELECT patch_id, round(bce, 6) AS bce, round(dice_loss, 6) AS dice_loss, round(5e-1 * bce + 5e-1 * dice_loss, 6) AS loss FROM d""",
)
def _(s):
    return M.patch_losses(s, ["patch_id"])


@query("roc_auc", ("v_scored",), """, g AS (SELECT prob, count(*) FILTER (target) AS p, count(*) FILTER (NOT target) AS n FROM v_scored GROUP BY prob),
    b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT round(CAST(sum(p * (below + n / 2)) AS DOUBLE) / (sum(p) * sum(n)), 6) AS auc FROM b""")
def _(s):
    return M.roc_auc(s)


@query("ks_statistic", ("v_scored",), """, g AS (SELECT prob, count(*) FILTER (target) AS a, count(*) FILTER (NOT target) AS b FROM v_scored GROUP BY prob),
    w AS (SELECT sum(a) OVER o / sum(a) OVER () AS fa, sum(b) OVER o / sum(b) OVER () AS fb FROM g WINDOW o AS (ORDER BY prob ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(fa - fb)), 6) AS ks FROM w""")
def _(s):
    return M.ks_statistic(s.where("target"), s.where("NOT target"), "prob")


@query("class_weight", ("v_scored",), "SELECT round(CAST(count(*) FILTER (NOT t) AS DOUBLE) / count(*) FILTER (t), 6) AS weight FROM (SELECT patch_id, bool_or(target AND prob > 9e-1) AS t FROM v_scored GROUP BY patch_id)")
def _(s):
    return M.class_weight(s.groupBy("patch_id").agg(F.bool_or(F.col("target") & (F.col("prob") > 0.9)).alias("target")))


@query("patch_records", ("v_scored",), f"SELECT image_id, patch_id, {q0('2 * count(*) FILTER (prob >= 5e-1 AND target)', 'count(*) FILTER (prob >= 5e-1) + count(*) FILTER (target)')} AS dice, round(avg(prob), 6) AS mean_probability, count(*) FILTER (target) > 0 AS is_positive, round(count(*) FILTER (prob >= 5e-1) / count(*), 6) AS predicted_fraction FROM v_scored GROUP BY image_id, patch_id")
def _(s):
    return M.patch_records(s)


@query(
    "fp_decomposition", ("v_scored",),
    f""", p AS (SELECT patch_id, count(*) FILTER (prob >= 5e-1 AND NOT target) AS fp, bool_or(target AND prob > 8e-1) AS pos FROM v_scored GROUP BY patch_id),
    c AS (SELECT CAST(sum(CASE WHEN pos THEN 0 ELSE fp END) AS BIGINT) AS a, CAST(sum(CASE WHEN pos THEN fp ELSE 0 END) AS BIGINT) AS b, count(*) FILTER (NOT pos) AS e, count(*) FILTER (NOT pos AND fp > 0) AS f FROM p)
    SELECT a AS inter_patch_fp, b AS intra_patch_fp, {q0('a', 'a + b')} AS inter_fraction, {q0('f', 'e')} AS empty_fp_rate, CASE WHEN a + b = 0 THEN 'insufficient-data' WHEN a >= 5e-1 * (a + b) THEN 'gate-favourable' ELSE 'gate-limited' END AS label FROM c""",
)
def _(s):
    marked = s.groupBy("patch_id").agg(F.bool_or(F.col("target") & (F.col("prob") > 0.8)).alias("is_positive"))
    return M.fp_decomposition(s, positive=marked)


G6 = lambda a, b: f"round(CAST({a} AS DOUBLE) / greatest({b}, 1), 6)"


@query(
    "two_stage_metrics", ("v_scored",),
    f""", p AS (SELECT patch_id, avg(gate) >= 5e-1 AS g, bool_or(target) AS pos, {CONFUSION} FROM v_scored GROUP BY patch_id),
    c AS (SELECT count(*) FILTER (g AND pos) AS gtp, count(*) FILTER (g AND NOT pos) AS gfp, count(*) FILTER (NOT g AND pos) AS gfn, count(*) FILTER (g) AS routed, count(*) AS n,
        sum(CASE WHEN g THEN tp ELSE 0 END) AS tp, sum(CASE WHEN g THEN fp ELSE 0 END) AS fp, sum(CASE WHEN g THEN fn ELSE 0 END) AS fn, sum(CASE WHEN g THEN 0 ELSE tp + fn END) AS lost FROM p)
    SELECT {G6('gtp', 'gtp + gfp')} AS gate_precision, {G6('gtp', 'gtp + gfn')} AS gate_recall, {G6('2 * gtp', '2 * gtp + gfp + gfn')} AS gate_f1, {G6('gfn', 'gtp + gfn')} AS gate_fnr, {G6('tp', 'tp + fp')} AS precision,
        {G6('tp', 'tp + fn')} AS routed_recall, {G6('tp', 'tp + fn + lost')} AS recall, {G6('2 * tp', '2 * tp + fp + fn + lost')} AS dice, {G6('routed', 'n')} AS routed_fraction FROM c""",
)
def _(s):
    return M.two_stage(s, 0.5, 0.5)


@query(
    "joint_sweep", ("v_scored",),
    f""", g AS (SELECT patch_id, round(avg(gate) * 100, 6) AS gate FROM v_scored GROUP BY patch_id),
    s AS (SELECT g.gate, round(prob * 100, 6) AS prob, target FROM v_scored JOIN g USING (patch_id)),
    c AS (SELECT a, t, count(*) FILTER (gate >= a AND s.prob >= t AND target) AS tp, count(*) FILTER (gate >= a AND s.prob >= t AND NOT target) AS fp, count(*) FILTER (target) AS p
        FROM s, (SELECT unnest(range(5, 96, 5)) AS a) x, (SELECT unnest(range(10, 91, 5)) AS t) y GROUP BY a, t)
    SELECT a / 100 AS gate, t / 100 AS threshold, {q0('tp', 'tp + fp')} AS precision, {q0('tp', 'p')} AS recall, {q0('2 * tp', 'tp + fp + p')} AS dice FROM c""",
)
def _(s):
    return M.joint_sweep(s)


#: Few patches have no target at all; here a target counts where its score is over 0.96.
STRICT = "target AND prob > 96e-2"


def _strict(s):
    return s.withColumn("target", F.col("target") & (F.col("prob") > 0.96))


@query("hard_negatives", ("v_scored",), f"SELECT image_id, patch_id, count(*) FILTER (prob >= 5e-1) AS fp_pixels, round(avg(prob), 6) AS mean_probability FROM v_scored GROUP BY image_id, patch_id HAVING NOT bool_or({STRICT}) AND count(*) FILTER (prob >= 5e-1) > 0 ORDER BY fp_pixels DESC, avg(prob) DESC, patch_id LIMIT 20")
def _(s):
    return M.hard_negatives(_strict(s), 20)


@query("fired_patches", ("v_scored",), f"SELECT image_id, patch_id, round(max(prob), 6) AS peak, max(prob) >= 98e-2 AS fired FROM v_scored GROUP BY image_id, patch_id HAVING NOT bool_or({STRICT}) AND (max(prob) >= 98e-2 OR max(prob) < 9e-1)")
def _(s):
    return M.fired_patches(_strict(s), 0.98, 0.9)


@query("tuned_threshold", ("v_scored",), f""", h AS (SELECT greatest(4, least(95, CAST(floor(round(prob * 100, 9)) AS INT))) AS bin, target, gate < 5e-1 AS val FROM v_scored),
    c AS (SELECT t, count(*) FILTER (bin >= t AND target) AS tp, count(*) FILTER (bin >= t AND NOT target) AS fp, count(*) FILTER (bin < t AND target) AS fn FROM h, (SELECT unnest(range(5, 96)) AS t) g WHERE val GROUP BY t),
    b AS (SELECT t, 2e0 * tp / (2 * tp + fp + fn) AS f FROM c ORDER BY f DESC, t LIMIT 1),
    s AS (SELECT t / 100 AS threshold, round(f, 6) AS chosen_f1, count(*) FILTER (bin >= t AND target) AS tp, count(*) FILTER (bin >= t AND NOT target) AS fp, count(*) FILTER (bin < t AND NOT target) AS tn, count(*) FILTER (bin < t AND target) AS fn FROM h, b WHERE NOT val GROUP BY ALL) SELECT *, {eight()} FROM s""")
def _(s):
    return M.tuned_scores(s, F.col("gate") < 0.5, F.col("gate") >= 0.5)


@query("view_mean", ("v_prob_px",), f", v AS (SELECT image_id, {FRAME - 1} - y AS y, {FRAME - 1} - x AS x, prob / 2 AS prob FROM v_prob_px UNION ALL SELECT * FROM v_prob_px) SELECT image_id, y, x, round(avg(prob), 6) AS prob FROM v GROUP BY ALL")
def _(p):
    two = p.withColumn("prob", F.col("prob") / 2).withColumn("view", F.lit("turned")).unionByName(p.withColumn("view", F.lit("as_is")))
    return M.view_mean(two.withColumn("normalisation", F.lit("fixed")), FRAME, FRAME)


@query("frame_summary", ("v_scored",), "SELECT image_id, count(*) FILTER (prob >= 5e-1) AS predicted, round(count(*) FILTER (prob >= 5e-1) / count(*), 6) AS fraction, round(avg(prob), 6) AS mean_probability, round(max(prob), 6) AS max_probability FROM v_scored GROUP BY image_id")
def _(s):
    return M.frame_summary(s)


@query("ensemble_mean", ("v_scored",), f", e AS (SELECT image_id, (prob + prob2) / 2 AS prob, target FROM v_scored), c AS (SELECT image_id, {CONFUSION} FROM e GROUP BY image_id) SELECT *, {eight()} FROM c")
def _(s):
    return M.metrics(M.dense_counts(M.ensemble_mean(s, ["prob", "prob2"]), ["image_id"]))


@query("prob_histogram", ("v_scored",), ", e AS (SELECT min(prob) AS a, max(prob) AS b FROM v_scored), h AS (SELECT CAST(least(19, floor((prob - a) / ((b - a) / 20))) AS INT) AS bin, a, (b - a) / 20 AS w FROM v_scored, e) SELECT bin, round(any_value(a + bin * w), 6) AS lo, round(any_value(a + (bin + 1) * w), 6) AS hi, count(*) AS n FROM h GROUP BY bin")
def _(s):
    return M.equal_width_histogram(s, "prob", 20)


# Pixel sets.
BOTH = ("v_pred_px", "v_gt_px")
AREA = FRAME * FRAME


def grown(src: str, steps: str, clip: bool = True) -> str:
    inside = f"WHERE y + dy BETWEEN 0 AND {FRAME - 1} AND x + dx BETWEEN 0 AND {FRAME - 1}" if clip else ""
    return f"SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM {src}, ({steps}) {inside}"


def box(r: int) -> str:
    return f"SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range({-r}, {r + 1})) AS d) a, (SELECT unnest(range({-r}, {r + 1})) AS d) b"


def disc(r: int) -> str:
    return f"SELECT dy, dx FROM ({box(r)}) WHERE dy * dy + dx * dx <= {r * r}"


def offset_list(steps: list[tuple[int, int]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in steps) + ") v(dy, dx)"


FLAGS = f", f AS (SELECT image_id, y, x, max(p) AS p, max(t) AS t FROM (SELECT *, 1 AS p, 0 AS t FROM v_pred_px UNION ALL SELECT *, 0, 1 FROM v_gt_px) GROUP BY image_id, y, x), c AS (SELECT image_id, sum(p * t)::BIGINT AS tp, sum(p * (1 - t))::BIGINT AS fp, ({AREA} - count(*))::BIGINT AS tn, sum((1 - p) * t)::BIGINT AS fn FROM f GROUP BY image_id)"


@query("sparse_confusion", BOTH, FLAGS + f" SELECT *, {eight()} FROM c")
def _(p, t):
    return M.metrics(M.sparse_counts(p, t, AREA))


@query("pixel_union", BOTH, "SELECT image_id, count(*) AS n, sum(y * 1000 + x)::BIGINT AS mark FROM (SELECT * FROM v_pred_px UNION SELECT * FROM v_gt_px) GROUP BY image_id")
def _(p, t):
    return P.union(p, t).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("y") * 1000 + F.col("x")).alias("mark"))


@query("dilated_mask", ("v_gt_px",), f"SELECT image_id, count(*) AS n, sum(y * 1000 + x)::BIGINT AS mark FROM ({grown('v_gt_px', box(2))}) GROUP BY image_id")
def _(t):
    return P.dilate(t, 2, FRAME, FRAME).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("y") * 1000 + F.col("x")).alias("mark"))


BOUNDARY = lambda src: f"SELECT * FROM {src} EXCEPT SELECT image_id, y, x FROM (SELECT image_id, y + dy AS y, x + dx AS x FROM {src}, ({box(1)})) GROUP BY ALL HAVING count(*) = 9"


@query("mask_boundary", ("v_gt_px",), f"SELECT image_id, y, x FROM ({BOUNDARY('v_gt_px')})")
def _(t):
    return P.boundary(t, FRAME, FRAME)


def _tolerant(k: int) -> str:
    one = lambda a, b: f"SELECT count(*) FILTER (n.y IS NOT NULL) AS hit, count(*) FILTER (n.y IS NULL) AS miss FROM {a} a LEFT JOIN ({grown(b, box(k))}) n ON a.image_id = n.image_id AND a.y = n.y AND a.x = n.x"
    p, r = "CAST(p.hit AS DOUBLE) / (p.hit + p.miss)", "CAST(r.hit AS DOUBLE) / (r.hit + r.miss)"
    return f"SELECT {k} AS tolerance, round({p}, 6) AS precision, round({r}, 6) AS recall, {q0(f'2 * ({p}) * ({r})', f'({p}) + ({r})')} AS f1 FROM ({one('v_pred_px', 'v_gt_px')}) p, ({one('v_gt_px', 'v_pred_px')}) r"


@query("boundary_tolerant_metrics", BOTH, " UNION ALL ".join(_tolerant(k) for k in range(4)))
def _(p, t):
    return P.tolerant_metrics(P.tolerant_counts(p, t, [0, 1, 2, 3], FRAME, FRAME))


def _surface(tau: int) -> str:
    side = lambda a, b: f"SELECT a.image_id, count(*) AS n, count(n.y) AS near FROM {a} a LEFT JOIN ({grown(b, disc(tau), False)}) n ON a.image_id = n.image_id AND a.y = n.y AND a.x = n.x GROUP BY a.image_id"
    return f"SELECT image_id, {tau} AS tau, sum(near)::BIGINT AS near, sum(n)::BIGINT AS n, round(CAST(sum(near) AS DOUBLE) / sum(n), 6) AS nsd FROM ({side('bp', 'bt')} UNION ALL {side('bt', 'bp')}) GROUP BY image_id"


@query("surface_distance", BOTH, f", bp AS ({BOUNDARY('v_pred_px')}), bt AS ({BOUNDARY('v_gt_px')}) {_surface(1)} UNION ALL {_surface(2)}")
def _(p, t):
    return P.surface_counts(p, t, [1, 2], FRAME, FRAME)


@query("surface_summary", BOTH, f", bp AS ({BOUNDARY('v_pred_px')}), bt AS ({BOUNDARY('v_gt_px')}), s AS ({_surface(1)} UNION ALL {_surface(2)}), p AS (SELECT DISTINCT image_id FROM v_pred_px), t AS (SELECT DISTINCT image_id FROM v_gt_px)"
    " SELECT tau, round(sum(near) / sum(n), 6) AS nsd_all, round(sum(near) FILTER (image_id IN (FROM t)) / sum(n) FILTER (image_id IN (FROM t)), 6) AS nsd_positive, (SELECT count(*) FROM p SEMI JOIN t USING (image_id)) AS scored, 0::BIGINT AS empty_both, (SELECT count(*) FROM p ANTI JOIN t USING (image_id)) AS empty_target, (SELECT count(*) FROM t ANTI JOIN p USING (image_id)) AS empty_prediction FROM s GROUP BY tau")  # fmt: skip
def _(p, t):
    return P.surface_summary(P.surface_counts(p, t, [1, 2], FRAME, FRAME), p, t, p.select("image_id").union(t.select("image_id")))


FP = ", fp AS (SELECT * FROM v_pred_px EXCEPT SELECT * FROM v_gt_px)"


@query("fp_distance_strata", BOTH, FP + f", a AS ({grown('v_gt_px', disc(2), False)}), b AS ({grown('v_gt_px', disc(5), False)}) SELECT image_id, CASE WHEN (image_id, y, x) IN (SELECT * FROM a) THEN 'near' WHEN (image_id, y, x) IN (SELECT * FROM b) THEN 'ambiguous' ELSE 'far' END AS stratum, count(*) AS n FROM fp GROUP BY ALL")
def _(p, t):
    return P.distance_strata(p, t, 2, 5)


NEAREST = FP + ", has AS (SELECT DISTINCT image_id FROM v_gt_px), near AS (SELECT fp.image_id, fp.y, fp.x, CAST(min((fp.y - t.y) * (fp.y - t.y) + (fp.x - t.x) * (fp.x - t.x)) AS BIGINT) AS d2, count(t.y) > 0 AS has_target FROM fp LEFT JOIN v_gt_px t ON fp.image_id = t.image_id GROUP BY ALL)"


@query("fp_nearest_distance", BOTH, NEAREST + " SELECT * FROM near")
def _(p, t):
    return P.fp_distances(p, t)


@query("fp_distance_summary", BOTH, NEAREST + f""", h AS (SELECT CAST(least(49, floor(sqrt(d2))) AS INT) AS bin, count(*) AS n FROM near WHERE d2 <= 2500 GROUP BY ALL), w AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS c, (SELECT sum(n) FROM h) / 2 AS half FROM h)
    SELECT count(*) FILTER (has_target) AS with_target, count(*) FILTER (NOT has_target) AS without_target, {", ".join(f"round(count(*) FILTER (d2 <= {k * k}) / count(*) FILTER (has_target), 6) AS within_{k}, round(count(*) FILTER (d2 <= {k * k}) / count(*), 6) AS within_{k}_of_all" for k in (1, 2, 3))},
    count(*) FILTER (d2 > 2500) AS overflow, (SELECT round(arg_min(bin + (half - (c - n)) / n, bin), 6) FROM w WHERE c >= half) AS median FROM near""")
def _(p, t):
    return P.fp_distance_summary(P.fp_distances(p, t))


@query("recovered_pixels", ("v_prob_px", "v_gt_px"), "SELECT p.image_id, count(*) AS n FROM v_prob_px p SEMI JOIN v_gt_px t ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.x WHERE prob >= 3e-1 AND prob < 5e-1 GROUP BY p.image_id")
def _(p, t):
    return P.recovered(p.where("prob >= 0.3"), p.where("prob >= 0.5"), t).groupBy("image_id").agg(F.count("*").alias("n"))


@query("label_sweep", BOTH, " UNION ALL ".join(
    f"SELECT {r} AS radius, {q0('k', 'np')} AS precision, {q0('k', 'nt')} AS recall, {q0('2 * k', 'np + nt')} AS dice FROM (SELECT count(*) AS nt, count(p.y) AS k FROM ({src}) t LEFT JOIN v_pred_px p ON t.image_id = p.image_id AND t.y = p.y AND t.x = p.x), (SELECT count(*) AS np FROM v_pred_px)"
    for r, src in ((0, "SELECT * FROM v_gt_px"), (1, grown("v_gt_px", offset_list(P.offsets(1, "ellipse")))), (2, grown("v_gt_px", offset_list(P.offsets(2, "ellipse")))))
))
def _(p, t):
    return P.label_sweep(p, t, [0, 1, 2], FRAME, FRAME)


STATS = f", g AS (SELECT image_id, gy::INT AS grid_y, gx::INT AS grid_x, CAST(gy * 16 AS INT) AS y, CAST(gx * 16 AS INT) AS x FROM (SELECT DISTINCT image_id FROM v_gt_px), (SELECT unnest(range(11)) AS gy), (SELECT unnest(range(11)) AS gx)), st AS (SELECT g.image_id, g.grid_y, g.y, g.grid_x, g.x, count(t.y) AS positive_pixels FROM g LEFT JOIN v_gt_px t ON t.image_id = g.image_id AND t.y >= g.y AND t.y < g.y + 32 AND t.x >= g.x AND t.x < g.x + 32 GROUP BY ALL)"


def _stats(t):
    return P.patch_statistics(t.select("image_id").distinct().withColumns({"height": F.lit(FRAME), "width": F.lit(FRAME)}), t, 32, 16)


@query("patch_statistics", ("v_gt_px",), STATS + " SELECT *, round(positive_pixels / 1024, 6) AS positive_pixel_fraction, positive_pixels = 0 AS is_empty FROM st")
def _(t):
    return _stats(t)


@query("patch_summary_by_image", ("v_gt_px",), STATS + " SELECT image_id, count(*) AS patches, count(*) FILTER (positive_pixels = 0) AS empty, round(count(*) FILTER (positive_pixels = 0) / count(*), 6) AS empty_fraction, sum(positive_pixels)::BIGINT AS positive_pixels, round(avg(positive_pixels / 1024), 6) AS mean_fraction FROM st GROUP BY image_id")
def _(t):
    return P.summarise_patches(_stats(t), "image_id")


@query("image_patch_summary", ("v_gt_px", "v_frame_px"), STATS + ", i AS (SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean FROM v_frame_px GROUP BY image_id), k AS (SELECT image_id, count(*) FILTER (positive_pixels > 0) AS non_empty_patches FROM st GROUP BY image_id) SELECT i.image_id, n, mean, non_empty_patches FROM i LEFT JOIN k ON i.image_id = k.image_id")
def _(t, f):
    return D.image_patch_summary(D.image_statistics(f).select("image_id", "n", "mean"), _stats(t))


@query("patch_lists", ("v_gt_px",), STATS + " SELECT CASE WHEN image_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, positive_pixels > 0 AS is_positive, count(*) AS n FROM st GROUP BY ALL")
def _(t):
    splits = t.select("image_id").distinct().withColumn("split", F.when(F.col("image_id") % 2 == 0, "train").otherwise("val"))
    return D.patch_lists(_stats(t), splits).groupBy("split", "is_positive").agg(F.count("*").alias("n"))


@query("density_map", ("v_gt_px",), STATS + " SELECT image_id, grid_y, " + ", ".join(f'round(max(positive_pixels / 1024) FILTER (grid_x = {i}), 6) AS "{i}"' for i in range(11)) + " FROM st GROUP BY image_id, grid_y")
def _(t):
    return P.density_map(_stats(t), 11)


@query("cut_patches", ("v_pred_px", "v_gt_px"), """, g AS (SELECT image_id, gy * 64 AS y0, gx * 64 AS x0 FROM (SELECT DISTINCT image_id FROM v_gt_px), (SELECT unnest(range(2)) AS gy), (SELECT unnest(range(2)) AS gx)),
    c AS (SELECT g.image_id, y0, x0, dy, dx, coalesce(f.y % 200, 0) AS v, t.y IS NOT NULL AS m FROM g CROSS JOIN (SELECT unnest(range(96)) AS dy) a CROSS JOIN (SELECT unnest(range(96)) AS dx) b LEFT JOIN v_pred_px f ON f.image_id = g.image_id AND f.y = y0 + dy AND f.x = x0 + dx LEFT JOIN v_gt_px t ON t.image_id = g.image_id AND t.y = y0 + dy AND t.x = x0 + dx)
    SELECT image_id, CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, string_agg(printf('%02X', v), '' ORDER BY dy, dx) AS pixels, string_agg(CASE WHEN m THEN 'FF' ELSE '00' END, '' ORDER BY dy, dx) AS mask, count(*) FILTER (m) AS positive_pixels FROM c GROUP BY image_id, y0, x0""")
def _(f, t):
    images = t.select("image_id").distinct().withColumns({"height": F.lit(FRAME), "width": F.lit(FRAME)})
    return P.cut_patches(images, f.withColumn("v", F.col("y") % 200), t, 96, 64).withColumns({"pixels": F.hex("pixels"), "mask": F.hex("mask")})


@query("stitched_canvas", ("v_prob_px",), "SELECT image_id, y, x, round(max(p), 6) AS prob FROM (SELECT image_id, y + dy AS y, x, prob / (1 + dy) AS p FROM v_prob_px, (SELECT unnest([0, 1]) AS dy)) WHERE y < 192 GROUP BY image_id, y, x")
def _(p):
    patches = p.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("y0"), F.lit(0).alias("x0"), "y", "x", "prob").withColumn("prob", F.col("prob") / (1 + F.col("y0")))
    return P.stitch(patches, FRAME, FRAME)


@query("support_region", ("v_pred_px", "v_gt_px"), ", c AS (SELECT DISTINCT image_id, y // 32 AS cy, x // 32 AS cx FROM v_gt_px) SELECT p.image_id, count(*) AS n FROM v_pred_px p SEMI JOIN c ON p.image_id = c.image_id AND p.y // 32 = cy AND p.x // 32 = cx GROUP BY p.image_id")
def _(p, t):
    cells = t.select("image_id", (F.floor(F.col("y") / 32) * 32).alias("y0"), (F.floor(F.col("x") / 32) * 32).alias("x0"))
    return P.within_support(p, cells, 32).groupBy("image_id").agg(F.count("*").alias("n"))


@query("crop_pixels", ("v_pred_px", "v_gt_px"), ", w AS (SELECT 'w' || image_id AS name, image_id, min(y) AS y0, min(x) AS x0 FROM v_gt_px GROUP BY image_id) SELECT name, p.image_id, p.y - y0 AS y, p.x - x0 AS x FROM v_pred_px p JOIN w ON p.image_id = w.image_id AND p.y >= y0 AND p.y < y0 + 50 AND p.x >= x0 AND p.x < x0 + 50")
def _(p, t):
    w = t.groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0")).withColumn("name", F.concat(F.lit("w"), F.col("image_id").cast("string")))
    return P.in_windows(p, w, 50)


@query("soft_target", ("v_gt_px",), f"SELECT g.image_id, g.y, g.x, CASE WHEN t.y IS NULL THEN 5e-1 ELSE 1e0 END AS value FROM ({grown('v_gt_px', box(1))}) g LEFT JOIN v_gt_px t ON g.image_id = t.image_id AND g.y = t.y AND g.x = t.x")
def _(t):
    return P.soft_target(t, 1, 0.5, FRAME, FRAME)


def components_sql(src: str, name: str) -> str:
    """CTEs that end in `name` (image_id, y, x, component): runs of pixels, joined to those they touch."""
    return f""", {name}_runs AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, y * 1000 + min(x) AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM {src}) i GROUP BY image_id, y, island),
    {name}_edges AS (SELECT a.image_id, a.run AS a, b.run AS b FROM {name}_runs a JOIN {name}_runs b ON a.image_id = b.image_id AND (b.y = a.y + 1 OR b.y = a.y - 1) AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
    {name}_reach AS (SELECT image_id, run AS a, run AS b FROM {name}_runs UNION SELECT r.image_id, r.a, e.b FROM {name}_reach r JOIN {name}_edges e ON r.image_id = e.image_id AND r.b = e.a),
    {name}_roots AS (SELECT image_id, a AS run, min(b) AS root FROM {name}_reach GROUP BY image_id, a),
    {name} AS (SELECT r.image_id, r.y, unnest(range(r.x0, r.x1 + 1)) AS x, CAST(dense_rank() OVER (PARTITION BY r.image_id ORDER BY root) AS INT) AS component FROM {name}_runs r JOIN {name}_roots o ON r.image_id = o.image_id AND r.run = o.run)"""


def shapes_sql(src: str, name: str, least: int = 1) -> str:
    return f""", {name}_c AS (SELECT image_id, component, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, coalesce(var_samp(y), 0) AS vy, coalesce(var_samp(x), 0) AS vx, coalesce(covar_samp(y, x), 0) AS c FROM {src} GROUP BY image_id, component HAVING count(*) >= {least}),
    {name}_a AS (SELECT *, sqrt(((vy - vx) / 2) ** 2 + c ** 2) AS root, atan2(2 * c, vx - vy) / 2 AS angle FROM {name}_c),
    {name} AS (SELECT a.image_id, a.component, area, y0, x0, y1, x1, 4 * sqrt((vy + vx) / 2 + root) AS major, 4 * sqrt(greatest(0, (vy + vx) / 2 - root)) AS minor, angle, max(x * cos(angle) + y * sin(angle)) - min(x * cos(angle) + y * sin(angle)) AS length FROM {name}_a a JOIN {src} p ON a.image_id = p.image_id AND a.component = p.component GROUP BY ALL)"""


@query("connected_components", ("v_pred_px",), components_sql("v_pred_px", "cc") + " SELECT * FROM cc")
def _(p):
    return P.components(p)


#: The angle of a component without a longer axis is noise, so shapes are compared without it.
SHAPE = "image_id, component, area, y0, x0, y1, x1, round(major, 6) AS major, round(minor, 6) AS minor"


@query("component_shapes", ("v_pred_px",), components_sql("v_pred_px", "cc") + shapes_sql("cc", "sh", 5) + f" SELECT {SHAPE} FROM sh")
def _(p):
    return P.component_shapes(P.components(p), 5).drop("angle", "length")


def closed_sql(src: str) -> str:
    """CTEs that end in `closed`: the square closing of radius 1, what is beyond the frame counting as set."""
    n = f"9 - (CASE WHEN y = 0 OR y = {FRAME - 1} THEN 3 ELSE 0 END) - (CASE WHEN x = 0 OR x = {FRAME - 1} THEN 3 ELSE 0 END) + (CASE WHEN (y = 0 OR y = {FRAME - 1}) AND (x = 0 OR x = {FRAME - 1}) THEN 1 ELSE 0 END)"
    return f", wide AS ({grown(src, box(1))}), closed AS (SELECT image_id, y, x FROM (SELECT image_id, y + dy AS y, x + dx AS x, count(*) AS k FROM wide, ({box(1)}) WHERE y + dy BETWEEN 0 AND {FRAME - 1} AND x + dx BETWEEN 0 AND {FRAME - 1} GROUP BY ALL) e WHERE k = {n})"


@query("cleaned_components", ("v_gt_px",), closed_sql("v_gt_px") + components_sql("closed", "cc") + ", own AS (SELECT cc.* FROM cc SEMI JOIN v_gt_px t ON cc.image_id = t.image_id AND cc.y = t.y AND cc.x = t.x)" + shapes_sql("own", "sh", 20) + " SELECT own.* FROM own SEMI JOIN (SELECT * FROM sh WHERE length >= 15) k ON own.image_id = k.image_id AND own.component = k.component")
def _(t):
    return P.cleaned_components(t, 1, FRAME, FRAME, 20, 15.0)


@query("line_votes", ("v_pred_px",), ", v AS (SELECT image_id, theta, CAST(round_even(x * cos(radians(theta)) + y * sin(radians(theta)), 0) AS INT) AS rho FROM v_pred_px, (SELECT unnest(range(0, 180)) AS theta)) SELECT image_id, theta::INT AS theta, rho, count(*) AS votes FROM v GROUP BY ALL HAVING count(*) >= 40")
def _(p):
    return P.line_votes(p, 40)


ANGLE = "radians(theta)"


def lines_sql(src: str, name: str, votes: int, gap: int, length: int) -> str:
    """CTEs that end in `name`: the pixels of the segments of a standard Hough transform of src."""
    return f""", {name}_on AS MATERIALIZED (SELECT image_id, theta, CAST(round_even(x * cos({ANGLE}) + y * sin({ANGLE}), 0) AS INT) AS rho, CAST(round_even(-x * sin({ANGLE}) + y * cos({ANGLE}), 0) AS INT) AS t FROM {src}, (SELECT unnest(range(0, 180)) AS theta) a),
    {name}_t AS (SELECT DISTINCT * FROM {name}_on SEMI JOIN (SELECT image_id, theta, rho FROM {name}_on GROUP BY ALL HAVING count(*) >= {votes}) k USING (image_id, theta, rho)),
    {name}_n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY image_id, theta, rho ORDER BY t) > {gap + 1} THEN 1 ELSE 0 END AS fresh FROM {name}_t),
    {name}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, theta, rho ORDER BY t) AS segment FROM {name}_n),
    {name}_s AS (SELECT image_id, theta, rho, min(t) AS a, max(t) AS b FROM {name}_g GROUP BY image_id, theta, rho, segment HAVING max(t) - min(t) >= {length}),
    {name} AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT image_id, CAST(round_even(rho * sin({ANGLE}) + t * cos({ANGLE}), 0) AS BIGINT) AS y, CAST(round_even(rho * cos({ANGLE}) - t * sin({ANGLE}), 0) AS BIGINT) AS x FROM (SELECT image_id, theta, rho, unnest(range(a, b + 1)) AS t FROM {name}_s) d) e WHERE y BETWEEN 0 AND {FRAME - 1} AND x BETWEEN 0 AND {FRAME - 1})"""


def accounts_sql(pre: str, post: str) -> str:
    """CTEs that end in c (per cell), i (per image)."""
    return f""", f AS (SELECT image_id, y, x, max(a) AS pre, max(b) AS post, max(g) AS gt FROM (SELECT image_id, y, x, 1 AS a, 0 AS b, 0 AS g FROM {pre} UNION ALL SELECT image_id, y, x, 0, 1, 0 FROM {post} UNION ALL SELECT image_id, y, x, 0, 0, 1 FROM v_gt_px) GROUP BY ALL),
    c AS (SELECT image_id, y // 32 AS cy, x // 32 AS cx, sum(gt) AS gt, sum(pre * gt) AS tpa, sum(post * gt) AS tpb, sum(pre) AS na, sum(post) AS nb FROM f GROUP BY ALL),
    i AS (SELECT image_id, sum(gt) AS gt, sum(tpa) AS tpa, sum(tpb) AS tpb, sum(na) AS na, sum(nb) AS nb, count(*) FILTER (gt > 0) AS patches, count(*) FILTER (gt > 0 AND tpa = 0) AS ma, count(*) FILTER (gt > 0 AND tpb = 0) AS mb FROM c GROUP BY image_id)"""


TOTALS = """ SELECT count(*) FILTER (gt > 0) AS positive_images, sum(patches)::BIGINT AS positive_patches, sum(nb - tpb - na + tpa)::BIGINT AS fp_added, round(count(*) FILTER (gt > 0 AND tpa = 0) / count(*) FILTER (gt > 0), 6) AS image_fnr_pre, round(sum(ma) / sum(patches), 6) AS patch_fnr_pre, round(sum(tpa) FILTER (gt > 0) / sum(gt) FILTER (gt > 0), 6) AS recall_pre, round(sum(tpa) / sum(na), 6) AS precision_pre,
    round(count(*) FILTER (gt > 0 AND tpb = 0) / count(*) FILTER (gt > 0), 6) AS image_fnr_post, round(sum(mb) / sum(patches), 6) AS patch_fnr_post, round(sum(tpb) FILTER (gt > 0) / sum(gt) FILTER (gt > 0), 6) AS recall_post, round(sum(tpb) / sum(nb), 6) AS precision_post FROM i"""
AT = lambda p: f"SELECT image_id, y, x FROM v_prob_px WHERE prob >= {p}"


@query("line_completion", ("v_prob_px", "v_gt_px"), f", low AS ({AT('1e-1')}), pred AS ({AT('5e-1')})" + lines_sql("low", "ln", 30, 5, 20) + ", post AS (SELECT * FROM pred UNION SELECT * FROM ln)" + accounts_sql("pred", "post") + TOTALS)
def _(p, t):
    pred = p.where("prob >= 0.5").select("image_id", "y", "x")
    post = P.union(pred, P.complete_lines(p.where("prob >= 0.1"), 30, 5, 20, FRAME, FRAME))
    return P.line_accounting(pred, post, t, 32)


@query("image_accounting", ("v_prob_px", "v_gt_px"), f", low AS ({AT('1e-1')}), pred AS ({AT('5e-1')})" + accounts_sql("pred", "low") + """ SELECT image_id, gt::BIGINT AS gt, tpa::BIGINT AS tp_pre, tpb::BIGINT AS tp_post, na::BIGINT AS n_pre, nb::BIGINT AS n_post, patches, ma::BIGINT AS missed_pre, mb::BIGINT AS missed_post, gt > 0 AS is_positive, tpa > 0 AS detected_pre, tpb > 0 AS detected_post,
    (na - tpa)::BIGINT AS fp_pre, (nb - tpb)::BIGINT AS fp_post, (nb - tpb - na + tpa)::BIGINT AS fp_added, round(tpa / nullif(na, 0), 6) AS precision_pre, round(tpb / nullif(nb, 0), 6) AS precision_post FROM i""")  # fmt: skip
def _(p, t):
    return P.image_accounting(p.where("prob >= 0.5"), p.where("prob >= 0.1"), t, 32)


@query("line_accounting", ("v_prob_px", "v_gt_px"), """, f AS (SELECT image_id, y, x, max(a) AS pre, max(b) AS post, max(g) AS gt FROM (SELECT image_id, y, x, CASE WHEN prob >= 5e-1 THEN 1 ELSE 0 END AS a, CASE WHEN prob >= 1e-1 THEN 1 ELSE 0 END AS b, 0 AS g FROM v_prob_px UNION ALL SELECT image_id, y, x, 0, 0, 1 FROM v_gt_px) GROUP BY ALL),
    c AS (SELECT image_id, y // 32 AS cy, x // 32 AS cx, sum(gt) AS gt, sum(pre * gt) AS tpa, sum(post * gt) AS tpb, sum(pre) AS na, sum(post) AS nb FROM f GROUP BY ALL),
    i AS (SELECT image_id, sum(gt) AS gt, sum(tpa) AS tpa, sum(tpb) AS tpb, sum(na) AS na, sum(nb) AS nb, count(*) FILTER (gt > 0) AS patches, count(*) FILTER (gt > 0 AND tpa = 0) AS ma, count(*) FILTER (gt > 0 AND tpb = 0) AS mb FROM c GROUP BY image_id)
    SELECT count(*) FILTER (gt > 0) AS positive_images, sum(patches)::BIGINT AS positive_patches, sum(nb - tpb - na + tpa)::BIGINT AS fp_added, round(count(*) FILTER (gt > 0 AND tpa = 0) / count(*) FILTER (gt > 0), 6) AS image_fnr_pre, round(sum(ma) / sum(patches), 6) AS patch_fnr_pre, round(sum(tpa) FILTER (gt > 0) / sum(gt) FILTER (gt > 0), 6) AS recall_pre, round(sum(tpa) / sum(na), 6) AS precision_pre,
        round(count(*) FILTER (gt > 0 AND tpb = 0) / count(*) FILTER (gt > 0), 6) AS image_fnr_post, round(sum(mb) / sum(patches), 6) AS patch_fnr_post, round(sum(tpb) FILTER (gt > 0) / sum(gt) FILTER (gt > 0), 6) AS recall_post, round(sum(tpb) / sum(nb), 6) AS precision_post FROM i""")
def _(p, t):
    return P.line_accounting(p.where("prob >= 0.5"), p.where("prob >= 0.1"), t, 32)


# Frames.
@query("image_statistics", ("v_frame_px",), "SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(v) / 255, 6) AS mean01, round(stddev_pop(v) / 255, 6) AS std01, count(*) FILTER (v > 0) AS positive, round(count(*) FILTER (v > 0) / count(*), 6) AS positive_fraction FROM v_frame_px GROUP BY image_id")
def _(f):
    return D.image_statistics(f)


@query("normalised_by_image", ("v_frame_px",), ", s AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN NULL ELSE avg(v) END AS m, stddev_pop(v) AS d FROM v_frame_px GROUP BY image_id), o AS (SELECT image_id, y // 16 AS cy, avg(v) AS m, stddev_samp(v) AS d FROM v_frame_px GROUP BY ALL) SELECT f.*, f.y // 16 AS cy, round(CASE WHEN s.m IS NULL THEN (v - o.m) / (o.d + 1e-6) ELSE (v - s.m) / (s.d + 1e-6) END, 6) AS z FROM v_frame_px f JOIN s USING (image_id) JOIN o ON f.image_id = o.image_id AND f.y // 16 = o.cy")
def _(f):
    stats = f.groupBy("image_id").agg(F.when(F.col("image_id") % 3 != 0, F.avg("v")).alias("image_mean"), F.stddev_pop("v").alias("image_std"))
    return D.normalise(f.withColumn("cy", F.floor(F.col("y") / 16)), "full_image", ("image_id", "cy"), stats)


@query("normalised_pixels", ("v_frame_px",), ", s AS (SELECT image_id, avg(v) AS m, stddev_samp(v) AS s FROM v_frame_px GROUP BY image_id) SELECT f.*, round((v - m) / (s + 1e-6), 6) AS z FROM v_frame_px f JOIN s USING (image_id)")
def _(f):
    return D.normalise(f)


@query("stretched_pixels", ("v_frame_px",), ", q AS (SELECT image_id, quantile_cont(CAST(v AS DOUBLE), 1e-2) AS lo, quantile_cont(CAST(v AS DOUBLE), 995e-3) AS hi FROM v_frame_px GROUP BY image_id) SELECT f.*, round(CASE WHEN hi <= lo THEN 0e0 ELSE (greatest(lo, least(hi, v)) - lo) / (hi - lo) END, 6) AS s FROM v_frame_px f JOIN q USING (image_id)")
def _(f):
    return D.stretch(f, 1.0, 99.5)


@query("filled_pixels", ("v_frame_px",), ", q AS (SELECT image_id, quantile_cont(CAST(v AS DOUBLE), 5e-1) AS m FROM v_frame_px WHERE v % 11 <> 0 GROUP BY image_id) SELECT image_id, y, x, round(CASE WHEN v % 11 = 0 THEN m ELSE v END, 6) AS v, v % 11 = 0 AS filled FROM v_frame_px JOIN q USING (image_id)")
def _(f):
    return D.fill_nonfinite(f.withColumn("v", F.when(F.col("v") % 11 != 0, F.col("v").cast("double")).when(F.col("v") % 2 == 0, F.lit(float("nan")))))


@query("downsampled_frame", ("v_frame_px",), """, w AS (SELECT image_id, v, cy, cx, greatest(0, least((y + 1) / 25e-1, cy + 1) - greatest(y / 25e-1, cy)) * greatest(0, least((x + 1) / 25e-1, cx + 1) - greatest(x / 25e-1, cx)) AS k
    FROM v_frame_px, (SELECT unnest(range(0, 26)) AS cy), (SELECT unnest(range(0, 26)) AS cx)) SELECT image_id, cy AS y, cx AS x, round(sum(v * k) / sum(k), 6) AS v FROM w WHERE k > 1e-12 GROUP BY ALL""")
def _(f):
    return D.downsample(f, 2.5)


@query("noise_calibration", ("v_frame_px",), ", s AS (SELECT count(*) AS n, avg(v) / 255 AS mu, stddev_pop(v) / 255 AS sd FROM v_frame_px) SELECT n, round(mu, 6) AS mu, round(sd, 6) AS sigma, round(sd * sd / (2 * mu), 6) AS alpha, round(sd / sqrt(2), 6) AS beta FROM s")
def _(f):
    return D.noise_calibration(f)


def md5_of(seed, *keys: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || CAST({k} AS VARCHAR)" for k in keys) + ")"


def number_of(seed, *keys: str) -> str:
    return hash_sql(True, md5_of(seed, *keys)[4:-1])


UNIT = lambda k: f"(({number_of(f'7|{k}', 'image_id', 'y', 'x')} + 5e-1) / 4294967296e0)"


@query("noisy_pixels", ("v_frame_px",), f"SELECT image_id, y, x, v, round(greatest(0e0, least(1e0, v / 255 + sqrt(2e-2 * v / 255 + 9e-2 * 9e-2) * sqrt(-2 * ln({UNIT('a')})) * cos(2 * pi() * {UNIT('b')}))), 6) AS p FROM v_frame_px")
def _(f):
    return D.add_noise(f.withColumn("p", F.col("v") / 255), 0.02, 0.09, 1.0, 7)


TURN = lambda k, n: f"{number_of(f'3|{k}', 'image_id', 'cy')} % {n}"


@query("augmented_pixels", ("v_frame_px",), f""", b AS (SELECT image_id, y // 16 AS cy, y % 16 AS y, x % 16 AS x, x // 16 AS cx, v FROM v_frame_px), m AS (SELECT *, image_id % 4 <> 0 AS train FROM b), d AS (SELECT image_id, cy, cx, v, CASE WHEN train AND {TURN('h', 2)} = 1 THEN 15 - x ELSE x END AS x, CASE WHEN train AND {TURN('v', 2)} = 1 THEN 15 - y ELSE y END AS y, CASE WHEN train THEN {TURN('r', 4)} ELSE 0 END AS k FROM m)
    SELECT image_id, cy, cx, v, CASE k WHEN 0 THEN y WHEN 1 THEN 15 - x WHEN 2 THEN 15 - y ELSE x END AS y, CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 15 - x ELSE 15 - y END AS x FROM d""")
def _(f):
    """Patches of 16 pixels; images whose number is divisible by 4 stand for another split."""
    cells = f.select("image_id", F.floor(F.col("y") / 16).alias("cy"), F.floor(F.col("x") / 16).alias("cx"), (F.col("y") % 16).alias("y"), (F.col("x") % 16).alias("x"), "v")
    return D.augment(cells, 16, 3, ("image_id", "cy"), F.col("image_id") % 4 != 0)


# Manifest.
COUNTS = ", c AS (SELECT source_image AS image, CAST(round(sum(fraction) * 1e5) AS BIGINT) AS positives FROM v_manifest GROUP BY source_image)"


@query("image_level_splits", ("v_manifest",), COUNTS + f""", q AS (SELECT quantile_cont(CAST(positives AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM c), b AS (SELECT image, positives, CASE WHEN positives <= q[1] THEN 0 WHEN positives <= q[2] THEN 1 WHEN positives <= q[3] THEN 2 ELSE 3 END AS quartile FROM c, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY {md5_of(2804, 'image')}, image) - 1 AS r, count(*) OVER (PARTITION BY quartile) AS n FROM b)
    SELECT image, positives, quartile, CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r""")
def _(m):
    return D.image_splits(m.groupBy(F.col("source_image").alias("image")).agg(F.round(F.sum("fraction") * 1e5).cast("long").alias("positives")), 0.7, 0.15, 2804)


@query("sampled_negatives", ("v_manifest",), f", q AS (SELECT split, 3 * count(*) FILTER (fraction > 0) AS quota FROM v_manifest GROUP BY split), m AS (SELECT * FROM v_manifest), n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {md5_of(5, 'patch')}, patch) AS r FROM m WHERE fraction <= 0) SELECT source_image, patch, split, round(fraction, 6) AS fraction FROM m WHERE fraction > 0 UNION ALL SELECT source_image, patch, n.split, round(fraction, 6) FROM n JOIN q ON n.split = q.split WHERE r <= quota")
def _(m):
    return D.sample_negatives(m, 3, 5)


@query("train_image_subset", ("v_manifest",), f", i AS (SELECT source_image, row_number() OVER (ORDER BY {md5_of(1, 'source_image')}, source_image) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source_image FROM v_manifest WHERE split = 'train')), k AS (SELECT source_image FROM i WHERE r <= greatest(1, round_even(n * 0.3, 0))) SELECT source_image, patch, split, round(fraction, 6) AS fraction FROM v_manifest WHERE split <> 'train' OR source_image IN (SELECT * FROM k)")
def _(m):
    return D.image_subset(m, 0.3, 1)


@query("split_leaks", ("v_manifest",), ", d AS (SELECT DISTINCT split, source_image FROM v_manifest) SELECT x.split AS a, y.split AS b, count(*) AS shared, min(x.source_image) AS example FROM d x JOIN d y ON x.source_image = y.source_image AND x.split < y.split GROUP BY ALL")
def _(m):
    return D.split_leaks(m)


@query("manifest_audit", ("v_manifest",), """, d AS (SELECT DISTINCT split, source_image FROM v_manifest), a AS (SELECT 'split_values' AS "check", count(*) FILTER (split NOT IN ('train', 'val', 'test')) AS failing FROM v_manifest UNION ALL SELECT 'fraction_range', count(*) FILTER (fraction < 0 OR fraction > 1) FROM v_manifest UNION ALL SELECT 'missing_values', count(*) FILTER (source_image IS NULL OR patch IS NULL) FROM v_manifest
    UNION ALL SELECT 'repeated_patches', count(patch) - count(DISTINCT patch) FROM v_manifest UNION ALL SELECT 'class_balance', count(DISTINCT split) - count(DISTINCT split) FILTER (fraction > 0) FROM v_manifest UNION ALL SELECT 'split_leaks', (SELECT count(*) FROM d x JOIN d y ON x.source_image = y.source_image AND x.split < y.split)) SELECT "check", failing, failing = 0 AS ok FROM a""")
def _(m):
    return D.audit(m)


@query("full_audit", ("v_manifest",), """, d AS (SELECT DISTINCT split, source_image FROM v_manifest), m AS (SELECT *, CASE WHEN patch % 5 = 0 THEN NULL ELSE fraction END AS image_mean, CASE WHEN patch % 5 = 0 THEN NULL ELSE fraction - 2e-3 END AS image_std FROM v_manifest), g AS (SELECT source_image, count(*) AS n, count(image_mean) AS a, count(image_std) AS b FROM m GROUP BY source_image),
    a AS (SELECT 'split_values' AS "check", count(*) FILTER (split NOT IN ('train', 'val', 'test')) AS failing FROM v_manifest UNION ALL SELECT 'fraction_range', count(*) FILTER (fraction < 0 OR fraction > 1) FROM v_manifest UNION ALL SELECT 'missing_values', count(*) FILTER (source_image IS NULL OR patch IS NULL) FROM v_manifest
    UNION ALL SELECT 'repeated_patches', count(patch) - count(DISTINCT patch) FROM v_manifest UNION ALL SELECT 'class_balance', count(DISTINCT split) - count(DISTINCT split) FILTER (fraction > 0) FROM v_manifest UNION ALL SELECT 'split_leaks', (SELECT count(*) FROM d x JOIN d y ON x.source_image = y.source_image AND x.split < y.split)
    UNION ALL SELECT 'statistics_pattern', count(*) FILTER (a <> b OR (a > 0 AND a < n)) FROM g UNION ALL SELECT 'statistics_range', count(*) FILTER (image_mean < 0 OR image_mean > 1 OR image_std <= 0) FROM m UNION ALL SELECT 'statistics_missing', count(*) FILTER (image_mean IS NULL) FROM m
    UNION ALL SELECT 'fraction_recomputed', count(*) FILTER (abs(fraction - (patch % 1000 + 1) / 1e5) > 1e-6) FROM v_manifest UNION ALL SELECT 'absent_files', count(*) FILTER (fraction = 0) FROM v_manifest UNION ALL SELECT 'patch_shapes', count(*) FILTER (fraction > 5e-3) FROM v_manifest) SELECT "check", failing, failing = 0 AS ok FROM a""")
def _(m):
    """Statistics, masks and files as a careless build could leave them."""
    gone = F.col("patch") % 5 == 0
    masks = m.select("patch", (F.col("patch") % 1000 + 1).alias("positive_pixels"), F.lit(100_000).alias("pixels"))
    files = m.where("fraction > 0").select("patch", F.when(F.col("fraction") > 0.005, 500).otherwise(528).alias("height"), *[F.lit(528).alias(c) for c in ("width", "mask_height", "mask_width")])
    return D.audit(m.withColumns({"image_mean": F.when(~gone, F.col("fraction")), "image_std": F.when(~gone, F.col("fraction") - 0.002)}), masks, files, strict=True)


@query("hard_negative_append", ("v_manifest",), f", h AS (SELECT patch FROM v_manifest WHERE split = 'train' AND fraction = 0 ORDER BY {md5_of(8, 'patch')}, patch LIMIT 150) SELECT source_image, patch, split, round(fraction, 6) AS fraction FROM v_manifest WHERE split = 'train' UNION ALL SELECT source_image, patch, split, round(fraction, 6) FROM v_manifest, (SELECT unnest([1, 2])) WHERE split = 'train' AND patch IN (FROM h)")
def _(m):
    """The 150 empty patches that score highest; a seeded draw stands in for the score."""
    return D.append_hard_negatives(m, D.seeded_sample(m.where("split = 'train' AND fraction = 0"), 150, 8, "patch"), 2)


@query("densest_patches", ("v_manifest",), "SELECT source_image, patch, split, round(fraction, 6) AS fraction FROM v_manifest WHERE fraction > 0 ORDER BY v_manifest.fraction DESC, source_image, patch LIMIT 12")
def _(m):
    return D.densest(m, 12)


@query("seeded_sample", ("v_manifest",), f"SELECT source_image, patch, split, round(fraction, 6) AS fraction FROM v_manifest ORDER BY {md5_of(9, 'patch')}, patch LIMIT 100")
def _(m):
    return D.seeded_sample(m, 100, 9, "patch")


@query("quota_sample", ("v_manifest",), f"SELECT source_image, patch, split, round(fraction, 6) AS fraction FROM v_manifest QUALIFY row_number() OVER (PARTITION BY source_image, split ORDER BY {md5_of(4, 'patch')}, patch) <= 2")
def _(m):
    return D.quota_sample(m, ["source_image", "split"], 2, 4, "patch")


@query("patch_names", ("v_manifest",), "SELECT patch, replace(source_image, '.png', '') || '_' || (patch % 7) || '_' || (patch % 5) AS name FROM v_manifest")
def _(m):
    return m.select("patch", D.patch_name(F.col("source_image"), F.col("patch") % 7, F.col("patch") % 5).alias("name"))


@query("observations_per_year", ("v_manifest",), "SELECT CAST(substr(source_image, 5, 4) AS INT) AS year, count(*) AS n FROM v_manifest GROUP BY 1")
def _(m):
    return S.per_year(m.withColumn("ts", D.parse_observation(F.col("source_image"))), "ts")


@query("pooled_sample", ("v_manifest",), f", a AS (SELECT * FROM v_manifest QUALIFY row_number() OVER (PARTITION BY source_image, split ORDER BY {md5_of(4, 'patch')}, patch) <= 4) SELECT source_image, patch, split, round(fraction, 6) AS fraction FROM a QUALIFY row_number() OVER (PARTITION BY split ORDER BY {md5_of(4, 'patch')}, patch) <= 100")
def _(m):
    return D.quota_sample(m, ["source_image", "split"], 4, 4, "patch", pooled=100, pool=("split",))


@query("observation_dates", ("v_manifest",), "SELECT DISTINCT source_image, strptime(regexp_extract(source_image, 'ML1_([0-9]{8}_[0-9]{6})', 1), '%Y%m%d_%H%M%S') AS observed, CAST(year(strptime(regexp_extract(source_image, 'ML1_([0-9]{8}_[0-9]{6})', 1), '%Y%m%d_%H%M%S')) AS INT) AS year, regexp_replace(source_image, '_red.fits_full.png$', '_red_mask.png') AS mask FROM v_manifest")
def _(m):
    t = D.parse_observation(F.col("source_image"))
    return m.select("source_image").distinct().select("source_image", t.alias("observed"), F.year(t).alias("year"), D.mask_path(F.col("source_image")).alias("mask"))


# Catalogue, histories, trials, audits.
@query("catalogue_summary", ("v_catalogue",), "SELECT count(*) AS rows, count(DISTINCT satellite_name) AS names, count(satellite_name) AS labelled, count(*) - count(satellite_name) AS missing FROM v_catalogue")
def _(c):
    return S.catalogue_summary(S.require(c))


CAT_COLUMNS = ("satellite_name", "length", "start_ra", "end_ra", "start_dec", "end_dec")


@query("unique_names", ("v_catalogue",), "SELECT DISTINCT satellite_name FROM v_catalogue WHERE satellite_name IS NOT NULL")
def _(c):
    return S.unique_names(c)


@query("missing_values", ("v_catalogue",), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM v_catalogue" for c in CAT_COLUMNS))
def _(c):
    return S.missing_values(c)


@query("name_frequency", ("v_catalogue",), "SELECT satellite_name, count(*) AS n FROM v_catalogue WHERE satellite_name IS NOT NULL GROUP BY satellite_name ORDER BY n DESC, satellite_name LIMIT 10")
def _(c):
    return S.name_frequency(c, 10)


@query("length_summary", ("v_catalogue",), "SELECT count(length) AS n, round(avg(length), 6) AS mean, round(quantile_cont(length, 5e-1), 6) AS median, round(min(length), 6) AS min, round(max(length), 6) AS max FROM v_catalogue")
def _(c):
    return S.length_summary(c)


@query("coordinate_ranges", ("v_catalogue",), "SELECT least(min(start_ra), min(end_ra)) AS ra_min, greatest(max(start_ra), max(end_ra)) AS ra_max, least(min(start_dec), min(end_dec)) AS dec_min, greatest(max(start_dec), max(end_dec)) AS dec_max FROM v_catalogue")
def _(c):
    return S.coordinate_ranges(c)


@query("describe_numbers", ("v_catalogue",), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM v_catalogue" for c in CAT_COLUMNS[1:]))
def _(c):
    return S.describe(c, list(CAT_COLUMNS[1:]))


@query("longest_zero_run", ("v_history",), ", z AS (SELECT run_id, epoch, val_dice, epoch - row_number() OVER (PARTITION BY run_id, val_dice = 0 ORDER BY epoch) AS g FROM v_history), r AS (SELECT run_id, g, count(*) AS k FROM z WHERE val_dice = 0 GROUP BY ALL) SELECT h.run_id, CAST(coalesce(max(k), 0) AS BIGINT) AS longest_zero FROM (SELECT DISTINCT run_id FROM v_history) h LEFT JOIN r ON h.run_id = r.run_id GROUP BY h.run_id")
def _(h):
    return S.longest_zero_run(h)


@query("loss_spikes", ("v_history",), ", b AS (SELECT run_id, val_loss AS v, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v_history) SELECT run_id, count(*) FILTER (v > 2 * b) AS spikes FROM b GROUP BY run_id")
def _(h):
    return S.loss_spikes(h)


@query("run_stability", ("v_history",), "SELECT run_id, bool_or(val_loss IS NULL OR train_loss IS NULL) AS bad_loss, count(*) AS epochs, round(arg_max(val_dice, epoch), 6) AS last_dice FROM v_history GROUP BY run_id")
def _(h):
    return S.run_stability(h)


@query("best_epochs", ("v_history",), "SELECT run_id, CAST(epoch AS INT) AS epoch, round(val_dice, 6) AS val_dice FROM v_history QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY v_history.val_dice DESC, epoch) = 1")
def _(h):
    return S.best_epochs(h)


TRIALS = ", s AS (SELECT trial, count(val_f1) AS n, avg(val_f1) AS mean, stddev_samp(val_f1) AS std, any_value(batch_size) AS batch_size, any_value(learning_rate) AS learning_rate, 6 - count(DISTINCT seed) AS missing_seeds FROM v_trials GROUP BY trial)"
TRIAL_COLUMNS = "trial, n, round(mean, 6) AS mean, round(CASE WHEN n = 1 THEN 0 ELSE std END, 6) AS std, batch_size, round(learning_rate, 6) AS learning_rate, CAST(missing_seeds AS BIGINT) AS missing_seeds"


@query("trial_summary", ("v_trials",), TRIALS + f" SELECT {TRIAL_COLUMNS} FROM s")
def _(t):
    return S.trial_summary(t, list(range(6)))


@query("trial_aggregate", ("v_trials",), f""", x AS (SELECT *, 'net_t' || trial || '_s' || seed AS tag, run % 7 = 0 AS bad FROM v_trials), v AS (SELECT trial, val_f1, row_number() OVER (PARTITION BY trial ORDER BY run) - 1 AS unit_no FROM x), n AS (SELECT trial, count(*) AS n FROM v GROUP BY trial),
    d AS (SELECT trial, resample, {number_of(5, 'trial', 'resample', 'i')} % n AS unit_no FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, unnest(range(20)) AS resample FROM n))), m AS (SELECT d.trial, resample, avg(val_f1) AS m FROM d JOIN v ON d.trial = v.trial AND d.unit_no = v.unit_no GROUP BY ALL),
    ci AS (SELECT trial, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY trial)
    SELECT x.trial, 'net' AS prefix, count(val_f1) AS n, round(avg(val_f1), 6) AS mean, round(stddev_samp(val_f1), 6) AS std, CAST(6 - count(DISTINCT seed) AS BIGINT) AS missing_seeds, count(*) FILTER (bad) + 6 - count(DISTINCT seed) AS failures, max(run % 4) AS longest_zero, sum(run % 3)::BIGINT AS spikes, any_value(lo) AS lo, any_value(hi) AS hi FROM x JOIN ci ON x.trial = ci.trial GROUP BY x.trial""")
def _(t):
    tag = F.concat(F.lit("net_t"), F.col("trial").cast("string"), F.lit("_s"), F.col("seed").cast("string"))
    runs = t.select(*S.parse_tag(tag), "run", "val_f1", (F.col("run") % 7 == 0).alias("bad_loss"), F.lit(0.5).alias("last_dice"), (F.col("run") % 4).alias("longest_zero"), (F.col("run") % 3).alias("spikes"))
    return S.trial_aggregate(runs, list(range(6)), 20, 5)


@query("selected_trial", ("v_trials",), TRIALS + f" SELECT {TRIAL_COLUMNS} FROM s WHERE s.mean >= (SELECT max(s.mean) FROM s) - 5e-3 ORDER BY batch_size, s.learning_rate, trial LIMIT 1")
def _(t):
    return S.select_trial(S.trial_summary(t, list(range(6))), 0.005)


@query("top_trials", ("v_trials",), "SELECT trial, round(val_f1, 6) AS val_f1, seed FROM (SELECT * FROM v_trials QUALIFY row_number() OVER (PARTITION BY trial ORDER BY val_f1 DESC, run) = 1) b ORDER BY b.val_f1 DESC, trial LIMIT 5")
def _(t):
    return S.top_trials(t, 5)


@query("seed_band", ("v_trials",), "SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) - count(m) AS missing, abs(3e-1 - avg(m)) <= stddev_samp(m) AS anchor_inside FROM (SELECT seed, avg(val_f1) AS m FROM v_trials GROUP BY seed)")
def _(t):
    return S.band(t.groupBy("seed").agg(F.avg("val_f1").alias("m")), "m", 0.3)


@query("verdict_check", ("v_audit",), "SELECT stratum, count(*) AS crops, count(*) - count(verdict) AS missing, count(*) FILTER (verdict NOT IN ('trail', 'no_trail', 'uncertain')) AS unknown FROM v_audit GROUP BY stratum")
def _(a):
    return S.verdict_check(a)


OVER = "model_fired AND NOT reference_has_trail"
MEDIAN = lambda c: f"quantile_cont(CAST(fp_pixels AS DOUBLE), 5e-1) FILTER ({c})"


@query("control_summary", ("v_audit",), "SELECT stratum, count(*) AS crops, count(*) FILTER (verdict = 'trail') AS verdict_trail, count(*) FILTER (verdict = 'no_trail') AS verdict_no_trail, count(*) FILTER (reference_has_trail) AS reference_has_trail, count(*) FILTER (model_fired) AS model_fired, "
    + ", ".join(f"round({MEDIAN(c)}, 6) AS {n}median_fp, max(fp_pixels) FILTER ({c}) AS {n}max_fp, round(round({MEDIAN(c)} / 278784, 8), 6) AS {n}median_fp_fraction" for n, c in (("", "TRUE"), ("over_fired_", OVER))) + f", count(*) FILTER ({OVER}) AS over_fired FROM v_audit GROUP BY stratum")
def _(a):
    return S.control_summary(a, 528 * 528)


@query("mechanisms", ("v_audit",), """, w AS (SELECT crop_name, fp_pixels % 7 * 1e0 AS o, CASE WHEN stratum = 3 THEN NULL ELSE fp_pixels % 5 * 1e0 END AS r, fp_pixels % 6 * 1e0 AS m, fp_pixels % 11 / 1e1 AS a, fp_pixels % 13 / 1e1 AS b FROM v_audit) SELECT crop_name, CASE WHEN o IS NULL OR r IS NULL OR m IS NULL THEN 'mixed/inconclusive' WHEN a <= b + 2e-2 AND r - o >= 1 AND abs(m - r) <= 1 THEN 'thin-original support' WHEN abs(r - o) < 1 AND m - r >= 1 THEN 'model-overpaint support' ELSE 'mixed/inconclusive' END AS mechanism FROM w""")
def _(a):
    v = lambda n, d=1: F.col("fp_pixels") % n / d
    return a.select("crop_name", S.mechanism(v(11, 10), v(13, 10), v(7), F.when(F.col("stratum") != 3, v(5)), v(6)).alias("mechanism"))


@query("category_summary", ("v_audit",), "SELECT verdict, count(*) AS available, count(fp_pixels) AS sampled, round(quantile_cont(CAST(fp_pixels AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(fp_pixels AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST(fp_pixels AS DOUBLE), 0.75), 6) AS q75 FROM v_audit GROUP BY verdict")
def _(a):
    return S.category_summary(a, "verdict", "fp_pixels")


TIER = ", q AS (SELECT quantile_cont(CAST(fp_pixels AS DOUBLE), [0.33333, 0.66667]) AS q FROM v_audit), tiers AS (SELECT *, CASE WHEN fp_pixels <= q[1] THEN 'low' WHEN fp_pixels <= q[2] THEN 'medium' ELSE 'high' END AS tier FROM v_audit, q)"


@query("contrast_tiers", ("v_audit",), TIER + " SELECT tier, count(*) AS n FROM tiers GROUP BY tier")
def _(a):
    return S.tertiles(a, "fp_pixels").groupBy("tier").agg(F.count("*").alias("n"))


def _tier_ci(i: int, tier: str) -> str:
    return f"""SELECT '{tier}' AS tier, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT resample, sum(s) / sum(k) AS m FROM (SELECT resample, {number_of(20 + i, 'resample', 'i')} % n AS unit_no FROM (SELECT n, resample, unnest(range(n)) AS i FROM (SELECT n, unnest(range(50)) AS resample FROM (SELECT count(*) AS n FROM u WHERE tier = '{tier}')))) d JOIN u ON u.tier = '{tier}' AND u.unit_no = d.unit_no GROUP BY resample) r"""


@query("tier_summary", ("v_audit",), TIER + ", u AS (SELECT tier, source_image, CAST(sum(stratum) AS DOUBLE) AS s, count(*) AS k, row_number() OVER (PARTITION BY tier ORDER BY source_image) - 1 AS unit_no FROM tiers GROUP BY tier, source_image), ci AS (" + " UNION ALL ".join(_tier_ci(i, t) for i, t in enumerate(S.TIERS)) + ") SELECT t.tier, count(*) AS components, count(DISTINCT source_image) AS images, min(fp_pixels) AS contrast_min, max(fp_pixels) AS contrast_max, round(avg(stratum), 6) AS stratum_mean, any_value(lo) AS stratum_lo, any_value(hi) AS stratum_hi FROM tiers t JOIN ci ON t.tier = ci.tier GROUP BY t.tier")
def _(a):
    return S.tier_summary(a, "source_image", "fp_pixels", ["stratum"], 50, 20)


@query("stratum_table", ("v_scored",), "SELECT image_id % 4 AS stratum, patch_id % 3 AS pairing, " + ", ".join(f"round(avg(prob) FILTER (l = {i}), 6) AS f1_{i}" for i in range(3)) + " FROM (SELECT *, CAST(round(gate * 100) AS BIGINT) % 3 AS l FROM v_scored) GROUP BY ALL")
def _(s):
    scores = s.select((F.col("image_id") % 4).alias("stratum"), (F.col("patch_id") % 3).alias("pairing"), (F.round(F.col("gate") * 100).cast("long") % 3).alias("tolerance"), F.col("prob").alias("f1"))
    return T.stratum_table(scores, [0, 1, 2])


@query("thickness_recovery", ("v_scored",), ", p AS (SELECT image_id % 4 AS thickness, CAST(count(*) FILTER (prob >= 5e-1 AND target) AS DOUBLE) / count(*) FILTER (prob >= 5e-1) AS p FROM v_scored GROUP BY 1), e AS (SELECT max(p) FILTER (thickness = 0) AS pre, arg_max(p, thickness) AS thick FROM p) SELECT thickness, round(pre - p, 6) AS loss, round(CASE WHEN pre = thick THEN 0 ELSE (p - thick) / (pre - thick) END, 6) AS recovered FROM p, e WHERE thickness > 0")
def _(s):
    c = s.groupBy((F.col("image_id") % 4).alias("thickness")).agg((F.count_if((F.col("prob") >= 0.5) & F.col("target")) / F.count_if(F.col("prob") >= 0.5)).alias("precision"))
    return T.thickness_recovery(c)


# Resampling.
UNITS = f", c AS (SELECT image_id, {CONFUSION} FROM v_scored GROUP BY image_id), u AS (SELECT *, row_number() OVER (ORDER BY image_id) - 1 AS unit_no FROM c), nn AS (SELECT count(*) AS n FROM u), d AS (SELECT resample, {number_of(11, 'resample', 'i')} % n AS unit_no FROM (SELECT n, resample, unnest(range(n)) AS i FROM (SELECT n, unnest(range(200)) AS resample FROM nn)))"


def interval(cols: list[str], src: str) -> str:
    return "SELECT " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS {c}_{e}" for c in cols for e, p in (("lo", "0.025"), ("hi", "0.975"))) + f" FROM {src}"


FOUR = "CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, 2e0 * tp / (2 * tp + fp + fn) AS dice"


@query("cluster_bootstrap", ("v_scored",), UNITS + f", s AS (SELECT resample, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM d JOIN u USING (unit_no) GROUP BY resample), m AS (SELECT {FOUR}, CAST(tp AS DOUBLE) / (tp + fp + fn) AS iou FROM s) " + interval(["precision", "recall", "dice", "iou"], "m"))
def _(s):
    return S.cluster_bootstrap(M.dense_counts(s, ["image_id"]), "image_id", 200, 11)


@query("cluster_mean", ("v_scored",), UNITS.replace(CONFUSION, "sum(prob) AS s, count(prob) AS k") + ", m AS (SELECT sum(s) / sum(k) AS mean FROM d JOIN u USING (unit_no) GROUP BY resample) " + interval(["mean"], "m"))
def _(s):
    return S.cluster_mean(s, "image_id", "prob", 200, 11)


@query("paired_bootstrap", ("v_scored",), UNITS.replace(CONFUSION, "avg(prob) - avg(prob2) AS diff") + ", m AS (SELECT avg(diff) AS difference FROM d JOIN u USING (unit_no) GROUP BY resample), i AS (" + interval(["difference"], "m") + ") SELECT *, difference_lo <= 0 AND difference_hi >= 0 AS spans_zero FROM i")
def _(s):
    return S.paired_bootstrap(s.groupBy("image_id").agg(F.avg("prob").alias("a"), F.avg("prob2").alias("b")), "image_id", "a", "b", 200, 11)


@query("bootstrap_mean", ("v_trials",), f""", v AS (SELECT trial, val_f1, row_number() OVER (PARTITION BY trial ORDER BY run) - 1 AS unit_no FROM v_trials), n AS (SELECT trial, count(*) AS n, avg(val_f1) AS mean FROM v GROUP BY trial),
    d AS (SELECT trial, resample, {number_of(3, 'trial', 'resample', 'i')} % n AS unit_no FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, unnest(range(20)) AS resample FROM n))), m AS (SELECT d.trial, resample, avg(val_f1) AS m FROM d JOIN v ON d.trial = v.trial AND d.unit_no = v.unit_no GROUP BY ALL)
    SELECT m.trial, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, round(any_value(mean), 6) AS mean FROM m JOIN n ON m.trial = n.trial GROUP BY m.trial""")
def _(t):
    return S.bootstrap_mean(t, "trial", "run", "val_f1", 20, 3)


CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


@query("patch_bootstrap", ("v_scored",), f", c AS (SELECT patch_id, {CONFUSION} FROM v_scored GROUP BY patch_id), r AS (SELECT *, {number_of(13, 'patch_id', 'resample')} / 4294967296e0 AS h FROM (SELECT *, unnest(range(50)) AS resample FROM c)), w AS (SELECT *, {' + '.join(f'CASE WHEN h >= {x:.17e} THEN 1 ELSE 0 END' for x in CUTS)} AS k FROM r), s AS (SELECT resample, sum(tp * k) AS tp, sum(fp * k) AS fp, sum(fn * k) AS fn FROM w GROUP BY resample), m AS (SELECT {FOUR} FROM s) " + interval(["precision", "recall", "dice"], "m"))
def _(s):
    return S.patch_bootstrap(M.dense_counts(s, ["patch_id"]), "patch_id", 50, 13)


# Streak studies.
@query("centreline_dice", BOTH)
def _(p, t):
    cell = lambda d: d.select("image_id", F.floor(F.col("y") / 32).alias("cy"), F.floor(F.col("x") / 32).alias("cx"), "y", "x")
    return centreline_dice(cell(p), cell(t), ["image_id", "cy", "cx"])


@query("component_widths", ("v_gt_px",))
def _(t):
    return component_widths(P.components(t))


PROFILES = f"""{components_sql("v_gt_px", "cc")}{shapes_sql("cc", "sh")}, mid AS (SELECT image_id, component, avg(y) AS cy, avg(x) AS cx FROM cc GROUP BY ALL),
    ax AS (SELECT sh.image_id, sh.component, angle, cy, cx FROM sh JOIN mid ON sh.image_id = mid.image_id AND sh.component = mid.component),
    sp AS (SELECT ax.image_id, ax.component, any_value(angle) AS angle, any_value(cy) AS cy, any_value(cx) AS cx, quantile_cont((cc.x - cx) * cos(angle) + (cc.y - cy) * sin(angle), 5e-2) AS qa, quantile_cont((cc.x - cx) * cos(angle) + (cc.y - cy) * sin(angle), 95e-2) AS qb FROM ax JOIN cc ON cc.image_id = ax.image_id AND cc.component = ax.component GROUP BY ALL),
    pt AS (SELECT *, unnest(range(-12, 13)) AS offs FROM (SELECT *, unnest(range(CAST(ceil(qa) AS BIGINT), CAST(floor(qb) AS BIGINT) + 1)) AS t FROM sp WHERE floor(qb) >= ceil(qa))),
    po AS (SELECT image_id, component, t, offs, greatest(0, least({FRAME - 1}, cy + t * sin(angle) + offs * cos(angle))) AS py, greatest(0, least({FRAME - 1}, cx + t * cos(angle) - offs * sin(angle))) AS px FROM pt),
    co AS (SELECT image_id, component, t, offs, least({FRAME - 1}, floor(py) + i) AS y, least({FRAME - 1}, floor(px) + j) AS x, (CASE WHEN i = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN j = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM po, (SELECT unnest([0, 1]) AS i) a, (SELECT unnest([0, 1]) AS j) b),
    rd AS (SELECT co.image_id, component, t, offs, sum(coalesce(prob * 200 + 20, 20) * w) AS v FROM co LEFT JOIN v_prob_px p ON p.image_id = co.image_id AND p.y = co.y AND p.x = co.x GROUP BY ALL),
    pr AS (SELECT image_id, component, offs, quantile_cont(v, 5e-1) AS v FROM rd GROUP BY ALL),
    bg AS (SELECT image_id, component, quantile_cont(v, 5e-1) FILTER (abs(offs) >= 8) AS background FROM pr GROUP BY ALL),
    pe AS (SELECT pr.*, background, v - background AS e, greatest(v - background, 0) AS plus FROM pr JOIN bg ON pr.image_id = bg.image_id AND pr.component = bg.component),
    ar AS (SELECT *, (plus + lag(plus) OVER w) / 2 * (offs - lag(offs) OVER w) AS area FROM pe WINDOW w AS (PARTITION BY image_id, component ORDER BY offs)),
    pk AS (SELECT image_id, component, any_value(background) AS background, 1.4826 * quantile_cont(abs(v - background), 5e-1) FILTER (abs(offs) >= 8) AS scatter, greatest(max(e), 0) AS peak, coalesce(sum(area), 0) AS excess, max(v) >= 250 AS saturated FROM ar GROUP BY ALL),
    wd AS (SELECT ar.image_id, ar.component, CAST(max(offs) - min(offs) AS DOUBLE) AS fwhm FROM ar JOIN pk ON ar.image_id = pk.image_id AND ar.component = pk.component WHERE peak > 0 AND e >= peak / 2 GROUP BY ALL)
    SELECT pk.image_id, pk.component, round(background, 6) AS background, round(scatter, 6) AS scatter, round(peak, 6) AS peak, round(CASE WHEN scatter > 1e-6 THEN peak / scatter END, 6) AS contrast, fwhm, round(excess, 6) AS excess, saturated FROM pk LEFT JOIN wd ON pk.image_id = wd.image_id AND pk.component = wd.component"""


@query("streak_profiles", ("v_gt_px", "v_prob_px"), PROFILES)
def _(t, p):
    frame = p.select("image_id", "y", "x", (F.col("prob") * 200 + 20).alias("v"))
    return T.profile_metrics(T.profile(P.components(t), frame, 12, size=(FRAME, FRAME), missing=20.0), 8)


@query("component_recall", ("v_gt_px", "v_prob_px"), components_sql("v_gt_px", "cc") + " SELECT cc.image_id, component, count(*) AS area, round(count(*) FILTER (prob >= 5e-1) / count(*), 6) AS recall_pre, round(count(*) FILTER (prob >= 1e-1) / count(*), 6) AS recall_post, round(count(*) FILTER (prob >= 1e-1 AND prob < 5e-1) / count(*), 6) AS recall_added FROM cc LEFT JOIN v_prob_px p ON cc.image_id = p.image_id AND cc.y = p.y AND cc.x = p.x GROUP BY ALL")
def _(t, p):
    return T.component_recall(P.components(t), p.where("prob >= 0.5"), p.where("prob >= 0.1"))


@query("component_scores", ("v_gt_px", "v_prob_px"), components_sql("v_gt_px", "cc") + """, cells AS (SELECT DISTINCT image_id, y // 32 AS cy, x // 32 AS cx FROM v_prob_px WHERE prob >= 8e-1), pr AS (SELECT * FROM v_prob_px WHERE prob >= 1e-1), own AS (SELECT cc.* FROM cc SEMI JOIN cells k ON cc.image_id = k.image_id AND cc.y // 32 = cy AND cc.x // 32 = cx),
    g AS (SELECT o.image_id, component, count(*) AS supported, count(*) FILTER (prob >= 5e-1) AS pre, count(prob) AS post, greatest(0, min(o.y) - 8) AS y0, least(191, max(o.y) + 8) AS y1, greatest(0, min(o.x) - 8) AS x0, least(191, max(o.x) + 8) AS x1 FROM own o LEFT JOIN pr p ON o.image_id = p.image_id AND o.y = p.y AND o.x = p.x GROUP BY ALL),
    s AS (SELECT p.* FROM pr p SEMI JOIN cells k ON p.image_id = k.image_id AND p.y // 32 = cy AND p.x // 32 = cx), n AS (SELECT g.image_id, component, count(*) FILTER (prob >= 5e-1) AS n_pre, count(prob) AS n_post FROM g JOIN s ON g.image_id = s.image_id AND s.y BETWEEN y0 AND y1 AND s.x BETWEEN x0 AND x1 GROUP BY ALL),
    w AS (SELECT image_id, component, count(*) AS pixels FROM cc GROUP BY ALL)
    SELECT w.image_id, w.component, round(coalesce(supported, 0) / pixels, 6) AS support_fraction, coalesce(supported, 0) AS supported, round(pre / supported, 6) AS recall_pre, round(post / supported, 6) AS recall_post, coalesce(post - pre, 0) AS added, round((post - pre) / supported, 6) AS added_fraction, round(2 * pre / (coalesce(n_pre, 0) + supported), 6) AS dice_pre, round(2 * post / (coalesce(n_post, 0) + supported), 6) AS dice_post
    FROM w LEFT JOIN g ON w.image_id = g.image_id AND w.component = g.component LEFT JOIN n ON w.image_id = n.image_id AND w.component = n.component""")
def _(t, p):
    cells = p.where("prob >= 0.8").select("image_id", (F.floor(F.col("y") / 32) * 32).alias("y0"), (F.floor(F.col("x") / 32) * 32).alias("x0"))
    return T.component_scores(P.components(t), p.where("prob >= 0.5"), p.where("prob >= 0.1"), cells, 32, 8, FRAME, FRAME)


@query("display_excess", ("v_prob_px", "v_gt_px"), f""", t AS (SELECT t.image_id, t.y, t.x FROM v_gt_px t SEMI JOIN v_prob_px p ON t.image_id = p.image_id AND t.y // 32 = p.y // 32 AND t.x // 32 = p.x // 32), a AS ({grown('t', disc(2), False)}), b AS ({grown('t', disc(5), False)}),
    k AS (SELECT p.image_id, p.y, p.x, p.prob, CASE WHEN t.y IS NOT NULL THEN 'gt_trail' WHEN p.prob < 5e-1 THEN 'background' WHEN a.y IS NOT NULL THEN 'near_gt_fp' WHEN b.y IS NOT NULL THEN 'ambiguous_fp' ELSE 'far_fp' END AS category FROM v_prob_px p LEFT JOIN t ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.x LEFT JOIN a ON p.image_id = a.image_id AND p.y = a.y AND p.x = a.x LEFT JOIN b ON p.image_id = b.image_id AND p.y = b.y AND p.x = b.x),
    m AS (SELECT image_id, coalesce(quantile_cont(prob, 5e-1) FILTER (category = 'background'), quantile_cont(prob, 5e-1) FILTER (category <> 'gt_trail'), quantile_cont(prob, 5e-1)) AS m FROM k GROUP BY image_id)
    SELECT k.image_id, category, count(*) AS n, round(avg(prob - m), 6) AS excess FROM k JOIN m ON k.image_id = m.image_id GROUP BY k.image_id, category""")
def _(p, t):
    cells = p.select("image_id", (F.floor(F.col("y") / 32) * 32).alias("y0"), (F.floor(F.col("x") / 32) * 32).alias("x0"))
    d = T.display_excess(p.withColumnRenamed("prob", "v"), p.where("prob >= 0.5"), t, cells, 32, 2, 5)
    return d.groupBy("image_id", "category").agg(F.count("*").alias("n"), F.avg("excess").alias("excess"))


@query("patch_summary", ("v_gt_px",), STATS + " SELECT count(*) AS patches, count(*) FILTER (positive_pixels = 0) AS empty, round(count(*) FILTER (positive_pixels = 0) / count(*), 6) AS empty_fraction, sum(positive_pixels)::BIGINT AS positive_pixels, round(avg(positive_pixels / 1024), 6) AS mean_fraction FROM st")
def _(t):
    return P.summarise_patches(_stats(t))


ADDED = ", added AS (SELECT p.image_id, p.y, p.x FROM v_prob_px p SEMI JOIN v_gt_px t ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.x WHERE prob >= 1e-1 AND prob < 5e-1)"
def eroded_sql(src: str) -> str:
    """Pixels of src whose 3x3 square is set; what is beyond the frame counts as set."""
    n = f"9 - (CASE WHEN y = 0 OR y = {FRAME - 1} THEN 3 ELSE 0 END) - (CASE WHEN x = 0 OR x = {FRAME - 1} THEN 3 ELSE 0 END) + (CASE WHEN (y = 0 OR y = {FRAME - 1}) AND (x = 0 OR x = {FRAME - 1}) THEN 1 ELSE 0 END)"
    return f"SELECT image_id, y, x FROM (SELECT image_id, y + dy AS y, x + dx AS x, count(*) AS k FROM {src}, ({box(1)}) WHERE y + dy BETWEEN 0 AND {FRAME - 1} AND x + dx BETWEEN 0 AND {FRAME - 1} GROUP BY ALL) e WHERE k = {n}"


CROPS = f""", core AS ({eroded_sql('added')}), seeds AS (SELECT * FROM core UNION ALL SELECT * FROM added WHERE image_id NOT IN (SELECT image_id FROM core) UNION ALL SELECT * FROM v_gt_px WHERE image_id NOT IN (SELECT image_id FROM added))""" + components_sql("seeds", "cc") + f""", sh AS (SELECT image_id, component, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cc GROUP BY ALL),
    top AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, component) = 1), im AS (SELECT DISTINCT image_id FROM v_prob_px UNION SELECT image_id + 1000 FROM v_prob_px)
    SELECT im.image_id, coalesce(area, 0) AS area, coalesce(greatest(0, y0 - 8), 0)::BIGINT AS y0, coalesce(greatest(0, x0 - 8), 0)::BIGINT AS x0, coalesce(least({FRAME}, y1 + 8), {FRAME})::BIGINT AS y1, coalesce(least({FRAME}, x1 + 8), {FRAME})::BIGINT AS x1 FROM im LEFT JOIN top USING (image_id)"""
IMAGES = lambda p: p.select(F.explode(F.array("image_id", F.col("image_id") + 1000)).alias("image_id"))


@query("recovered_crops", ("v_prob_px", "v_gt_px"), ADDED + CROPS)
def _(p, t):
    return T.recovered_crop(P.recovered(p.where("prob >= 0.1"), p.where("prob >= 0.5"), t), t, IMAGES(p), FRAME, FRAME, 8)


@query("recovered_crops_fallback", ("v_prob_px", "v_gt_px"), ADDED.replace("prob < 5e-1", "prob < 5e-1 AND p.image_id % 3 = 0") + CROPS)
def _(p, t):
    return T.recovered_crop(P.recovered(p.where("prob >= 0.1 AND image_id % 3 = 0"), p.where("prob >= 0.5"), t), t, IMAGES(p), FRAME, FRAME, 8)


ENDS = """, al AS (SELECT cc.*, round(cc.x * cos(angle) + cc.y * sin(angle), 9) AS t FROM cc JOIN sh ON cc.image_id = sh.image_id AND cc.component = sh.component),
    en AS (SELECT image_id, component, min(struct_pack(t := t, y := y, x := x)) AS a, min(struct_pack(t := -t, y := y, x := x)) AS b FROM al GROUP BY ALL),
    mi AS (SELECT al.image_id, al.component, min(struct_pack(d := round(abs(al.t - (a.t + (-b.t - a.t) * 5e-1)), 9), y := al.y, x := al.x)) AS m FROM al JOIN en ON al.image_id = en.image_id AND al.component = en.component GROUP BY ALL)
    SELECT en.image_id, en.component, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1, m.y AS y, m.x AS x FROM en JOIN mi ON en.image_id = mi.image_id AND en.component = mi.component"""


@query("component_ends", ("v_gt_px",), components_sql("v_gt_px", "cc") + shapes_sql("cc", "sh") + ENDS)
def _(t):
    return T.component_ends(P.components(t))


LINE = {"least_votes": 30, "max_gap": 5, "least_length": 20, "height": FRAME, "width": FRAME}


@query("strata_line_union", ("v_prob_px",), f", a AS ({AT('2e-1')}), b AS ({AT('5e-1')})" + lines_sql("a", "la", 30, 5, 20) + lines_sql("b", "lb", 30, 5, 20) + " SELECT image_id, y, x, min(level) AS level FROM (SELECT *, 2e-1 AS level FROM la UNION ALL SELECT *, 5e-1 FROM lb) GROUP BY image_id, y, x")
def _(p):
    return T.strata_lines(p, [0.2, 0.5], **LINE)


GATED = ", gates AS (SELECT image_id, y // 32 AS cy, x // 32 AS cx FROM v_prob_px GROUP BY ALL HAVING max(prob) >= 8e-1), kept AS (SELECT p.* FROM v_prob_px p SEMI JOIN gates g ON p.image_id = g.image_id AND p.y // 32 = cy AND p.x // 32 = cx), low AS (SELECT image_id, y, x FROM kept WHERE prob >= 1e-1), pred AS (SELECT image_id, y, x FROM kept WHERE prob >= 5e-1)"


@query("gated_line_pass", ("v_prob_px", "v_gt_px"), GATED + lines_sql("low", "ln", 30, 5, 20) + ", post AS (SELECT * FROM pred UNION SELECT * FROM ln)" + accounts_sql("pred", "post") + TOTALS)
def _(p, t):
    gates = p.groupBy("image_id", F.floor(F.col("y") / 32).alias("cy"), F.floor(F.col("x") / 32).alias("cx")).agg(F.max("prob").alias("gate"))
    return T.gated_line_pass(p, gates, 0.8, 0.5, 0.1, t, 32, **LINE)


SETTINGS = [(v, g) for v in (30, 40) for g in (3, 8)]


def _setting(i: int) -> str:
    n = f"(SELECT image_id, count(*) AS np FROM l{i} GROUP BY image_id)"
    return f"SELECT {i} AS setting, sum(tp)::BIGINT AS tp, (sum(np) - sum(tp))::BIGINT AS fp, (sum(nt) - sum(tp))::BIGINT AS fn FROM (SELECT count(*) AS tp FROM l{i} l SEMI JOIN v_gt_px t ON l.image_id = t.image_id AND l.y = t.y AND l.x = t.x) a, (SELECT count(*) AS np FROM l{i}) b, (SELECT count(*) AS nt FROM v_gt_px) c"


@query("detector_grid", ("v_pred_px", "v_gt_px"), "".join(lines_sql("v_pred_px", f"l{i}", v, g, 20) for i, (v, g) in enumerate(SETTINGS)) + ", s AS (" + " UNION ALL ".join(_setting(i) for i in range(4)) + f") SELECT CAST(setting AS INT) AS setting, tp, fp, fn, {q0('tp', 'tp + fp')} AS precision, {q0('tp', 'tp + fn')} AS recall, {q0('2 * tp', '2 * tp + fp + fn')} AS f1 FROM s")
def _(p, t):
    return T.detector_grid(p, t, [LINE | {"least_votes": v, "max_gap": g} for v, g in SETTINGS], AREA)


@query("classical_detector", ("v_prob_px", "v_gt_px"))
def _(p, t):
    lit = p.hint("merge").join(t.select("image_id").distinct(), "image_id", "left_semi")
    frame = lit.select("image_id", "y", "x", F.bround(F.col("prob") * 255).cast("int").alias("v"))
    return T.detector_scores(T.classical_detector(frame, FRAME, FRAME, (100.0, 300.0), missing=0, least_votes=30, max_gap=5, least_length=20), t, AREA)


@query("run_comparison", ("v_scored",), f", a AS (SELECT image_id, {CONFUSION} FROM v_scored GROUP BY image_id), b AS (SELECT image_id, {CONFUSION.replace('prob', 'prob2')} FROM v_scored GROUP BY image_id) SELECT image_id, b.tp - a.tp AS tp_change, b.fp - a.fp AS fp_change, a.tp = b.tp AND a.fp = b.fp AS same FROM a JOIN b USING (image_id)")
def _(s):
    return T.compare_runs(M.dense_counts(s, ["image_id"]), M.dense_counts(s, ["image_id"], prob="prob2"), ["image_id"], ["tp", "fp"])


def _pair_sql(a: str, b: str, k: int) -> str:
    near = lambda x, y: f"SELECT count(*) FILTER (EXISTS (SELECT 1 FROM cut{y} o WHERE o.image_id = i.image_id AND abs(o.y - i.y) <= {k} AND abs(o.x - i.x) <= {k})) AS hit, count(*) AS n FROM cut{x} i"
    p, r = "CAST(p.hit AS DOUBLE) / p.n", "CAST(r.hit AS DOUBLE) / r.n"
    names = {"1": "first", "2": "second", "3": "third"}
    return f"SELECT '{names[a]}-{names[b]}' AS pairing, {k} AS tolerance, round({p}, 6) AS precision, round({r}, 6) AS recall, {q0(f'2 * ({p}) * ({r})', f'({p}) + ({r})')} AS f1 FROM ({near(a, b)}) p, ({near(b, a)}) r"


CUTS_SQL = ", w AS (SELECT image_id, min(y) AS y0, min(x) AS x0 FROM v_gt_px GROUP BY image_id)" + "".join(f", cut{i} AS (SELECT p.image_id, p.y - y0 AS y, p.x - x0 AS x FROM ({src}) p JOIN w ON p.image_id = w.image_id AND p.y >= y0 AND p.y < y0 + 64 AND p.x >= x0 AND p.x < x0 + 64)" for i, src in ((1, "SELECT * FROM v_gt_px"), (2, "SELECT * FROM v_pred_px"), (3, AT("3e-1"))))


@query("annotation_scores", ("v_pred_px", "v_gt_px", "v_prob_px"), CUTS_SQL + " " + " UNION ALL ".join(_pair_sql(a, b, k) for a, b in ("12", "13", "23") for k in (0, 1, 2)))
def _(p, t, q):
    crops = t.groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0")).withColumn("name", F.col("image_id").cast("string"))
    return T.annotation_scores(t, p, q.where("prob >= 0.3"), crops, 64, [0, 1, 2])


SAMPLED = TIER + ", c AS (SELECT *, " + md5_of(3, "attempt", "image_id", "component") + """ AS h FROM (SELECT CAST(substr(crop_name, 6) AS BIGINT) // 20 AS image_id, crop_name AS component, tier, unnest(range(200)) AS attempt FROM tiers) x),
    t AS (SELECT tier, row_number() OVER (ORDER BY tier) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT tier FROM tiers)), quo AS (SELECT tier, 17 // n + CASE WHEN i <= 17 % n THEN 1 ELSE 0 END AS quota FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY attempt, tier ORDER BY h) AS r FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY r > quota, h) AS k FROM r JOIN quo USING (tier)),
    s AS (SELECT * FROM k WHERE k <= 17), f AS (SELECT image_id, component, tier FROM s WHERE attempt = (SELECT min(attempt) FROM (SELECT attempt FROM s GROUP BY attempt HAVING count(DISTINCT image_id) >= 15)))"""


def _comps(a):
    return S.tertiles(a.select(F.floor(F.substring("crop_name", 6, 20).cast("long") / 20).alias("image_id"), F.col("crop_name").alias("component"), "fp_pixels"), "fp_pixels")


@query("stratified_components", ("v_audit",), SAMPLED + " SELECT * FROM f")
def _(a):
    return T.stratified_components(_comps(a), 17, 3, 15)


@query("two_component_samples", ("v_audit",), SAMPLED + ", o AS (SELECT image_id, component, tier FROM c ANTI JOIN f USING (component) WHERE attempt = 0 ORDER BY " + md5_of(4, "image_id", "component") + " LIMIT 9) SELECT *, 1 AS sample FROM f UNION ALL SELECT *, 2 FROM o")
def _(a):
    return T.two_component_samples(_comps(a), 17, 9, 3, least_images=15)


STUDY = ("v_study", "v_params", "v_attributes")


@query("top_study_trials", STUDY, """, best AS (SELECT trial_id, number, value FROM v_study WHERE state = 'COMPLETE' ORDER BY value DESC, number LIMIT 20),
    p AS (SELECT trial_id, param_name, CASE WHEN json_extract(distribution_json, '$.attributes.choices') IS NULL THEN param_value ELSE CAST(json_extract_string(distribution_json, '$.attributes.choices[' || CAST(param_value AS INT) || ']') AS DOUBLE) END AS v FROM v_params)
    SELECT trial_id, number, round(value, 6) AS value, round(l.v, 6) AS learning_rate, round(w.v, 6) AS bce_weight, round(coalesce(CAST(a.value_json AS DOUBLE), b.v), 6) AS batch_size FROM best JOIN p l USING (trial_id) JOIN p w USING (trial_id) JOIN p b USING (trial_id) LEFT JOIN v_attributes a ON a.trial_id = best.trial_id AND a.key = 'batch_size'
    WHERE l.param_name = 'learning_rate' AND w.param_name = 'bce_weight' AND b.param_name = 'batch_size'""")
def _(t, p, a):
    return T.top_trials(t, t.where("value IS NOT NULL"), p, a, 20, ("learning_rate", "bce_weight"), ("batch_size",))


@query("trial_table", STUDY, """, a AS (SELECT trial_id, max(value_json) FILTER (key = 'batch_size') AS batch_size, max(json_extract_string(value_json, '$')) FILTER (key = 'note') AS note, CAST(max(value_json) FILTER (key = 'val_f1') AS DOUBLE) AS f FROM v_attributes GROUP BY trial_id)
    SELECT t.trial_id, number, state, round(value, 6) AS objective, batch_size, note, round(coalesce(f, value), 6) AS val_f1 FROM v_study t LEFT JOIN a USING (trial_id)""")
def _(t, p, a):
    return T.trial_table(t, t.where("value IS NOT NULL"), a, ["batch_size", "note"])


@query("annotation_problems", ("v_audit",), """, m AS (SELECT crop_name AS name, fp_pixels % 11 = 0 AS size, fp_pixels % 13 = 0 AS other, fp_pixels % 17 = 0 AND fp_pixels % 13 <> 0 AS every FROM v_audit WHERE stratum <> 1), e AS (SELECT crop_name AS name FROM v_audit WHERE stratum <> 2), v AS (SELECT crop_name AS name, verdict = 'uncertain' AS odd FROM v_audit WHERE verdict IS NOT NULL),
    j AS (SELECT coalesce(e.name, m.name, v.name) AS name, e.name IS NOT NULL AS e, m.name IS NOT NULL AS m, v.name IS NOT NULL AS v, size, other, every, odd FROM e FULL JOIN m ON e.name = m.name FULL JOIN v ON v.name = coalesce(e.name, m.name))
    SELECT name, unnest(list_filter([CASE WHEN e AND NOT m THEN 'missing mask' END, CASE WHEN m AND NOT e THEN 'extra mask' END, CASE WHEN size THEN 'wrong size' END, CASE WHEN other THEN 'other values' END, CASE WHEN every THEN 'all set' END, CASE WHEN e AND NOT v THEN 'missing verdict' END, CASE WHEN v AND NOT e THEN 'extra verdict' END, CASE WHEN odd THEN 'unknown verdict' END], lambda p: p IS NOT NULL)) AS problem FROM j""")
def _(a):
    n = F.col("fp_pixels")
    flag = lambda k: F.when(n % k == 0, 5).otherwise(0).cast("long")
    masks = a.where("stratum <> 1").select(F.col("crop_name").alias("name"), F.when(n % 11 == 0, 500).otherwise(528).alias("height"), F.lit(528).alias("width"), F.when(n % 17 == 0, 0).otherwise(9).cast("long").alias("unset"), F.lit(7).cast("long").alias("full"), flag(13).alias("other"))
    verdicts = a.where("verdict IS NOT NULL").select("crop_name", F.when(F.col("verdict") == "uncertain", "unsure").otherwise(F.concat(F.lit(" "), "verdict")).alias("verdict"))
    return files.annotation_problems(a.where("stratum <> 2").select(F.col("crop_name").alias("name")), masks, verdicts, 528)


@query("checked_verdicts", ("v_audit",), "SELECT crop_name, verdict FROM v_audit WHERE verdict IS NOT NULL")
def _(a):
    return files.check_verdicts(a.where("verdict IS NOT NULL").select(F.concat(F.lit(" "), "crop_name").alias("crop_name"), F.concat("verdict", F.lit(" ")).alias("verdict")))


@query("absent_files", ("v_manifest",), """ SELECT split, patch, 'patch_path' AS absent_column, split || '/p' || patch || '.png' AS absent_path FROM v_manifest WHERE patch % 7 = 0 UNION ALL SELECT split, patch, 'mask_path', '/data/root/' || split || '/m' || patch || '.png' FROM v_manifest WHERE patch % 5 = 0""")
def _(m):
    name = lambda kind: F.concat("split", F.lit(f"/{kind}"), F.col("patch").cast("string"), F.lit(".png"))
    manifest = m.select("split", "patch", name("p").alias("patch_path"), F.concat(F.lit("/data/root/"), name("m")).alias("mask_path"))
    here = m.where("patch % 7 <> 0").select(F.concat(F.lit("file:/data/root/"), name("p")).alias("path")).union(m.where("patch % 5 <> 0").select(F.concat(F.lit("hdfs://host:8020/data/root//"), name("m"))))
    # The same names in another folder are other files.
    elsewhere = m.select(F.concat(F.lit("file:/data/root/other/"), name("p")).alias("path"))
    return files.absent_files(manifest, here.union(elsewhere), ["patch_path", "mask_path"], "/data/root").select("split", "patch", "absent_column", "absent_path")


@query("reviewed_inference", ("v_study",), " SELECT trial_id, number, number % 2 = 0 AS trail_visible, number % 3 = 0 AS model_fired, 'r' || number % 4 AS reviewer FROM v_study")
def _(t):
    reviews = t.select("trial_id", (F.col("number") % 2 == 0).alias("trail_visible"), (F.col("number") % 3 == 0).alias("model_fired"), F.concat(F.lit("r"), (F.col("number") % 4).cast("string")).alias("reviewer"))
    return T.merge_reviews(t.select("trial_id", "number"), reviews, ["trial_id"], ["trail_visible", "model_fired"])


@query("review_summary", ("v_study",), " SELECT count(*) AS reviewed, count(*) FILTER (number % 2 = 0) AS trail_visible, count(*) FILTER (number % 3 = 0) AS model_fired FROM v_study")
def _(t):
    return T.review_summary(t.select((F.col("number") % 2 == 0).alias("trail_visible"), (F.col("number") % 3 == 0).alias("model_fired")), ["trail_visible", "model_fired"])


@query("patch_places", ("v_manifest",), " SELECT patch, CAST(patch % 97 * 528 AS INT) AS y, CAST(patch % 19 * 528 AS INT) AS x FROM v_manifest")
def _(m):
    name = F.concat(F.lit("p/"), D.patch_name(F.col("source_image"), F.col("patch") % 97 * 528, F.col("patch") % 19 * 528), F.lit("_image.png"))
    y, x = D.parse_patch(name)
    return m.select("patch", y.alias("y"), x.alias("x"))


@query("run_tags", ("v_trials",), " SELECT run, 'study_a' AS prefix, CAST(trial AS INT) AS trial, CAST(seed AS INT) AS seed FROM v_trials")
def _(t):
    tag = F.concat(F.lit("study_a_t"), F.col("trial").cast("string"), F.lit("_s"), F.col("seed").cast("string"))
    return t.select("run", *S.parse_tag(tag))


@query("scored_tiles", ("v_pred_px", "v_gt_px"), f""", c AS (SELECT g.image_id, y, x, coalesce(p.y % 200, 0) AS v FROM (SELECT DISTINCT image_id FROM v_gt_px) g CROSS JOIN (SELECT unnest(range(100)) AS y) a CROSS JOIN (SELECT unnest(range(100)) AS x) b LEFT JOIN v_pred_px p USING (image_id, y, x)),
    s AS (SELECT *, CAST(1 / (1 + exp(-(4 * (v / 255e0) - 1))) AS FLOAT) AS prob FROM c) SELECT CAST(image_id AS VARCHAR) AS path, y, x, round(CAST(prob AS DOUBLE), 6) AS prob FROM s WHERE prob >= 5e-1""")
def _(f, t):
    images = t.select("image_id").distinct().withColumns({"height": F.lit(100), "width": F.lit(100)})
    cut = P.cut_patches(images, P.inside(f, 100, 100).withColumn("v", F.col("y") % 200), t.limit(0), 100, 100)
    rasters = cut.select(F.col("image_id").cast("string").alias("path"), F.lit(100).alias("height"), F.lit(100).alias("width"), F.lit(1).alias("channels"), F.col("pixels").alias("data"))
    return files.scored_pixels(files.score_tiles(files.padded_tiles(rasters, 48), lambda: lambda v: 4 * v - 1), 0.5)


AUDITED = CUTS_SQL + """, crop AS (SELECT image_id, CAST(image_id AS VARCHAR) AS name, CASE WHEN image_id % 3 = 0 THEN 'quiet' ELSE 'boundary' END AS stratum, CASE WHEN image_id % 5 = 1 THEN 'uncertain' ELSE 'trail' END AS verdict FROM w),
    st AS (SELECT *, CASE WHEN verdict = 'uncertain' THEN 'uncertain' WHEN stratum = 'boundary' AND image_id NOT IN (SELECT image_id FROM cut2) THEN 'not_visible' ELSE 'scored' END AS status FROM crop)"""


def _audit_counts(name: str, a: str, b: str, k: int) -> str:
    near = lambda x, y: f"SELECT image_id, count(*) FILTER (EXISTS (SELECT 1 FROM cut{y} o WHERE o.image_id = i.image_id AND abs(o.y - i.y) <= {k} AND abs(o.x - i.x) <= {k})) AS hit, count(*) AS n FROM cut{x} i GROUP BY image_id"
    return f"SELECT name, stratum, status, '{name}' AS pairing, {k} AS tolerance, coalesce(p.hit, 0) AS ptp, coalesce(p.n - p.hit, 0) AS fp, coalesce(r.hit, 0) AS rtp, coalesce(r.n - r.hit, 0) AS fn FROM st LEFT JOIN ({near(a, b)}) p USING (image_id) LEFT JOIN ({near(b, a)}) r USING (image_id) WHERE status = 'scored'"


AUDITED += ", sc AS (" + " UNION ALL ".join(_audit_counts(n, a, b, k) for n, a, b in (("original_vs_reference", "1", "2"), ("model_vs_reference", "3", "2"), ("model_vs_original", "3", "1")) for k in (0, 2)) + ")"


def _audit(p, t, q):
    w = t.groupBy("image_id").agg(F.min("y").alias("y0"), F.min("x").alias("x0"))
    crops = w.select(F.col("image_id").cast("string").alias("name"), F.when(F.col("image_id") % 3 == 0, "quiet").otherwise("boundary").alias("stratum"), "image_id", "y0", "x0", F.when(F.col("image_id") % 5 == 1, "uncertain").otherwise("trail").alias("verdict"))
    return T.audit_scores(crops, t, p, q.where("prob >= 0.3"), 64, [0, 2], ("boundary",))


@query("audit_scores", ("v_pred_px", "v_gt_px", "v_prob_px"), AUDITED + " SELECT * FROM sc UNION ALL SELECT name, stratum, status, NULL, NULL, NULL, NULL, NULL, NULL FROM st WHERE status <> 'scored'")
def _(p, t, q):
    return _audit(p, t, q)


@query("audit_totals", ("v_pred_px", "v_gt_px", "v_prob_px"), AUDITED + f", tt AS (SELECT pairing, tolerance, sum(ptp) AS ptp, sum(fp) AS fp, sum(rtp) AS rtp, sum(fn) AS fn FROM sc WHERE stratum = 'boundary' GROUP BY ALL), r AS (SELECT *, ptp / nullif(ptp + fp, 0) AS p, rtp / nullif(rtp + fn, 0) AS r FROM tt) SELECT pairing, tolerance, {q0('ptp', 'ptp + fp')} AS precision, {q0('rtp', 'rtp + fn')} AS recall, {q0('2 * p * r', 'p + r')} AS f1 FROM r")
def _(p, t, q):
    return T.audit_totals(_audit(p, t, q), ("boundary",))


@query("audit_crop_list", BOTH, f", fp AS (SELECT * FROM v_pred_px p ANTI JOIN v_gt_px t ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.x), tp AS (SELECT * FROM v_pred_px p SEMI JOIN v_gt_px t ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.x), u AS (SELECT *, 'hit' AS stratum FROM tp UNION ALL SELECT *, 'miss' FROM fp), q AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY stratum, image_id ORDER BY {md5_of(5, 'image_id', 'y', 'x')}, image_id, y, x) <= 3) SELECT 'crop_' || lpad(CAST(row_number() OVER (ORDER BY {md5_of(2, 'stratum', 'image_id', 'y', 'x')}) AS VARCHAR), 4, '0') AS name, stratum, image_id, CAST(greatest(0, least(128, round_even(y - 32.0, 0))) AS INT) AS y0, CAST(greatest(0, least(128, round_even(x - 32.0, 0))) AS INT) AS x0 FROM q")
def _(p, t):
    picked = P.stored(D.quota_sample(P.hits(p, t), ["hit", "image_id"], 3, 5, "image_id", "y", "x"))  # read four times
    return T.audit_crops([("hit", picked.where("hit")), ("miss", picked.where("NOT hit"))], 64, FRAME, FRAME, 2)


@query("joined_image_statistics", ("v_manifest", "v_frame_px"), ", s AS (SELECT image_id, avg(v) AS image_mean, stddev_pop(v) AS image_std FROM v_frame_px GROUP BY image_id), i AS (SELECT DISTINCT source_image FROM v_manifest), k AS (SELECT source_image, row_number() OVER (ORDER BY source_image) - 1 AS image_id FROM i) SELECT m.source_image, m.patch, m.split, round(m.fraction, 6) AS fraction, round(image_mean, 6) AS image_mean, round(image_std, 6) AS image_std FROM v_manifest m JOIN k ON m.source_image = k.source_image LEFT JOIN s ON s.image_id = k.image_id")
def _(m, f):
    names = S.numbered(m.select("source_image").distinct(), "source_image")
    stats = D.image_statistics(f).select(F.col("image_id").alias("unit_no"), F.col("mean").alias("image_mean"), F.col("std").alias("image_std")).join(names, "unit_no")
    return D.attach_statistics(m, stats).select("source_image", "patch", "split", "fraction", "image_mean", "image_std")
