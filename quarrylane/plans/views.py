"""Domain tables derived from the driver's tables, in SQL for Spark and for DuckDB.

Integer arithmetic wherever the result is a key, so both engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("supplier", "part", "orders", "lineitem", "events", "documents", "labels")
FRAME = 192  # side of the frames that hold streaks
#: The image of a row, and rows that one task turns into pixels; a small file is else one task's, however many pixels come of it.
ROWS = {"supplier": ("s_suppkey div 10", 250), "events": ("event_id div 1000", 25_000)}


def _div(duck: bool, a: str, b: int) -> str:
    return f"(({a}) // {b})" if duck else f"(({a}) div {b})"


def hash_sql(duck: bool, text: str) -> str:
    """The first 8 hex digits of md5 as a number."""
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)" if duck else f"CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT)"


def _steps(duck: bool, n: int) -> str:
    return f"unnest(range({n}))" if duck else f"explode(sequence(0L, {n - 1}L))"


def _text(duck: bool, x: str) -> str:
    return f"CAST({x} AS VARCHAR)" if duck else f"CAST({x} AS STRING)"


def _centre(duck: bool, shift: str) -> str:
    return f"""SELECT s_suppkey, {_div(duck, 's_suppkey', 10)} AS image_id, i, (s_suppkey * 37) % 120 + i AS x,
        (s_suppkey * 53) % 120 + {_div(duck, 'i * (s_suppkey % 5)', 4)} + {shift} AS yc FROM (SELECT s_suppkey, {_steps(duck, 60)} AS i FROM supplier) s"""


def _whole(duck: bool, pixels: str) -> str:
    """Pixels of two tables, for Spark with each image in one part; view() fills in the number of parts."""
    return pixels if duck else f"SELECT /*+ REPARTITION(:parts, image_id) */ * FROM ({pixels}) w"


def sql(name: str, duck: bool) -> str:
    rows3, rows2 = ("unnest([-1, 0, 1])", "unnest([0, 1])") if duck else ("explode(array(-1, 0, 1))", "explode(array(0, 1))")
    gap = f"{hash_sql(duck, _text(duck, 's_suppkey') + " || '|' || " + _text(duck, _div(duck, 'i', 6)))} % 5 = 0"
    inside = f"y >= 0 AND y < {FRAME} AND x >= 0 AND x < {FRAME}"
    specks = f"SELECT {_div(duck, 'event_id', 1000)} AS image_id, (event_id * 7919 + user_id * 31) % {FRAME} AS y, (event_id * 104729 + user_id) % {FRAME} AS x, least(value / 100, 1e0) AS prob FROM events"
    line = f"SELECT image_id, yc + dy AS y, x, gap FROM (SELECT *, {rows2} AS dy, {gap} AS gap FROM ({_centre(duck, 's_suppkey % 3 - 1')}) c) d"
    k, trial = "o_custkey", _div(duck, "o_custkey", 100)
    part = lambda n, m: f"{_div(duck, k, n)} % {m}"
    pad = lambda x: f"lpad({_text(duck, x)}, 2, '0')"
    return {
        "v_scored": "SELECT l_suppkey AS image_id, l_suppkey * 16 + l_partkey % 16 AS patch_id, l_quantity / 50 AS prob, l_returnflag = 'R' AS target, l_discount * 10 AS prob2, l_tax * 12 AS gate FROM lineitem",
        "v_gt_px": f"SELECT DISTINCT image_id, y, x FROM (SELECT image_id, yc + dy AS y, x FROM (SELECT *, {rows3} AS dy FROM ({_centre(duck, '0')}) c) d) e WHERE {inside}",
        "v_pred_px": f"SELECT DISTINCT image_id, y, x FROM ({_whole(duck, f'SELECT image_id, y, x FROM ({line}) l WHERE NOT gap UNION ALL SELECT image_id, y, x FROM ({specks}) s')}) e WHERE {inside}",
        "v_prob_px": f"SELECT image_id, y, x, max(prob) AS prob FROM ({_whole(duck, f'SELECT image_id, y, x, CASE WHEN gap THEN 3e-1 ELSE 9e-1 END AS prob FROM ({line}) l UNION ALL SELECT image_id, y, x, prob FROM ({specks}) s')}) e WHERE {inside} GROUP BY image_id, y, x",
        "v_frame_px": "SELECT l_suppkey AS image_id, l_partkey % 64 AS y, l_orderkey % 64 AS x, CAST(max(l_quantity) * 4 + max(l_linenumber) AS INT) AS v FROM lineitem GROUP BY l_suppkey, l_partkey % 64, l_orderkey % 64",
        "v_manifest": f"SELECT 'ML1_' || {_text(duck, f'({k} % 6 + 2018) * 10000 + 101 + {part(6, 28)}')} || '_' || {pad(part(168, 24))} || {pad(part(4032, 60))} || {pad(part(241920, 60))} || '_red.fits_full.png' AS source_image, o_orderkey AS patch, CASE o_orderpriority WHEN '1-URGENT' THEN 'val' WHEN '2-HIGH' THEN 'test' ELSE 'train' END AS split, CASE WHEN o_orderstatus <> 'P' THEN 0e0 ELSE (o_orderkey % 1000 + 1) / 1e5 END AS fraction FROM orders",
        "v_history": "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS val_loss, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS train_loss, CASE WHEN event_type = 'error' THEN 0e0 ELSE least(value / 500, 1e0) END AS val_dice FROM events",
        "v_trials": f"SELECT {trial} AS trial, o_orderkey % 5 AS seed, o_orderkey AS run, o_totalprice / 500000 AS val_f1, 8 * (1 + {trial} % 3) AS batch_size, ({trial} % 12 + 1) / 1e4 AS learning_rate FROM orders",
        "v_catalogue": "SELECT CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand || '-' || p_type END AS satellite_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS length, p_partkey * 7 % 360 + 0e0 AS start_ra, p_partkey * 11 % 360 + 0e0 AS end_ra, p_partkey * 3 % 180 - 9e1 AS start_dec, p_partkey * 5 % 180 - 9e1 AS end_dec FROM part",
        "v_audit": "SELECT 'crop_' || " + _text(duck, "d.doc_id") + " AS crop_name, d.doc_id % 4 AS stratum, d.n_chars AS fp_pixels, d.lang = 'en' AS model_fired, coalesce(l.quality = 1, FALSE) AS reference_has_trail, d.source AS source_image, l.doc_id IS NOT NULL AS annotated, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'uncertain' WHEN l.quality = 1 THEN 'trail' ELSE 'no_trail' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "v_study": "SELECT o_orderkey AS trial_id, o_orderkey % 100000 AS number, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PRUNED' ELSE 'FAIL' END AS state, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) / 1e6 END AS value, 0 AS objective FROM orders",
        "v_params": """SELECT o_orderkey AS trial_id, 'learning_rate' AS param_name, (o_custkey % 1000 + 1) / 1e5 AS param_value, '{"name": "FloatDistribution", "attributes": {"low": 0.0, "high": 1.0}}' AS distribution_json FROM orders
            UNION ALL SELECT o_orderkey, 'bce_weight', o_orderkey % 10 / 1e1, '{"name": "FloatDistribution", "attributes": {"step": null}}' FROM orders UNION ALL SELECT o_orderkey, 'batch_size', o_orderkey % 4 + 0e0, '{"name": "CategoricalDistribution", "attributes": {"choices": [8, 16, 32, 64]}}' FROM orders""",
        "v_attributes": f"""SELECT o_orderkey AS trial_id, 'batch_size' AS key, '24' AS value_json FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'val_f1', '0.' || {pad('o_custkey % 90 + 10')} FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'note', '"run ' || {_text(duck, 'o_custkey')} || '"' FROM orders WHERE o_orderkey % 2 = 0""",
    }[name]


def parts(table: DataFrame, rows: int) -> int:
    return max(1, -(-table.count() // rows))


def spread(table: DataFrame, key: str, rows: int, n: int | None = None) -> DataFrame:
    """A table in parts of about so many rows, or in n parts."""
    return table.repartition(n or parts(table, rows), F.expr(key))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the tables in sf_dir.  Tables that pixels are made of are cut by images into parts that
    grow in number with their rows, so all pixels of an image are in one part."""
    text = sql(name, duck=False)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text}
    if name.endswith("_px"):
        n = sum(parts(d, ROWS[t][1]) for t, d in used.items() if t in ROWS)
        used = {t: spread(d, *ROWS[t], n) if t in ROWS else d for t, d in used.items()}
        text = text.replace(":parts", str(n))
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: body over the domain tables named."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({sql(n, duck=True)})" for n in names) + " " + body
