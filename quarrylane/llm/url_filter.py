"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix.  Each level has a
beta prior whose mean is the shrunk rate of the level above and whose strength comes from the
spread of the level's rates round those means (moments of the beta-binomial).  A host is blocked
when the lower quantile of its beta posterior is above the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .common import stored, table

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A suffix is the last label, or a generic second level under a country code (there is no list of
#: public suffixes here); an address of numbers is its own domain under the suffix "ip".
_SUFFIX = r"((?:(?:co|com|org|net|ac|gov|edu|or|ne|go|mil|sch|ltd|plc|gob|nom|info|biz|web)[.][a-z][a-z])|[^.]+)$"
_ADDRESS = "regexp_extract(bare, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$|^.*:.*$', 0) <> ''"


def _rule_case(rules: Sequence[tuple[str, str]], column: int) -> str:
    parts = []
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule[0].partition("/")
        quoted = [x.replace("'", "''") for x in (host, f".{host}", f"/{path}", rule[column])]
        parts.append("WHEN (host = '{}' OR right(host, {}) = '{}') AND left(path, {}) = '{}' THEN '{}'".format(quoted[0], len(host) + 1, quoted[1], len(path) + 1, quoted[2], quoted[3]))
    return f"CASE {' '.join(parts)} END" if parts else "CAST(NULL AS STRING)"


def _strength(units: str, most: float) -> str:
    """Prior strength of a level, held between 1 and `most`, from units (n, x, mu: the mean of the
    level above).  With correlation r between the outcomes of one unit, n (x / n - mu) ** 2 is
    mu (1 - mu) (1 + (n - 1) r) on average; the strength is 1 / r - 1."""
    return f"""SELECT CASE WHEN coalesce(room, 0) <= 0 OR excess * ({most:e} + 1) <= room THEN {most:e} ELSE greatest(1e0, room / excess - 1) END AS strength
        FROM (SELECT sum(n * power(CAST(x AS DOUBLE) / n - mu, 2) - mu * (1 - mu)) AS excess, sum((n - 1) * mu * (1 - mu)) AS room FROM {units}) moments"""


def _log_gamma_slopes(x: str) -> tuple[str, str]:
    """First and second derivative of the logarithm of gamma (series at x + 2, stepped down)."""
    y = f"({x} + 2)"
    first = f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) - 1 / {x} - 1 / ({x} + 1))"
    return first, f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y}) + 1 / ({x} * {x}) + 1 / (({x} + 1) * ({x} + 1)))"


def _lower_quantile(a: str, b: str, z: float) -> str:
    """The quantile z deviations below the middle of a beta distribution, by its log-odds, whose
    mean and variance are exact and whose shape is near normal."""
    (da, va), (db, vb) = _log_gamma_slopes(a), _log_gamma_slopes(b)
    return f"1 / (1 + exp({z:e} * sqrt({va} + {vb}) - ({da} - {db})))"


def _cut(pages: str) -> str:
    return f"""
        SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
        FROM (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM {pages}) cut"""


def hosts_sql(pages: str, outcomes: str) -> str:
    """Labelled pages and bad ones of each host, with its suffix and registered domain."""
    return f"""
        SELECT bare, CASE WHEN {_ADDRESS} THEN 'ip' ELSE regexp_extract(bare, '(?:^|[.]){_SUFFIX}', 1) END AS suffix,
            CASE WHEN {_ADDRESS} THEN bare ELSE regexp_extract(bare, '([^.]+[.])?{_SUFFIX}', 0) END AS domain, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS x
        FROM (SELECT n.bare, o.bad FROM ({_cut(pages)}) n LEFT JOIN {outcomes} o ON n.page_id = o.page_id) j GROUP BY bare"""


def verdict_sql(pages: str, hosts: str, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.3, z: float = 1.645, most: float = 10000.0) -> str:
    """Verdicts on `pages` (page_id, url), given the table that hosts_sql makes."""
    return f"""
    WITH ruled AS (
        SELECT page_id, host, path, bare, {_rule_case(rules, 0)} AS rule, {_rule_case(rules, 1)} AS ruled FROM ({_cut(pages)}) n),
    seen AS (SELECT * FROM {hosts} WHERE n > 0),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM seen GROUP BY domain, suffix),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY suffix),
    whole AS (SELECT coalesce((sum(x) + 5e-1) / (sum(n) + 1e0), 5e-1) AS m FROM suffixes),
    s1 AS ({_strength("(SELECT n, x, (SELECT m FROM whole) AS mu FROM suffixes) u", most)}),
    p1 AS (SELECT suffix, (x + (SELECT m FROM whole) * (SELECT strength FROM s1)) / (n + (SELECT strength FROM s1)) AS mean FROM suffixes),
    s2 AS ({_strength("(SELECT n, x, p1.mean AS mu FROM domains d JOIN p1 ON d.suffix = p1.suffix) u", most)}),
    p2 AS (SELECT d.domain, (d.x + p1.mean * (SELECT strength FROM s2)) / (d.n + (SELECT strength FROM s2)) AS mean FROM domains d JOIN p1 ON d.suffix = p1.suffix),
    s3 AS ({_strength("(SELECT n, x, p2.mean AS mu FROM seen h JOIN p2 ON h.domain = p2.domain) u", most)}),
    prior AS (
        SELECT h.bare, n, x, coalesce(p2.mean, p1.mean, (SELECT m FROM whole)) AS mu, (SELECT strength FROM s3) AS strength
        FROM {hosts} h LEFT JOIN p2 ON h.domain = p2.domain LEFT JOIN p1 ON h.suffix = p1.suffix),
    post AS (SELECT bare, n, x, x + mu * strength AS a, n - x + (1 - mu) * strength AS b FROM prior),
    judged AS (
        SELECT bare, n AS host_labelled, x AS host_bad, a / (a + b) AS mean, {_lower_quantile("a", "b", z)} AS bound FROM post)
    SELECT r.page_id, r.host, r.path, r.rule,
        CASE WHEN r.rule IS NOT NULL THEN r.ruled WHEN j.bound > {threshold:e} THEN 'block' ELSE 'allow' END AS verdict,
        CAST(j.host_labelled AS BIGINT) AS host_labelled, CAST(j.host_bad AS BIGINT) AS host_bad,
        round(CAST(j.mean AS DOUBLE), 6) AS posterior_mean, round(CAST(j.bound AS DOUBLE), 6) AS posterior_bound
    FROM ruled r LEFT JOIN judged j ON r.bare = j.bare"""


def url_filter(pages: DataFrame, outcomes: DataFrame, **options) -> DataFrame:
    """Judges every row of `pages` (page_id, url); `outcomes` (page_id, bad 0/1) are labelled pages.

    A null url, or one without '://', has empty host and path and is judged as the host ''.
    Outcomes with a null page_id or a null bad count for nothing; a page labelled twice counts
    twice; without any outcomes the prior is 0.5 with its largest strength, so all is allowed or
    blocked by the threshold alone.  Repeated pages give repeated rows.  Other columns of either
    table are ignored.  Rules win over the reputation; of several that fit the longest wins.
    Hosts are counted before they are joined to pages, so a hot host is one row of that table.
    """
    spark = pages.sparkSession
    pages, outcomes = pages.select("page_id", "url"), outcomes.select("page_id", "bad").where("bad IS NOT NULL AND page_id IS NOT NULL")
    hosts = stored(spark.sql(hosts_sql("{pages}", "{outcomes}"), pages=pages, outcomes=outcomes), "hosts")
    return spark.sql(verdict_sql("{pages}", "{hosts}", **options), pages=pages, hosts=hosts)


#: The number at the end of a page's path is that of the document it shows; its label is the page's outcome.
_OUTCOMES = """SELECT p.page_id, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 ELSE 0 END AS bad
    FROM (SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]{1,18})[^/0-9]*(?:[?#].*)?$', 1), '') AS BIGINT) AS doc_id FROM %s) p
    JOIN %s l ON p.doc_id = l.doc_id"""


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    outcomes = spark.sql(_OUTCOMES.replace("{1,18}", "{{1,18}}") % ("{pages}", "{labels}"), pages=pages, labels=labels)
    return url_filter(pages, outcomes)


ORACLE = verdict_sql("pages", f"({hosts_sql('pages', '(' + _OUTCOMES % ('pages', 'labels') + ')')}) hosts_of").replace("hosts_of h LEFT", "h LEFT")
