"""The host reputation worked out by plain code: moments level by level, and the beta's log-odds."""

import math
import random
from collections import defaultdict

import pytest

from quarrylane.llm import url_filter

SUFFIXES = {"co.uk", "com", "net", "de"}


def levels(host):
    parts = host.split(".")
    suffix = ".".join(parts[-2:]) if ".".join(parts[-2:]) in SUFFIXES else parts[-1]
    n = suffix.count(".") + 2
    return ".".join(parts[-n:]), suffix


def strength(units, most=10000.0):
    """units: (n, bad, mean above)."""
    excess = sum(n * (x / n - m) ** 2 - m * (1 - m) for n, x, m in units)
    room = sum((n - 1) * m * (1 - m) for n, _, m in units)
    if room <= 0 or excess <= 0 or room / excess - 1 >= most:
        return most
    return max(1.0, room / excess - 1)


def digamma(x):
    h = 1e-5
    return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)


def trigamma(x):
    return sum(1 / (x + i) ** 2 for i in range(200_000)) + 1 / (x + 200_000)


def bound(a, b, z=1.645):
    return 1 / (1 + math.exp(z * math.sqrt(trigamma(a) + trigamma(b)) - (digamma(a) - digamma(b))))


def reputation(hosts):
    """{host: (mean, bound)} of {host: (n, bad)}."""
    seen = {h: v for h, v in hosts.items() if v[0]}
    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (n, x) in seen.items():
        d, s = levels(h)
        for total in (domains[d], suffixes[s]):
            total[0] += n
            total[1] += x
    whole = (sum(x for _, x in suffixes.values()) + 0.5) / (sum(n for n, _ in suffixes.values()) + 1)
    k = strength([(n, x, whole) for n, x in suffixes.values()])
    p1 = {s: (x + whole * k) / (n + k) for s, (n, x) in suffixes.items()}
    above = {d: p1[levels(d)[1]] for d in domains}
    k = strength([(n, x, above[d]) for d, (n, x) in domains.items()])
    p2 = {d: (x + above[d] * k) / (n + k) for d, (n, x) in domains.items()}
    k = strength([(n, x, p2[levels(h)[0]]) for h, (n, x) in seen.items()])
    out = {}
    for h, (n, x) in hosts.items():
        d, s = levels(h)
        mu = p2.get(d, p1.get(s, whole))
        a, b = x + mu * k, n - x + (1 - mu) * k
        out[h] = (a / (a + b), bound(a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    hosts, pages, outcomes = {}, [], []
    for d in ("good.com", "bad.com", "mixed.net", "farm.co.uk", "kein.de"):
        rate = rng.choice([0.02, 0.5, 0.95])
        for sub in ("", "a.", "b.", "c.x."):
            n = rng.choice([0, 1, 5, 60])
            bad = [int(rng.random() < rate) for _ in range(n)]
            hosts[sub + d] = (n, sum(bad))
            for x in [*bad, None]:
                pages.append((len(pages), f"https://{sub}{d}/p{len(pages)}"))
                if x is not None:
                    outcomes.append((len(pages) - 1, x))
    for h in ("new.com", "new.good.com", "other.org"):
        hosts[h] = (0, 0)
        pages.append((len(pages), f"http://{h.upper()}:80/"))
    got = {}
    for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect():
        got[r.host.removesuffix(":80")] = (r.posterior_mean, r.posterior_bound, r.verdict, r.rule)
    for h, (mean, low) in reputation(hosts).items():
        assert got[h][0] == pytest.approx(mean, abs=2e-6) and got[h][1] == pytest.approx(low, abs=2e-4)
        if got[h][3] is None and abs(low - 0.3) > 1e-3:
            assert got[h][2] == ("block" if low > 0.3 else "allow")
