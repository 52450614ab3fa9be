"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Scoring is DataFrame expressions only. The weights are whole numbers, so that
sums don't depend on order and SQL gives the same verdicts.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The labelled table: hosts and paths that a filter should block, and such that it should let pass.
BLOCKED = """
casino-win.example.com/en/12 www.casino-royal.net/play best-casino.org/bonus online-casino.example.net/slots
free-bets.example.org/en/4 m.free-bets.net/odds bet-now.example.com/fr/77 sports-bets.example.net/en/3
cheap-pills.example.net/en/9 blog.cheap-pills.org/de/5 buy-pills.example.com/shop cheap-meds.example.org/en/21
adult-x.example.net/fr/780 m.adult-x.org/en/2 adult-video.example.com/en/33 xxx-adult.example.net/clips
spam-farm.example.org/en/618 www.spam-farm.com/en/88 link-spam.example.net/de/41 spam-links.example.com/out
ads-track.example.com/en/5 m.ads-track.net/fr/10 ad-tracker.example.org/pixel track-ads.example.net/es/3
poker-win.example.com/en/8 win-prizes.example.net/claim free-pills.example.org/en/1 free-casino.example.com/en/6
""".split()
PASSED = """
news.example.com/en/12 www.museum.example.org/en/4 blog.river.example.net/fr/77 garden.example.com/en/3
m.weather.example.net/en/9 library.example.org/de/5 school.example.com/courses docs.example.org/en/21
therther.example.net/fr/780 m.thonion.example.org/en/2 www.tionha.example.com/en/33 ththre.example.net/de/41
blog.nation.example.org/en/618 www.ereder.example.com/en/88 ingerst.example.net/de/41 blog.thandor.example.com/en/5
m.thin.example.net/fr/10 www.ththat.example.org/es/3 history.example.net/es/3 science.example.com/en/8
www.theatre.example.com/fr/17 blog.ththing.example.net/en/19 m.bakery.example.com/en/45 open-data.example.net/en/7
www.well-being.example.com/de/2 city-council.example.net/en/11 thanre.example.com/en/96 tionst.example.net/es/51
m.hills.example.com/en/50 blog.tention.example.net/en/61 blog.streets.example.com/de/30 m.thernd.example.com/en/14
""".split()
BUCKETS = 1 << 14
SIZES = (3, 4)
UNIT = 10_000


def grams(host: str, path: str) -> list[str]:
    marked = (f"h<{host}>", f"p{path}")
    return [kind[0] + s[i : i + n] for kind in marked for s in (kind[1:],) for n in SIZES for i in range(len(s) - n + 1)]


def bucket(gram: str) -> int:
    return int(md5(gram.encode()).hexdigest()[:4], 16) % BUCKETS


def table() -> list[tuple[int, str]]:
    """(label, host and path) of the labelled table; 1 is to be blocked."""
    return [(label, u) for label, urls in ((1, BLOCKED), (0, PASSED)) for u in urls]


def fit(rows: list[tuple[int, str]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[tuple[int, ...], int]:
    """Weights in UNITs for each bucket, and the bias; gradient descent over labelled hosts and paths."""
    hits = [(y, buckets_of(u)) for y, u in rows]
    w, bias = [0.0] * BUCKETS, -1.0
    for _ in range(rounds):
        for y, hit in hits:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, bias + sum(w[b] for b in hit)))))
            step = rate * (p - y) / len(hit)
            for b in hit:
                w[b] -= step + decay * rate * w[b] / len(hits)
            bias -= step
    return tuple(round(x * UNIT) for x in w), round(bias * UNIT)


def buckets_of(url: str) -> list[int]:
    host, _, path = url.partition("/")
    return [bucket(g) for g in grams(host, f"/{path}")]


@lru_cache
def weights() -> tuple[tuple[int, ...], int]:
    """fit() of the labelled table."""
    return fit(table())


def _table() -> Column:
    return F.split(F.lit(",".join(map(str, weights()[0]))), ",").cast("array<int>")


def _sum(text: Column, kind: str) -> Column:
    total = F.lit(0).cast("long")
    for n in SIZES:
        seen = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        at = lambda g: F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(kind), g), "UTF-8")), 1, 4), 16, 10).cast("int") % BUCKETS
        total = total + F.aggregate(seen, F.lit(0).cast("long"), lambda s, g: s + F.get(_table(), at(g)))
    return total


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest fitting rule decides, else the regression. A url that is null
    or has no ``://`` has empty host and path, no rule, and passes by the bias.
    Rows that repeat get a row each; an empty table gives none. Other columns
    are ignored.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # a longer rule wraps the shorter ones
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    score = _sum(F.concat(F.lit("<"), F.col("host"), F.lit(">")), "h") + _sum(F.col("path"), "p") + F.lit(weights()[1])
    judged = base.select("*", rule.alias("rule"), verdict.alias("ruled"), score.alias("units"))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("units") > 0, "block").otherwise("allow")).alias("verdict"),
        F.round(1 / (1 + F.exp(-F.col("units") / UNIT)), 6).alias("block_score"),
    )


def oracle() -> str:
    def total(text: str, kind: str) -> str:
        return " + ".join(
            f"coalesce(list_sum(list_transform(range(1, length({text}) - {n} + 2), lambda i: w[(('0x' || substr(md5('{kind}' || substr({text}, i, {n})), 1, 4))::INT % {BUCKETS}) + 1])), 0)"
            for n in SIZES
        )

    rule = verdict = ""
    for kind, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = rule + f" {fits} THEN '{h}{p}'", verdict + f" {fits} THEN '{kind}'"
    marked = "('<' || host || '>')"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
base AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT *, {weights()[1]} + {total(marked, 'h')} + {total('path', 'p')} AS units
           FROM base, (SELECT [{','.join(map(str, weights()[0]))}]::INT[] AS w))
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END, CASE WHEN units > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       round(1 / (1 + exp(-units / {float(UNIT)})), 6) AS block_score
FROM judged
"""
