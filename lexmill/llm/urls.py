"""URL filter: rules by host and path, and logistic regression on hashed character n-grams.

Features of a URL are the distinct n-grams of 3 to 5 characters of ``^host$`` and of
its path, each hashed to one of DIMENSIONS buckets; all non-zero features have the
same value 1/sqrt(count). Weights are fitted by gradient steps with momentum, each of
which is one aggregation over the small labelled table, and end as one literal array
of fixed size in the scoring expression. Scoring is a projection of the scan: nothing
is shuffled, and no Python runs on the rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.tables import table

DIMENSIONS = 4096
GRAMS = (3, 4, 5)
STEPS, RATE, MOMENTUM, L2 = 40, 30.0, 0.8, 1e-4
#: The labelled table may hold this many rows at most; more are refused, not dropped.
MAX_LABELLED = 10_000
#: (host, path) of rules; a host stands for itself and its subdomains.
BLOCK = (("com", "/en/"), ("example.net", "/de/8"), ("org", "/es/"))
ALLOW = (("example.com", "/en/7"), ("net", "/de/"))

BAD_WORDS = ("casino-win", "free-bets", "cheap-pills", "spam-farm", "ads-track", "adult-x", "poker-bonus", "xxx-cams", "payday-loan", "viagra-shop", "click-ads", "lottery-prize", "slots-win", "adult-cams", "spam-links", "track-pixel", "bets-casino", "pills-online", "free-prize", "crack-warez")
GOOD_WORDS = ("news", "library", "university", "museum", "gardening", "recipes", "weather", "history-notes", "open-docs", "travel-diary", "city-council", "astronomy", "knitting", "chess-club", "river-maps", "bird-watch", "teachers", "orchestra", "hospital", "bookshop")
SYLLABLES = ("ba", "te", "ri", "on", "ea", "lo", "mun", "der", "sha", "vel", "kor", "in", "th", "er", "ou", "an")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 for block). Bad and good host words, and made-up good names, over some paths."""
    ends = ("site.com", "example.com", "example.net", "example.org", "pages.net", "host.org")
    paths = ("/en/12", "/de/345/", "/a/index.html", "/fr/78", "/es/901.html", "/en/6543")
    rows = []
    for i, (bad, good) in enumerate(zip(BAD_WORDS, GOOD_WORDS, strict=True)):
        for k in range(3):
            at = (i + 2 * k) % 6
            made = "".join(SYLLABLES[(i * 5 + k * 3 + j * (k + 2)) % len(SYLLABLES)] for j in range(3))
            place = f".{ends[at]}{paths[(at + i) % 6]}"
            rows += [(f"http://{('', 'www.', 'm.')[k]}{bad}{place}", 1), (f"https://{('', 'www.', 'blog.')[k]}{good}{place}", 0), (f"https://{('', 'm.', 'blog.')[k]}{made}{place}", 0)]
    return rows


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty if there is none."""
    rest = F.substring_index(_rest(url), "#", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #."""
    rest = F.substring_index(F.substring_index(_rest(url), "#", 1), "?", 1)
    slash = F.instr(rest, "/")
    return F.when(slash > 0, rest.substr(slash, F.length(rest))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def features(host: Column, path: Column) -> Column:
    """Distinct buckets, from 1, of the character n-grams of host and path."""
    def grams(kind: str, text: Column, n: int) -> Column:
        count = F.length(text) - (n - 1)
        starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.pmod(F.xxhash64(F.lit(kind), text.substr(i, F.lit(n))), F.lit(DIMENSIONS)) + 1).cast("int"))

    texts = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path))
    return F.array_distinct(F.concat(*(grams(kind, text, n) for kind, text in texts for n in GRAMS)))


def _margin(buckets: Column, weights: list[float], bias: float) -> Column:
    held = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")  # folded to one literal
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.element_at(held, b))
    return F.lit(float(bias)) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and bias from a small table of columns url and label (1: block). Null labels are not used."""
    rows = labelled.filter("label is not null and url is not null").select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("b"), F.col("label").cast("double").alias("y"))
    rows = rows.coalesce(1).cache()
    n = rows.count()
    if n > MAX_LABELLED:
        raise ValueError(f"{n} labelled rows; at most {MAX_LABELLED} are meant")
    weights, bias, speed, bias_speed = [0.0] * DIMENSIONS, 0.0, [0.0] * DIMENSIONS, 0.0
    for _ in range(STEPS if n else 0):
        z = _margin(F.col("b"), weights, bias)
        error = rows.select("b", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("y")).alias("e"))
        slopes = error.select(F.explode(F.concat(F.array(F.lit(0)), F.col("b"))).alias("k"), F.col("e"), F.sqrt(F.greatest(F.size("b"), F.lit(1))).alias("s"))
        summed = slopes.groupBy("k").agg(F.sum(F.col("e") / F.when(F.col("k") == 0, F.lit(1.0)).otherwise(F.col("s"))).alias("g")).collect()  # DIMENSIONS + 1 rows at most
        step = [L2 * w for w in weights]
        for k, g in summed:
            if k:
                step[k - 1] += g / n
            else:
                bias_speed = MOMENTUM * bias_speed - RATE * 0.1 * g / n
        speed = [MOMENTUM * v - RATE * g for v, g in zip(speed, step, strict=True)]
        weights = [w + v for w, v in zip(weights, speed, strict=True)]
        bias += bias_speed
    rows.unpersist()
    return weights, bias


def _rules() -> list[tuple[str, str, str]]:
    """(host, path, verdict), the longest first."""
    return sorted([(h, p, "block") for h, p in BLOCK] + [(h, p, "allow") for h, p in ALLOW], key=lambda r: (-len(r[0] + r[1]), r))


def judge(pages: DataFrame, weights: list[float], bias: float, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict and the model's score (a probability of block).

    A null url, or one without ://, has an empty host and path, no rule, and the
    model's verdict on no features. Null ids and repeated rows are kept as they are;
    no other column is read. No rows: no rows.
    """
    url = F.coalesce(F.col("__url"), F.lit(""))
    parts = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule = verdict = None
    for host, path, says in reversed(_rules()):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(F.lit(None) if rule is None else rule)
        verdict = F.when(fits, F.lit(says)).otherwise(F.lit(None) if verdict is None else verdict)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(features(F.col("host"), F.col("path")), weights, bias)))
    scored = parts.select("__id", "host", "path", rule.cast("string").alias("rule"), verdict.cast("string").alias("__said"), score.alias("score"))
    return scored.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__said", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


@cache
def _fitted(spark: SparkSession) -> tuple[list[float], float]:
    return fit(labelled_table(spark))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, bias = _fitted(spark)
    return judge(table(spark, sf_dir, "pages"), weights, bias)


QUERIES = {"op10_url_filter": op10_url_filter}
#: The fitted weights are not SQL; the query is tested against a brute-force version and on held-out hosts.
ORACLES: dict[str, str] = {}
