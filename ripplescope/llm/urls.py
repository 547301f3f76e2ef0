"""URL filter: prefix rules first, then logistic regression on hashed n-grams.

Native: URLs are scored by built-in functions only. The model is fitted on the
driver from a small labelled table, bounded by ``MAX_LABELLED``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 5_000
BUCKETS = 1 << 12
GRAMS = (3, 4, 5)

# Hosts and paths of the labelled table; 1 is to be blocked.
LABELLED = [
    ("casino-bonus.example.com/play/slots", 1), ("www.bestcasino.example.net/poker/bonus", 1), ("bet.example.org/betting/odds", 1),
    ("freeporn.example.com/xxx/video", 1), ("adult.example.net/xxx/cams", 1), ("sexcams.example.org/live", 1),
    ("cheap-pills.example.com/viagra/buy", 1), ("pharma.example.net/cialis/order", 1), ("pills.example.org/buy-viagra-online", 1),
    ("login-verify.example.com/account/secure/update.php", 1), ("secure-bank.example.net/verify/password", 1), ("paypal-login.example.org/signin.php", 1),
    ("download-crack.example.com/keygen/free.exe", 1), ("warez.example.net/crack/serial", 1), ("torrents.example.org/free/download.exe", 1),
    ("click.example.com/ads/banner?aff=1", 1), ("track.example.net/affiliate/click", 1), ("ads.example.org/popup/banner", 1),
    ("cheap-watches.example.com/replica/rolex", 1), ("payday-loan.example.net/fast/cash", 1), ("winprize.example.org/lottery/claim", 1),
    ("escort.example.com/girls/xxx", 1), ("poker.example.net/casino/bonus", 1), ("spam.example.org/win/free/money", 1),
    ("www.library.example.com/books/history", 0), ("docs.example.net/guide/install", 0), ("wiki.example.org/article/science", 0),
    ("news.example.com/en/2021/05/story", 0), ("blog.example.net/en/853", 0), ("m.example.org/de/25", 0),
    ("university.example.com/research/papers", 0), ("museum.example.net/collections/art", 0), ("school.example.org/courses/math", 0),
    ("recipes.example.com/es/412", 0), ("garden.example.net/fr/plants", 0), ("travel.example.org/en/city/guide", 0),
    ("health.example.com/en/medicine/article", 0), ("forum.example.net/en/thread/100", 0), ("code.example.org/project/readme", 0),
    ("weather.example.com/fr/825", 0), ("music.example.net/en/album", 0), ("film.example.org/de/review", 0),
    ("www.city.example.com/services/contact", 0), ("data.example.net/api/docs", 0), ("journal.example.org/en/volume/7", 0),
    ("sport.example.com/en/result/12", 0), ("photo.example.net/fr/gallery", 0), ("kids.example.org/en/story/474.html", 0),
]

# Fixed values: (verdict, rule) in the order of the contract.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _grams(text: Column, mark: str, n: int) -> Column:
    last = F.length(text) - n + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
    return F.when(last >= 1, each).otherwise(F.array().cast("array<int>"))


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of ``^host$`` and ``^path$``, with repeats."""
    ends = lambda c: F.concat(F.lit("^"), c, F.lit("$"))
    return F.concat(*[_grams(ends(c), mark, n) for mark, c in (("h", host), ("p", path)) for n in GRAMS])


def fit(labelled: DataFrame, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> list[float]:
    """Weights of the buckets, the bias last, by gradient descent on the driver.

    ``labelled(url, label)`` is a small table; more than ``MAX_LABELLED`` rows are
    refused. Rows with a null url or label are left out.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("url is not null and label is not null").select(gram_buckets(host, path).alias("b"), F.col("label").cast("int").alias("y")).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    weights = [0.0] * (BUCKETS + 1)
    for _ in range(rounds if rows else 0):
        step: dict[int, float] = {}
        for b, y in rows:
            z = weights[BUCKETS] + sum(weights[i] for i in b) / max(1, len(b)) ** 0.5
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            step[BUCKETS] = step.get(BUCKETS, 0.0) + miss
            for i in b:
                step[i] = step.get(i, 0.0) + miss / len(b) ** 0.5
        for i, g in step.items():
            weights[i] -= rate * (g / len(rows) + decay * weights[i])
    return weights


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds ``host, path, rule, verdict, url_score`` to ``pages(url, ...)``.

    The longest rule whose host is the url's host or a parent domain of it, and
    whose path starts the url's path, decides; without one, the model blocks from
    ``threshold`` on. A null or malformed url has an empty host and path and is
    judged by the model, as is any other. Repeated rows are judged alike, an empty
    table gives an empty result, and columns of ``pages`` with the names that are
    added are replaced. ``url`` may be of any length. No shuffle takes place.
    """
    if labelled is None:
        own = F.array(*[F.struct(F.lit(f"http://{u}").alias("url"), F.lit(y).alias("label")) for u, y in LABELLED])
        labelled = pages.sparkSession.range(1).select(F.inline(own))
    weights = fit(labelled)
    host, path = split_url(F.col("url"))
    out = pages.drop("host", "path", "rule", "verdict", "url_score").withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules if rules is not None else RULES, key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((F.col("host") == domain) | F.endswith("host", F.lit(f".{domain}"))) & F.startswith("path", F.lit(f"/{start}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights[:BUCKETS])) + "]"), "array<double>")  # a constant, folded before the run
    grams = gram_buckets(F.col("host"), F.col("path"))
    total = F.aggregate(grams, F.lit(0.0), lambda s, i: s + F.get(table, i))
    z = F.lit(weights[BUCKETS]) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)))
    out = out.withColumn("url_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).withColumn("rule", rule)
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("url_score") >= threshold, "block").otherwise("allow")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "url_score")
