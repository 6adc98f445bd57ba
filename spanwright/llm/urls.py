"""URL filter: list rules first, then a logistic regression over hashed character n-grams of host and path.

The model is learnt from a small labelled table of URLs by gradient steps in dual form: each step needs only the
products of the labelled URLs with each other, a small matrix, so learning is one array expression over one row. The
weights of the `BUCKETS` hashed n-grams then become one constant array, and each URL is judged in its own row without
a shuffle. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
GRAM = 3
STEPS = 200
RATE = 0.5
DECAY = 0.01
MAX_LABELS = 500
"""Labelled URLs that are learnt from, the first by their order; learning takes their square."""

# The list rules, (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# URLs with labels, 1 for what a corpus should not have.
LABELLED = (
    ("https://www.cheap-pills.example/en/1", 1), ("http://cheap-pills.example.test/buy/now", 1), ("https://m.casino-win.example/play", 1),
    ("http://casino-win.example.test/en/77.html", 1), ("https://free-bets.example/odds/today", 1), ("http://www.free-bets.example.test/en/9", 1),
    ("https://spam-farm.example/links/3", 1), ("http://blog.spam-farm.example.test/en/12", 1), ("https://ads-track.example/pixel/5", 1),
    ("http://m.ads-track.example.test/click", 1), ("https://adult-x.example/video/8", 1), ("http://www.adult-x.example.test/en/4", 1),
    ("https://poker-bonus.example/win", 1), ("http://xxx-video.example/free", 1), ("https://buy-pills.example/cheap", 1), ("http://bet-casino.example/bonus", 1),
    ("https://www.library.example/en/410", 0), ("http://news.daily.example/fr/22/", 0), ("https://blog.garden.example/es/7", 0),
    ("http://m.weather.example/de/63.html", 0), ("https://school.example/en/300", 0), ("http://www.museum.example.test/en/5", 0),
    ("https://thing.example/en/120", 0), ("http://blog.thetion.example/en/88", 0), ("https://m.onthe.example.test/es/19", 0),
    ("http://www.andthe.example/fr/31", 0), ("https://thether.example/de/54/", 0), ("http://inganer.example.test/en/66?page=2", 0),
    ("https://travel.example/en/9", 0), ("http://recipes.example/es/140", 0), ("https://m.music.example/en/27.html", 0), ("http://docs.manual.example/en/3", 0),
    ("https://www.river.example.test/en/412.html", 0), ("http://m.forest.example.test/fr/9?page=2", 0), ("https://blog.castle.example.test/en/77", 0),
    ("http://bridge.example.test/es/5/", 0), ("https://www.thanther.example/en/58", 0), ("http://m.thorent.example/de/12", 0),
    ("https://blog.theand.example.test/fr/640.html", 0), ("http://ontheth.example.test/en/204", 0), ("https://www.erthing.example.test/es/31", 0),
    ("http://station.example/en/15.html", 0), ("https://m.harbour.example.test/en/18/", 0), ("http://www.theater.example/fr/402", 0),
    ("https://lythe.example.test/en/90", 0), ("http://blog.therest.example.test/de/7", 0), ("https://threth.example.test/en/39?ref=x", 0),
    ("http://www.stone.example.test/en/266", 0),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def buckets(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the n-grams of host and path, with marked ends, and one that every URL has."""
    def grams(text: Column, mark: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(GRAM))))

    marked = F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), F.when(F.length(path) >= GRAM, grams(path, "p")).otherwise(F.array().cast("array<string>")), F.array(F.lit("bias")))
    hosted = F.when(F.length(host) > 0, marked).otherwise(F.array(F.lit("bias")))
    return F.array_distinct(F.transform(hosted, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 6), 16, 10).cast("int") % BUCKETS))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> list[float]:
    """Weights of the buckets, learnt from (url_col, label_col in 0/1); null labels teach nothing, no labels give zeros.

    Repeated URLs count each. At most MAX_LABELS rows are taken, in order of the URL and label.
    """
    host, path = host_and_path(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).orderBy(url_col, label_col).limit(MAX_LABELS).select(
        F.struct(F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.col(label_col).cast("double").alias("y"), buckets(host, path).alias("b")).alias("r"))
    one = rows.agg(F.sort_array(F.collect_list("r")).alias("rows"))
    gram = F.transform("rows", lambda a: F.transform(F.col("rows"), lambda b: F.size(F.array_intersect(a["b"], b["b"])) / F.sqrt(F.size(a["b"]) * F.size(b["b"]))))

    def learn(products: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            def of(entry: Column, k: Column) -> Column:
                margin = F.aggregate(F.zip_with(F.get(products, k), state, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
                return F.get(state, k) * (1 - RATE * DECAY) + RATE * (entry["y"] - 1 / (1 + F.exp(-margin)))
            return F.transform(F.col("rows"), of)
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("rows", lambda r: F.lit(0.0)), step)

    learnt = one.select("rows", F.transform(F.array(gram), learn)[0].alias("alpha"))
    pairs = learnt.select(F.explode(F.arrays_zip("rows", "alpha")).alias("z")).select(
        F.explode("z.rows.b").alias("bucket"), (F.col("z.alpha") / F.sqrt(F.size("z.rows.b"))).alias("w"))
    weights = [0.0] * BUCKETS
    for r in pairs.groupBy("bucket").agg(F.sum("w").alias("w")).collect():  # BUCKETS rows at most
        weights[r.bucket] = r.w
    return weights


def judge(pages: DataFrame, weights: list[float], url_col: str = "url") -> DataFrame:
    """`pages` with host, path, rule, score and verdict (columns of these names are replaced).

    A rule fits its host and the subdomains where the path starts with the rule's; the longest wins and gives the verdict.
    Without a rule, score (the probability that the URL is unwanted) of 0.5 or more blocks. A URL that is null or has no `://` has an
    empty host and path and is judged by the model alone. Rows are independent; repeated rows get equal verdicts.
    """
    host, path = host_and_path(F.col(url_col))
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, verdict in reversed(rules):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule, by_rule = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(by_rule)
    table = F.array(*[F.lit(float(w)) for w in weights])
    own = F.transform(F.array(buckets(F.col("host"), F.col("path"))), lambda b: F.struct(
        F.aggregate(b, F.lit(0.0), lambda s, k: s + F.get(table, k)).alias("sum"), F.size(b).alias("n")))[0]
    return (pages.withColumn("host", host).withColumn("path", path).withColumn("__own", own)
            .withColumn("score", 1 / (1 + F.exp(-F.col("__own.sum") / F.sqrt(F.col("__own.n"))))).drop("__own")
            .withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(by_rule, F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))))
