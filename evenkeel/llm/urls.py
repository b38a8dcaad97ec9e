"""URL filter: longest matching rule, else logistic regression on hashed character n-grams of host and path.

Everything is a column expression or a JVM-side DataFrame transformer; no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled URLs that the classifier learns from when no other table is given; 1: block.
LABELLED = [(u, 1) for u in """
https://www.casino-royal.example.com/en/11 http://m.online-casino.example.net/de/7021.html https://big-win.example.org/fr/94/
http://casino-slots.example.net/es/380?ref=x https://jackpot-win.example.com/en/5512 http://blog.win-money.example.com/en/77#top
https://free-bets.example.org/en/6100/ http://sport-bets.example.com/de/42 https://www.bets-online.example.net/fr/9034.html
http://best-bets.example.com/es/18/ https://free-spins.example.net/en/2207 http://free-cash.example.org/en/640?page=2
https://cheap-pills.example.net/en/35 http://www.pills-shop.example.com/de/871/ https://diet-pills.example.org/fr/1290.html
http://cheap-meds.example.com/en/4406#top https://m.cheap-watches.example.net/es/5 http://buy-pills.example.org/en/733
https://adult-x.example.org/en/902 http://www.adult-cams.example.com/fr/61/ https://x-adult.example.net/de/3308.html
http://adult-videos.example.com/en/19?ref=x https://xxx-adult.example.org/es/470 http://m.adult-dating.example.net/en/8
https://spam-farm.example.com/en/2218/ http://link-farm.example.net/de/57 https://www.spam-mail.example.org/fr/640.html
http://content-farm.example.com/en/9915#top https://seo-spam.example.net/en/31 http://spam-links.example.org/es/206/
https://ads-track.example.org/en/114 http://click-track.example.com/de/8730 https://pop-ads.example.net/fr/22/
http://www.ads-server.example.com/en/4031.html https://track-ads.example.org/en/7 http://m.ads-click.example.net/es/955?page=2
""".split()] + [(u, 0) for u in """
https://www.example.org/en/35 http://news.example.com/en/4406#top https://blog.example.net/de/871/ http://m.example.org/fr/1290.html
https://library.example.com/es/18/ http://garden.example.net/en/902 https://www.history.example.org/en/114 http://river.example.com/de/42
https://blog.mountain.example.net/en/77#top http://m.weather.example.com/fr/94/ https://school.example.org/en/6100/ http://museum.example.net/es/380?ref=x
https://www.kitchen.example.com/en/11 http://music.example.org/de/7021.html https://m.science.example.net/fr/9034.html http://travel.example.com/en/5512
https://blog.hartein.example.org/en/2207 http://tonethe.example.com/en/640?page=2 https://onthin.example.net/de/3308.html http://www.erander.example.org/fr/61/
https://stonble.example.com/en/19?ref=x http://m.thenre.example.net/es/470 https://reston.example.org/en/8 http://ingthor.example.com/en/2218/
https://blog.lethan.example.net/de/57 http://wherea.example.org/fr/640.html https://www.shenton.example.com/en/9915#top http://therand.example.net/en/31
https://m.andher.example.org/es/206/ http://edther.example.com/en/733 https://thention.example.net/de/8730 http://www.oureth.example.org/fr/22/
https://blog.onnder.example.com/en/4031.html http://hethin.example.net/en/7 https://stherly.example.org/es/955?page=2 http://inthat.example.com/es/5
https://m.forest.example.net/en/3811 http://www.bakery.example.org/de/206/ https://blog.theatre.example.com/fr/48.html http://bridge.example.net/en/5127/
https://harbour.example.org/en/69 http://m.village.example.com/es/1044#top https://www.physics.example.net/en/823?page=2 http://poetry.example.org/de/17
https://teach.example.com/en/2950/ http://blog.farmer.example.net/fr/311 https://www.winter.example.org/en/74.html http://tracks.example.com/de/6602
https://m.atlas.example.net/en/905?ref=x http://www.better.example.org/en/38/ https://freedom.example.com/es/7719 http://adventure.example.net/en/450#top
""".split()]


@dataclass(frozen=True)
class Settings:
    """``sizes``: lengths of the n-grams; ``features``: hash buckets; ``threshold``: chance from which a URL is blocked."""

    sizes: tuple[int, ...] = (3, 4)
    features: int = 1 << 14
    regularisation: float = 0.01
    iterations: int = 60
    threshold: float = 0.5


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _grams(text: Column, n: int, mark: str) -> Column:
    """All runs of ``n`` characters, marked; linear in the length of the text."""
    chars = F.split(text, "")
    run = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(F.lit(mark), *[F.get(c, i + k) for k in range(n)]))
    return F.when(F.length(text) >= n, F.flatten(F.transform(F.array(chars), run))).otherwise(F.array().cast("array<string>"))


def _featured(df: DataFrame, host_text: Column, path_text: Column, s: Settings) -> DataFrame:
    grams = F.concat(*[_grams(F.concat(F.lit("^"), host_text, F.lit("$")), n, f"h{n}") for n in s.sizes],
                     *[_grams(F.concat(F.lit("^"), path_text, F.lit("$")), n, f"p{n}") for n in s.sizes])
    tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=s.features, binary=True)
    return tf.transform(df.withColumn("_grams", grams)).drop("_grams")


def fit(labelled: DataFrame, s: Settings = Settings(), url_col: str = "url", label_col: str = "label") -> LogisticRegressionModel:
    """Learn from a small table of labelled URLs (label 1: block); rows with a null are left out."""
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1))
    rows = rows.select(F.col(url_col).alias("_url"), F.col(label_col).cast("double").alias("_label"))
    return LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=s.iterations, regParam=s.regularisation
                              ).fit(_featured(rows, host(F.col("_url")), path(F.col("_url")), s))


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def best_rule(host_text: Column, path_text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits as ``struct(rule, verdict)``, null if none fits.

    A rule fits its host and all subdomains whose path starts with the rule's. Lengths are of host and path
    together; of equally long rules the one with the longer host wins.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    fits = lambda r: ((host_text == r[1]) | host_text.endswith(f".{r[1]}")) & path_text.startswith(r[2])
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ranked],
                      F.lit(None).cast("struct<rule:string,verdict:string>"))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str, str]], s: Settings = Settings(),
          url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``block_chance`` and ``verdict`` (``allow`` or ``block``) to every row.

    The verdict is the rule's, or the classifier's where no rule fits. All rows and columns stay, repeated rows too; a
    column that has the name of an output is replaced. A URL that is null, empty or without ``://`` has empty host and path,
    fits no rule and is judged by the classifier's base rate.
    """
    if url_col in (names := ("host", "path", "rule", "block_chance", "verdict")):
        raise ValueError(f"the URL column may not be one of {names}")
    kept = [c for c in pages.columns if c not in names]
    df = pages.select(*kept, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    df = model.transform(_featured(df, F.col("host"), F.col("path"), s))
    df = df.withColumn("block_chance", F.get(vector_to_array("probability"), 1)).withColumn(
        "_rule", best_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("block_chance") >= s.threshold, "block").otherwise("allow")
    return df.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"), "block_chance",
                     F.coalesce("_rule.verdict", own).alias("verdict"))
