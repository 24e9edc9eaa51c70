"""URL filters by character language models, by DataFrame functions alone.

Two smoothed Markov models of variable order, one of accepted and one of rejected URLs, give each URL the difference
of its log-likelihoods, divided by its length; a calibrated threshold decides. URLs are spelled in 35 symbols, so there
are less than 35 + 35^2 + 35^3 + 35^4 grams, however many URLs there are, and a table of grams can be broadcast.

With P_k(c | context) = (N(context c) + B P_{k-1}(c | shorter context)) / (N(context) + B), the difference of the two
models is a sum over all grams of a URL: where a gram is known it adds what its order changes over the order below,
and a known context without the gram adds the difference of the two back-off weights. So one pass over the grams of a
URL and one look-up each give its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, read

#: (rule, verdict): host and path; a rule holds for its host and all subdomains, and the longest rule that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 4
BACK_OFF = 4.0
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.:?-*^$"
SYMBOLS = len(ALPHABET)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def spelled(url: Column) -> Column:
    """A URL in the models' symbols: a-z, 0 for any digit, / . : - ?, * for any other, between ^ and $."""
    s = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    s = F.regexp_replace(F.regexp_replace(s, "[=&#%]", "?"), "[^a-z0/.:?-]", "*")
    return F.concat(F.lit("^"), s, F.lit("$"))


def grams(rows: DataFrame, keep: list[str], order: int = ORDER) -> DataFrame:
    """One row for each gram of up to ``order`` symbols that stands in column ``s``, with the columns of ``keep``. The
    grams are put together from the symbols' array, so that a URL of any length takes time in proportion."""

    def of(symbols: Column) -> Column:
        long = lambda k: F.transform(F.sequence(F.lit(1), F.size(symbols) - (k - 1)), lambda i: F.concat(*[F.element_at(symbols, (i + j).cast("int")) for j in range(k)]))
        none = F.array().cast("array<string>")
        return F.flatten(F.array(*[F.when(F.size(symbols) >= k, long(k)).otherwise(none) for k in range(1, order + 1)]))

    symbols = F.filter(F.split("s", ""), lambda c: c != "")
    return rows.select(*keep, F.explode(F.flatten(F.transform(F.array(symbols), of))).alias("gram"))


def model(labelled: DataFrame, order: int = ORDER, back_off: float = BACK_OFF) -> DataFrame:
    """(gram, value) from rows (s, good): what each occurrence of a gram adds to a URL's log-likelihood difference.
    Counts are over all rows. Each order is written out before the next rests on it."""
    good = F.col("good").cast("int")
    n = grams(labelled, ["good"], order).groupBy("gram").agg(F.sum(good).cast("double").alias("a"), F.sum(1 - good).cast("double").alias("r"))
    n = materialize(n.withColumn("k", F.char_length("gram")))
    # Order 1: shares of single symbols, over all symbols equally likely.
    total = n.where("k = 1").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    symbols = labelled.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ALPHABET))).alias("gram"))
    seen = symbols.join(n.where("k = 1"), "gram", "left").select("gram", F.lit(1).alias("k"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("r", F.lit(0.0)).alias("r"))
    p = lambda x: (F.col(x) + F.lit(back_off / SYMBOLS)) / F.lit((total[x] or 0.0) + back_off)
    levels = [materialize(seen.select("gram", "k", "a", "r", p("a").alias("pa"), p("r").alias("pr"), F.lit(0.0).alias("below"), F.lit(0.0).alias("back")))]
    for k in range(2, order + 1):
        lower = levels[-1].select(F.col("gram").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        context = levels[-1].select(F.col("gram").alias("context"), F.col("a").alias("na"), F.col("r").alias("nr"))
        rows = n.where(F.col("k") == k).withColumn("suffix", F.substring("gram", 2, k - 1)).withColumn("context", F.substring("gram", 1, k - 1))
        rows = rows.join(lower, "suffix").join(context, "context")
        q = lambda x, m, low: (F.col(x) + F.lit(back_off) * F.col(low)) / (F.col(m) + F.lit(back_off))
        levels.append(materialize(rows.select("gram", "k", "a", "r", q("a", "na", "qa").alias("pa"), q("r", "nr", "qr").alias("pr"), F.log(F.col("qa") / F.col("qr")).alias("below"), F.log((F.col("nr") + back_off) / (F.col("na") + back_off)).alias("back"))))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    own = F.log(F.col("pa") / F.col("pr")) - F.col("below") - F.col("back")
    # As a context of the next symbol, a gram adds the difference of back-off weights; at the end nothing follows.
    follows = (F.col("k") < order) & ~F.endswith("gram", F.lit("$"))
    as_context = F.when(follows, F.log((F.col("r") + back_off) / (F.col("a") + back_off))).otherwise(F.lit(0.0))
    return every.select("gram", (own + as_context).alias("value"))


def scores(urls: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score) for every distinct url: the difference of log-likelihoods for each symbol."""
    distinct = materialize(urls.select("url").distinct().withColumn("key", F.struct(F.xxhash64(F.lit(1), "url").alias("a"), F.xxhash64(F.lit(2), "url").alias("b"))))
    # 128 bits of its content stand for a URL. Their rows are dealt to a set number of tasks, as each makes many grams.
    s = distinct.select("key", spelled(F.col("url")).alias("s")).repartition(partitions(urls.sparkSession), "key")
    # The table has less than 35^4 * 1.03 rows whatever the input.
    met = grams(s, ["key"], order).join(F.broadcast(table), "gram", "left")
    total = met.groupBy("key").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    return distinct.join(total, "key").select("url", (F.col("total") / F.char_length(spelled(F.col("url")))).alias("score"))


def judge(pages: DataFrame, id_col="page_id", url_col="url", rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold for each row.

    URLs that a rule accepts or rejects teach the two models, but for a quarter of them by hash, on which the threshold
    is set where both kinds are as many standard deviations away. Without URLs of both kinds in either part the others
    are allowed. Null URLs and those without ``://`` have empty host and path, fit no rule and are judged by the models
    like any other text. Repeated URLs are scored once and count each time; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    held = F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(4)) == 3
    taught = rows.where(F.col("says").isNotNull() & ~held).select(spelled(F.col("url")).alias("s"), (F.col("says") == "allow").alias("good"))
    scored = materialize(scores(rows, materialize(model(taught, order)), order))
    judged = rows.join(scored, "url")
    good, bad = (F.when((F.col("says") == v) & held, F.col("score")) for v in ("allow", "block"))
    fit = judged.agg(F.avg(good).alias("ga"), F.stddev_pop(good).alias("gs"), F.avg(bad).alias("ba"), F.stddev_pop(bad).alias("bs"))
    even = (F.col("ga") * (F.col("bs") + 1e-9) + F.col("ba") * (F.col("gs") + 1e-9)) / (F.col("gs") + F.col("bs") + 2e-9)
    # One number, by way of the driver.
    judged = judged.withColumn("threshold", F.lit(fit.select(even.alias("threshold")).first().threshold).cast("double"))
    verdict = F.coalesce("says", F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "threshold")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
