"""URL filter: rules first, else a ratio of character language models.

A rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's
path; the longest rule wins. URLs that an allow rule fits are the accepted corpus, those that
a block rule fits the rejected one. Each corpus gives a character model of variable order:
Witten-Bell smoothing lets a context of two characters fall back on one and on none in
proportion to how often new characters followed it. A URL (host and path, over an alphabet of
32 symbols) scores the mean log-likelihood difference per character. The threshold is
calibrated on URLs that the models weren't counted on, one in ``HELD`` of either corpus by a hash: the
point between their mean scores that lies as many standard deviations from either.

DataFrame operations only. The two models fold into one table of 32**3 = 32,768 differences,
whatever the corpora's size; it is broadcast to the n-grams of the URLs, which are summed up
within the task that made them.

Edge cases: equal URLs fall on the same side of the split; where it leaves a corpus without calibration
URLs, the others count for it; a null URL or one without ``://`` has an empty host and path and is scored as the
empty string; if a corpus is empty the difference is 0 and the threshold 0, so that URLs
without a rule are allowed; an empty table gives an empty result; repeated rows are judged
each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Symbols 1 to 30; 0 is any other character, 31 the edge of a URL. Digits count as 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz./-0"
SYMBOLS, EDGE = 32, 31
CODES = SYMBOLS**3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pseudo counts of each symbol in the lowest order.
FLOOR = 0.5
#: One decided URL in so many calibrates the threshold instead of counting.
HELD = 5


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def _rule(rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    fits = [
        (((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), value(h, p, v))
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]
    return F.coalesce(*(F.when(c, F.lit(x)) for c, x in fits))


def with_codes(df: DataFrame) -> DataFrame:
    """codes: a number below 32**3 for each character and the end, from two symbols before it and itself."""
    text = "regexp_replace(translate(concat(host, path), '%s', '%s'), '[0-9]', '0')" % (UPPER, LOWER)
    symbols = f"""concat(array({EDGE}, {EDGE}),
        transform(filter(split({text}, ''), c -> c <> ''), c -> locate(c, '{ALPHABET}')), array({EDGE}))"""
    return df.withColumn("symbols", F.expr(symbols)).withColumn(
        "codes",
        F.expr("transform(sequence(2, size(symbols) - 1), i -> symbols[i - 2] * 1024 + symbols[i - 1] * 32 + symbols[i])"),
    ).drop("symbols")


def model(judged: DataFrame) -> DataFrame:
    """code, d: the 32,768 log-likelihood differences, accepted less rejected.

    judged: rows (verdict, codes) that a rule decided.
    """
    spark = judged.sparkSession
    seen = judged.select((F.col("verdict") == "allow").cast("int").alias("k"), F.explode("codes").alias("code"))
    n3 = written(seen.groupBy("k", "code").agg(F.count("*").alias("n3")), "url_ngrams")
    # At most 2 * 32**3 rows from here on.
    follow = n3.withColumns({"c1": F.expr("code % 32"), "c2": F.expr("code % 1024"), "h2": F.expr("code div 32")})
    t3 = follow.groupBy("k", "h2").agg(F.sum("n3").alias("of3"), F.count("*").alias("kinds3"))
    n2 = follow.groupBy("k", "c2").agg(F.sum("n3").alias("n2"))
    t2 = n2.groupBy("k", F.expr("c2 div 32").alias("h1")).agg(F.sum("n2").alias("of2"), F.count("*").alias("kinds2"))
    n1 = follow.groupBy("k", "c1").agg(F.sum("n3").alias("n1"))
    t1 = n1.groupBy("k").agg(F.sum("n1").alias("of1"))
    grid = spark.range(CODES).select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("k"),
        F.col("id").cast("int").alias("code"),
        F.expr("cast(id % 32 as int) as c1"),
        F.expr("cast(id % 1024 as int) as c2"),
        F.expr("cast(id div 32 as int) as h2"),
        F.expr("cast(id div 32 % 32 as int) as h1"),
    )
    full = grid.join(n3, ["k", "code"], "left").join(t3, ["k", "h2"], "left").join(n2, ["k", "c2"], "left")
    full = full.join(t2, ["k", "h1"], "left").join(n1, ["k", "c1"], "left").join(t1, "k", "left")
    full = full.na.fill(0)
    p1 = (F.col("n1") + FLOOR) / (F.col("of1") + FLOOR * SYMBOLS)
    p2 = F.when(F.col("of2") == 0, p1).otherwise((F.col("n2") + F.col("kinds2") * p1) / (F.col("of2") + F.col("kinds2")))
    p3 = F.when(F.col("of3") == 0, p2).otherwise((F.col("n3") + F.col("kinds3") * p2) / (F.col("of3") + F.col("kinds3")))
    both = full.groupBy("code").agg(
        F.sum(F.when(F.col("k") == 1, F.log(p3)).otherwise(-F.log(p3))).alias("d"), F.min("of1").alias("least")
    )
    d = F.when(F.col("least") > 0, F.col("d")).otherwise(F.lit(0.0))
    return both.select("code", d.alias("d"))


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of ``pages``."""

    def ruled(df: DataFrame) -> DataFrame:
        return df.withColumns({"rule": _rule(rules, lambda h, p, v: h + p), "decided": _rule(rules, lambda h, p, v: v)})

    urls = with_codes(parts(pages))
    aside = F.pmod(F.xxhash64(F.lit(11), "host", "path"), F.lit(HELD)) == 0
    judged = ruled(urls).filter(F.col("decided").isNotNull() & ~aside).select(F.col("decided").alias("verdict"), "codes")
    differences = written(model(judged), "url_model")
    # The model has CODES rows by construction. A URL's codes lie in one task, where they are
    # summed up again before anything moves; repeated rows come apart again afterwards.
    each = urls.select("page_id", "host", "path", F.size("codes").alias("n"), F.explode("codes").alias("code"))
    scored = (
        each.join(F.broadcast(differences), "code")
        .groupBy("page_id", "host", "path", "n")
        .agg(F.avg("d").alias("llr"), F.count("*").alias("rows"))
    )
    scored = written(ruled(scored).withColumn("rows", F.expr("rows div n")).drop("n"), "url_scores")
    known = scored.filter("decided is not null").groupBy(F.col("decided").alias("verdict"), aside.alias("aside")).agg(
        F.sum(F.col("llr") * F.col("rows")).alias("s1"), F.sum(F.col("llr") * F.col("llr") * F.col("rows")).alias("s2"), F.sum("rows").alias("n")
    )
    # The sums of the URLs set aside, or of the others where there are none.
    best = known.groupBy("verdict").agg(F.max(F.struct("aside", "s1", "s2", "n")).alias("k")).select("verdict", "k.*")
    mean = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean))
    stats = best.select("verdict", mean.alias("m"), spread.alias("s"), "n")
    pick = lambda v, c: F.max(F.when(F.col("verdict") == v, F.col(c)))
    ma, sa, mb, sb = pick("allow", "m"), pick("allow", "s"), pick("block", "m"), pick("block", "s")
    between = F.when(sa + sb > 0, (ma * sb + mb * sa) / (sa + sb)).otherwise((ma + mb) / 2)
    threshold = written(stats.agg(F.coalesce(between, F.lit(0.0)).alias("t")), "url_threshold").scalar()
    verdict = F.coalesce("decided", F.when(F.col("llr") >= threshold, "allow").otherwise("block"))
    rows = scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rows")
    return rows.withColumn("copy", F.explode(F.expr("sequence(1, rows)"))).select("page_id", "host", "path", "rule", "verdict")
