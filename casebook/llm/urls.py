"""URL filter: rules first, then a character language-model ratio. Built-in functions only.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest fitting rule decides. The URLs that rules decide are the examples of two
variable-order Markov models, one of accepted and one of rejected URLs, over the
characters of host and path. Each order is interpolated with the next shorter one
by Witten-Bell weights, and a context that was never seen falls back to it. A URL
without a rule is judged by the log-likelihood difference of the models, divided by
its length, against a threshold calibrated on a fifth of the examples, which the
models do not learn from.

Log-likelihoods are rounded to millionths a character and summed as integers, so the
result does not depend on the order of addition. Equal URLs are judged once.

Edge cases: a null url or one without :// has an empty host and path, and is judged
as an empty text; page ids may be null or repeat; urls of any length count whole;
without examples of both kinds in the calibration fifth the threshold is 0, and a url
that no model knows anything about is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import cut

#: Characters of context.
ORDER = 4
#: Grams whose scores go to the URLs by broadcast, some 25 MB; more are joined by a shuffle of every character.
BROADCAST_GRAMS = 200_000
#: Share of the calibration fold: texts whose crc32 leaves no remainder.
FOLDS = 5
#: Width of a bin of scores, in millionths.
BIN = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url"):
    """Host and path of a url."""
    part = lambda pattern: F.coalesce(F.regexp_extract(F.col(url), pattern, 1), F.lit(""))
    return F.translate(part("://([^/?#]*)"), UPPER, LOWER), part("://[^/?#]*([^?#]*)")


def rule_of(rules: list[tuple[str, str]]):
    """The longest fitting rule of (verdict, rule) pairs, and its verdict."""
    name = verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(slash + path))
        name, verdict = name.when(fits, F.lit(rule)), verdict.when(fits, F.lit(said))
    return name, verdict


def grams(texts: DataFrame) -> DataFrame:
    """A row for each character of `s` and its end, with the ORDER characters before it."""
    padded = F.concat(F.lit("^" * ORDER), "s", F.lit("$"))
    places = F.sequence(F.lit(1), F.length("s") + 1)
    rows = texts.withColumn("padded", padded).withColumn("i", F.explode(places))
    return rows.withColumn("gram", F.col("padded").substr(F.col("i"), F.lit(ORDER + 1))).drop("padded", "i")


def suffixes(rows: DataFrame) -> DataFrame:
    """Each gram's suffixes of 1 to ORDER + 1 characters, with their contexts."""
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ORDER))))
    rows = rows.withColumn("suffix", F.expr("right(gram, j + 1)"))
    return rows.withColumn("context", F.expr("substr(suffix, 1, j)"))


def gram_scores(examples: DataFrame, wanted: DataFrame) -> DataFrame:
    """llr, in millionths, of every wanted gram. examples: s, label (allow or block), n."""
    seen = grams(examples).groupBy("gram").agg(
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("b"),
    )
    nodes = suffixes(seen).groupBy("suffix", "context").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    contexts = nodes.groupBy("context").agg(
        F.sum("a").alias("ca"), F.sum("b").alias("cb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb")
    )
    # short contexts are those of most grams, so they are looked up once for each distinct suffix
    chains = suffixes(wanted.select("gram"))
    found = chains.select("suffix", "context").distinct().join(nodes.drop("context"), "suffix", "left").join(contexts, "context", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("a", "b", "ca", "cb", "ta", "tb")]
    levels = chains.select("gram", "j", "suffix").join(found.select("suffix", F.struct(*counts).alias("x")), "suffix")
    levels = levels.groupBy("gram").agg(F.expr("transform(sort_array(collect_list(struct(j, x))), y -> y.x)").alias("levels"))  # ORDER + 1 entries
    model = "aggregate(levels, 1.0D / 256, (p, x) -> IF(x.c{0} = 0, p, (x.{0} + x.t{0} * p) / (x.c{0} + x.t{0})))"
    return levels.select("gram", F.expr(f"CAST(round((ln({model.format('a')}) - ln({model.format('b')})) * 1000000) AS bigint)").alias("llr"))


def calibrated(scored: DataFrame) -> DataFrame:
    """One row: the threshold bin that best tells apart the labelled texts of `scored`
    (label, n, bin), by the sum of the shares judged rightly; the lowest such bin."""
    bins = scored.groupBy("bin").agg(
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("b"),
    )
    # scores lie within a few dozen units a character, so there are a few thousand bins
    rows = bins.selectExpr(
        "bin",
        "sum(a) OVER () AS all_a", "sum(b) OVER () AS all_b",
        "sum(a) OVER (ORDER BY bin DESC) AS a_from", "sum(b) OVER (ORDER BY bin DESC) AS b_from",
    )
    right = rows.where("all_a > 0 AND all_b > 0").selectExpr("bin", "a_from / CAST(all_a AS double) + (all_b - b_from) / CAST(all_b AS double) AS gain")
    return right.orderBy(F.desc("gain"), "bin").limit(1).agg(F.coalesce(F.max("bin"), F.lit(0)).alias("least"))


def with_scores(asked_grams: DataFrame, llr: DataFrame) -> DataFrame:
    """Every place of a gram with its score. Up to BROADCAST_GRAMS scores go to the places. Of more,
    those go of grams that more than one in BROADCAST_GRAMS of the places have, which are fewer
    than that; only places of other grams are shuffled, so no frequent gram meets in a task."""
    scores = llr.select("gram", "llr")
    n_grams, n_places = llr.agg(F.count("*"), F.sum("met")).first()
    if n_grams <= BROADCAST_GRAMS:
        return asked_grams.join(F.broadcast(scores), "gram")
    frequent = F.broadcast(llr.where(F.col("met") * BROADCAST_GRAMS > n_places).select("gram", "llr"))
    return asked_grams.join(frequent, "gram").unionByName(asked_grams.join(frequent, "gram", "left_anti").join(scores, "gram"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row, and for URLs without a rule
    `score`: millionths of the log-likelihood difference a character."""
    host, path = split_url("url")
    name, label = rule_of(rules)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": name, "label": label, "s": F.concat("host", "path")})
    texts = rows.groupBy("s", "label").agg(F.count("*").alias("n"))
    fold = F.crc32(F.col("s")) % FOLDS == 0
    asked = texts.where(F.col("label").isNull() | fold)
    asked_grams = grams(asked.select("s").distinct())
    met = cut(asked_grams.groupBy("gram").agg(F.count("*").alias("met")))
    llr = cut(gram_scores(texts.where(F.col("label").isNotNull() & ~fold), met.select("gram")).join(met, "gram"))
    scores = with_scores(asked_grams, llr).groupBy("s").agg(F.sum("llr").alias("total"), F.count("*").alias("chars"))
    scores = scores.select("s", F.floor(F.col("total") / F.col("chars")).cast("long").alias("score"))
    scores = scores.withColumn("bin", F.floor(F.col("score") / BIN).cast("long"))
    least = calibrated(asked.where("label IS NOT NULL").join(scores, "s")).scalar()
    # only unruled rows look up a score; the others keep a key of their own
    told = rows.where("rule IS NULL").join(scores, "s", "left").withColumn("verdict", F.when(F.coalesce("bin", F.lit(0)) >= least, "allow").otherwise("block"))
    ruled = rows.where("rule IS NOT NULL").withColumns({"verdict": F.col("label"), "score": F.lit(None).cast("long")})
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    return told.select(columns).unionByName(ruled.select(columns))
