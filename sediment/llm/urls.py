"""Verdicts on URLs: fixed rules first, mined association rules for the rest."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm.components import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The fixed rules: verdict, host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
#: Classes of tokens in a row up to which every combination of them is enumerated.
TOGETHER = 10
_LABEL = "verdict="


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From there to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fixed rule for the host or a domain above it whose path the path starts with, as (rule, verdict)."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, top, prefix in reversed(longest_first):
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(top + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: its host labels and its path segments by place; digits are all alike."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    placed = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    return F.array_distinct(F.concat(labels, placed))


def token_classes(labelled: DataFrame, rows: int, min_support: float = 0.01) -> DataFrame:
    """(token, class, n, verdict, m) of the tokens that a rule may have: ``m`` of its ``n`` rows have its best verdict.

    Tokens that occur in the very same rows are one class, named by the smallest: a rule with several of them says no
    more than with one. Occurrences are told apart by sums of the hashes of the token sets they are in.
    """
    kinds = labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("m"))
    own = F.xxhash64("tokens", "verdict")
    each = kinds.select("verdict", "m", own.alias("s"), F.explode("tokens").alias("token"))
    by_verdict = each.groupBy("token", "verdict").agg(F.sum("m").alias("m"), F.bit_xor("s").alias("x"), F.sum(F.col("s").cast("decimal(20,0)")).alias("a"))
    whole = by_verdict.groupBy("token").agg(
        F.sum("m").alias("n"), F.max("m").alias("m"), F.max_by("verdict", F.struct("m", "verdict")).alias("verdict"), F.bit_xor("x").alias("x"), F.sum("a").alias("a")
    )
    alike = Window.partitionBy("n", "x", "a")
    often = whole.where(F.col("m") >= min_support * rows - 1e-9)
    return often.select("token", F.min("token").over(alike).alias("class"), "n", "verdict", "m")


def _items_of(sets: DataFrame, mixed: DataFrame) -> DataFrame:
    """(tokens, items): the mixed classes of each distinct token set that has one, the rarest first."""
    each = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(mixed, "token")
    return each.groupBy("tokens").agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "class"))), lambda x: x["class"]).alias("items"))


def _every_rule(baskets: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules with several classes, by FP-growth over all combinations in the rows (items, verdict)."""
    labelled = baskets.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled)
    last = F.element_at("consequent", 1)
    plain = ~F.exists("antecedent", lambda x: x.startswith(_LABEL))
    longer = model.associationRules.where(last.startswith(_LABEL) & plain & (F.size("antecedent") > 1))
    return longer.select(F.array_sort("antecedent").alias("classes"), F.substring(last, len(_LABEL) + 1, 20).alias("verdict"), "confidence", "support")


def _needed_rules(spark: SparkSession, baskets: DataFrame, targets: DataFrame, rows: int, min_support: float, min_confidence: float) -> DataFrame:
    """The same rules from rows with any number of classes, without those that can decide no target (items).

    Sets grow class by class inside the targets, all targets at once, and are counted over all rows. A set is given up
    for a target only where no set that holds it can give a rule that is kept: it has too few rows; it has as many rows
    as a part of it, and so has each larger set; or the bound is not above what a part reaches. The bound: a larger set
    inside the target loses rows with the verdict, but it keeps every row that holds the whole target, so its confidence
    is at most m / (m + those of them with other verdicts).
    """
    least = math.ceil(min_support * rows)
    kinds = baskets.where("items is not null").groupBy("items", "verdict").agg(F.count(F.lit(1)).alias("m"))
    kinds = stored(spark, kinds.withColumn("kind", F.monotonically_increasing_id()), "url-kinds")
    targets = stored(spark, targets.select("items").distinct().where(F.size("items") > 1).withColumn("target", F.monotonically_increasing_id()), "url-targets")
    parts = kinds.select("kind", "verdict", "m", F.explode("items").alias("x"))
    # the rows that hold a whole target, found by its rarest class
    holding = parts.join(kinds.select("kind", F.col("items").alias("whole")), "kind")
    whole = targets.select("target", "items", F.col("items")[0].alias("x")).join(holding, "x").where(F.size(F.array_except("items", "whole")) == 0)
    whole = whole.groupBy("target", "verdict").agg(F.sum("m").alias("kept"))
    floor = stored(spark, whole.join(whole.groupBy("target").agg(F.sum("kept").alias("all")), "target"), "url-floors")
    all_of = floor.select("target", "all").distinct()

    near = targets.select("target", F.posexplode("items").alias("at", "x")).select("target", "at", F.array("x").alias("set"))
    occurs = parts.select(F.array("x").alias("set"), "kind", "verdict", "m")
    found, single, above = [], None, None
    while True:
        counts = occurs.groupBy("set", "verdict").agg(F.sum("m").alias("m"))
        counts = counts.join(counts.groupBy("set").agg(F.sum("m").alias("n")), "set").withColumn("confidence", F.col("m") / F.col("n"))
        is_rule = (F.col("m") >= least) & (F.col("confidence") >= min_confidence)
        counts = counts.withColumn("best", F.when(is_rule, F.col("confidence")).otherwise(F.lit(0.0)))
        if above is None:
            level = single = stored(spark, counts.withColumn("less", F.col("n") + 1), "url-sets")
        else:
            # a part without rows of the verdict leaves none to the set, so both are there
            stem = above.select(F.col("set").alias("stem"), "verdict", F.col("n").alias("n_stem"), F.col("best").alias("best_stem"))
            last = single.select(F.col("set")[0].alias("x"), "verdict", F.col("n").alias("n_last"), F.col("best").alias("best_last"))
            both = counts.withColumn("stem", F.slice("set", 1, F.size("set") - 1)).withColumn("x", F.element_at("set", -1))
            both = both.join(stem, ["stem", "verdict"]).join(last, ["x", "verdict"])
            best, less = F.greatest("best", "best_stem", "best_last"), F.least("n_stem", "n_last")
            level = stored(spark, both.select("set", "verdict", "m", "n", "confidence", best.alias("best"), less.alias("less")), "url-sets")
            found.append(level.where(is_rule).select(F.array_sort("set").alias("classes"), "verdict", "confidence", (F.col("m") / F.lit(rows)).alias("support")))
        above = level
        open_ = near.join(level.where((F.col("m") >= least) & (F.col("n") < F.col("less"))), "set")
        open_ = open_.join(all_of, "target", "left").join(floor.select("target", "verdict", "kept"), ["target", "verdict"], "left")
        others = F.coalesce("all", F.lit(0)) - F.coalesce("kept", F.lit(0))
        bound = F.col("m") / (F.col("m") + others)
        live = open_.where((bound >= min_confidence) & (bound > F.col("best"))).select("target", "set", "at").distinct()
        rest = F.slice("items", F.col("at") + 2, F.size("items"))
        more = live.join(targets, "target").select("target", "set", "at", F.posexplode(rest).alias("step", "x"))
        grown = stored(spark, more.select("target", "set", "x", (F.col("at") + 1 + F.col("step")).alias("at")), "url-grown")
        if grown.isEmpty():
            break
        near = grown.select("target", "at", F.concat("set", F.array("x")).alias("set"))
        wanted = grown.select("set", "x").distinct()
        occurs = occurs.join(wanted, "set").join(parts.select("kind", "x"), ["kind", "x"]).select(F.concat("set", F.array("x")).alias("set"), "kind", "verdict", "m")
        occurs = stored(spark, occurs, "url-occurrences")
    empty = spark.createDataFrame([], "classes array<string>, verdict string, confidence double, support double")
    for part in found:
        empty = empty.union(part)
    return empty


def mine_rules(
    spark: SparkSession,
    labelled: DataFrame,
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    most_together: int = TOGETHER,
    urls: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rules (classes, lead, verdict, confidence, support) from rows (tokens, verdict), and the classes of tokens.

    FP-growth enumerates every subset of what occurs together often, which doubles with each token, so it is given only
    what may combine to something new. Tokens of the very same rows are one class (:func:`token_classes`). A class whose
    rows all have one verdict is a rule alone, with which no longer rule can compete, so it is left out of the
    combinations; neither changes the rules. Up to ``most_together`` other classes in each row FP-growth
    mines all rows in full, with at most 2^``most_together`` / ``min_support`` frequent sets. If a row has more, the
    rules are searched for in the token sets of ``urls`` (by default the labelled rows'), over all classes of all
    rows (:func:`_needed_rules`): the rules that fit one of ``urls`` are the same, and no row or class is left out. Its
    memory is spread over the tasks; its time may double with each class where no bound tells sets apart, as the
    best combination of classes is a hard problem.
    A rule is dropped if a rule on fewer of its classes has the same verdict and at least its confidence: it decides
    nothing more. ``lead`` is a rule's rarest class.
    """
    rows = labelled.count()
    classes = stored(spark, token_classes(labelled, rows, min_support), "url-classes")
    alone = classes.where("token = class").select(F.array("class").alias("classes"), "verdict", (F.col("m") / F.col("n")).alias("confidence"), (F.col("m") / F.lit(max(rows, 1))).alias("support"))
    mixed = classes.where("m < n")
    # the tokens of a row that may combine; rows are brought together again by their token set, of which there are fewer
    parts = stored(spark, _items_of(labelled, mixed), "url-items")
    baskets = labelled.join(parts, "tokens", "left").select("items", "verdict")
    rules = alone.where(F.col("confidence") >= min_confidence)
    if rows:
        longest = parts.agg(F.max(F.size("items"))).first()[0] or 0
        if longest <= most_together:
            longer = _every_rule(baskets, min_support, min_confidence)
        else:
            longer = _needed_rules(spark, baskets, parts if urls is None else _items_of(urls, mixed), rows, min_support, min_confidence)
        rules = rules.union(longer)
    rules = stored(spark, rules, "url-rules")
    shorter = rules.select(F.col("classes").alias("s"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("classes")[0].alias("class"))
    heads = rules.select("*", F.explode("classes").alias("class")).join(shorter, "class")
    idle = (
        heads.where((F.col("v") == F.col("verdict")) & (F.size("s") < F.size("classes")) & (F.size(F.array_except("s", "classes")) == 0))
        .where(F.col("c") >= F.col("confidence"))
        .select("classes", "verdict")
        .distinct()
    )
    kept = rules.join(idle, ["classes", "verdict"], "left_anti")
    sizes = classes.where("token = class").select("class", "n")
    leads = kept.select("classes", F.explode("classes").alias("class")).distinct().join(sizes, "class").groupBy("classes").agg(F.min_by("class", F.struct("n", "class")).alias("lead"))
    return kept.join(leads, "classes"), classes.select("token", "class")


def match_rules(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, verdict) of the distinct token sets in ``urls`` that some rule fits.

    The rules are an inverted index under their rarest class; the others are looked up in the URL's own classes. The most
    confident rule wins, then the best supported, then the longer, then ``block``.
    """
    sets = urls.select("tokens").distinct()
    own = sets.select("tokens", F.explode("tokens").alias("token")).join(classes, "token").groupBy("tokens").agg(F.collect_set("class").alias("own"))
    hits = own.select("tokens", "own", F.explode("own").alias("lead")).join(rules, "lead")
    fits = hits.where(F.size(F.array_except("classes", "own")) == 0)
    rank = F.struct(F.round("confidence", 9), F.round("support", 9), F.size("classes"), (F.col("verdict") == "block").alias("b"))
    return fits.groupBy("tokens").agg(F.max_by("verdict", rank).alias("mined"))


def judge_urls(
    pages: DataFrame,
    rules: tuple = RULES,
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """Host, path, fixed rule and verdict of every URL.

    The longest fitting fixed rule decides. URLs with a fixed rule are the labels from which token combinations are
    mined; the mined rules judge the URLs without one, and those that none fits are allowed. Null or malformed URLs
    have an empty host and path and are allowed; repeated rows are judged each; null ids stay; other columns are not
    read. All URLs are mined and judged, each distinct set of tokens once, long and deep ones with all their tokens
    (:func:`mine_rules`). Built-in operations only.
    """
    url = F.col(f"`{url_column}`").cast("string")
    base = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = base.withColumn("fixed", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    labelled = seen.where("fixed is not null").select("tokens", "fixed.verdict")
    spark = pages.sparkSession
    open_urls = seen.where("fixed is null").select("tokens")
    mined = match_rules(open_urls, *mine_rules(spark, labelled, min_support, min_confidence, urls=open_urls))
    # written, so that the join below is between two plain sides and a set that very many URLs share can be split
    mined = stored(spark, mined, "mined-verdicts")
    verdict = F.coalesce("fixed.verdict", "mined", F.lit(DEFAULT))
    return seen.join(mined, "tokens", "left").select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"))
