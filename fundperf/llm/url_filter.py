"""URL filter: rules first, then naive Bayes over segmented host names and path tokens.

A host is cut into runs of letters. A unigram model, counted over the words of all pages, splits every run
into its most likely words (Viterbi). Multinomial naive Bayes, counted over the pages that a rule decides,
then judges the pages that no rule fits by their host words and path tokens.

Runs are split once each. A run meets the model through its substrings (at most WORD long), by a join, so the
model is never broadcast or cut down to a top list. Weights are whole millionths, so sums don't depend on
their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, cut, table

#: (host, path, verdict) of the registered query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Longest word of the unigram model.
WORD = 24
UNIT = 1_000_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of its url; both empty for null and for urls without ``://``."""
    found = F.instr("url", "://")
    rest = F.when(found > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    pieces = pages.withColumn("_rest", rest)
    host = F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), CAPITALS, SMALL)
    return pieces.withColumns({"host": host, "path": F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n) over the text of all pages: runs of letters outside tags, of at most WORD characters."""
    text = F.lower(F.regexp_replace("html", "<[^>]*>", " "))
    words = F.explode(F.regexp_extract_all(text, F.lit(r"[^\x00-\x60\x7B-\x7F]+"), F.lit(0)))
    return pages.select(words.alias("word")).filter(F.char_length("word") <= WORD).groupBy("word").agg(F.count("*").alias("n"))


def best_split(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most likely words; an unknown string of length k counts as 10**(1 - k) / total.

    Of equally likely splits, the one whose last words are longest.
    """
    log_total, ten = math.log(max(1, total)), math.log(10)
    score, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        best, at = -math.inf, 0
        for start in range(max(0, end - WORD), end):
            n = known.get((start, end - start))
            own = (math.log(n) if n else ten * (1 - (end - start))) - log_total
            if score[start] + own > best + 1e-12:
                best, at = score[start] + own, start
        score.append(best)
        back.append(at)
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(runs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(run, words) of distinct runs of letters."""
    total = lexicon.agg(F.sum("n")).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(1), F.char_length("run")))
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD), F.char_length("run") - F.col("start") + 1)))
    parts = runs.select("run", starts.alias("start")).select("run", "start", lengths.alias("length"))
    parts = parts.withColumn("word", F.expr("substring(run, start, length)"))
    known = parts.join(lexicon, "word").groupBy("run").agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))
    rows = runs.join(known, "run", "left").select(
        "run", F.col("known.start").alias("start"), F.col("known.length").alias("length"), F.col("known.n").alias("n")
    )
    schema = arrow_schema("run string, words array<string>")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("run", "start", "length", "n")]
            words = []
            for run, start, length, n in zip(*columns):
                known_ = {(a - 1, k): c for a, k, c in zip(start or (), length or (), n or ())}
                words.append(best_split(run, known_, total))
            yield pa.record_batch([batch["run"], pa.array(words, pa.list_(pa.string()))], schema=schema)

    return rows.mapInArrow(split, "run string, words array<string>")


def path_tokens(path: Column) -> Column:
    """Tokens of a path, lower case; runs of digits are one token."""
    lowered = F.regexp_replace(F.lower(path), "[0-9]+", "0")
    return F.regexp_extract_all(lowered, F.lit(r"0|[^\x00-\x60\x7B-\x7F]+"), F.lit(0))


def host_words(hosts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts: the words of its runs in order, and its numbers as ``0``."""
    pieces = F.regexp_extract_all("host", F.lit(r"[0-9]+|[^\x00-\x60\x7B-\x7F]+"), F.lit(0))
    runs = hosts.select("host", F.posexplode(pieces).alias("at", "run"))
    runs = cut(runs.withColumn("run", F.when(F.col("run").rlike("^[0-9]"), F.lit("0")).otherwise(F.col("run"))))
    splits = cut(segmented(runs.select("run").distinct(), lexicon))
    ordered = F.array_sort(F.collect_list(F.struct("at", "words")))
    named = runs.join(splits, "run").groupBy("host").agg(F.flatten(ordered["words"]).alias("words"))
    return named


def token_weights(host_tokens: DataFrame, path_tokens_: DataFrame, classes: dict[str, int]) -> DataFrame:
    """(token, weight): the log odds of block against allow, in millionths, add-one smoothed."""
    both = host_tokens.unionByName(path_tokens_).groupBy("token").agg(
        *(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(c) for c in ("block", "allow"))
    )
    counts = cut(both)
    sums = counts.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes)).first()

    def log_share(c: str) -> Column:
        return F.log((F.col(c) + 1) / F.lit(float(sums[c] + sums["v"])))

    return counts.select("token", F.round((log_share("block") - log_share("allow")) * UNIT).cast("long").alias("weight"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Every row's page_id, host, path, rule, verdict, host_words and score (log odds of block).

    Null urls and urls without ``://`` have empty host and path and are judged by the prior alone. Equal
    odds allow, and so does a corpus in which no rule decides a page. Null html has no words; repeated rows
    count each. Other columns aren't read; an empty table gives an empty result.
    """
    rule, verdict = rule_columns(rules)
    urls = parsed(pages.select("page_id", "url")).withColumns({"rule": rule, "label": verdict}).drop("url")
    sites = cut(urls.groupBy("host", "path", "label").agg(F.count("*").alias("n")))
    lexicon = cut(unigrams(pages))
    words = cut(host_words(sites.select("host").distinct(), lexicon))
    per_host = sites.filter("label IS NOT NULL").groupBy("host", "label").agg(F.sum("n").alias("n"))
    host_tokens = per_host.join(words, "host").select(F.explode("words").alias("token"), "label", "n")
    tokens = F.explode(path_tokens(F.col("path"))).alias("token")
    decided = sites.filter("label IS NOT NULL").select(tokens, "label", "n")
    classes = {"block": 0, "allow": 0}
    classes |= {r["label"]: r["n"] for r in per_host.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    weights = cut(token_weights(host_tokens, decided, classes))
    prior = round(UNIT * math.log((classes["block"] + 1) / (classes["allow"] + 1)))

    def scored(keys: DataFrame, key: str, found: Column) -> DataFrame:
        exploded = keys.select(key, F.explode(found).alias("token"))
        return cut(exploded.join(weights, "token").groupBy(key).agg(F.sum("weight").alias(f"{key}_score")))

    host_scores = scored(words, "host", F.col("words"))
    path_scores = scored(sites.select("path").distinct(), "path", path_tokens(F.col("path")))
    spelled = words.select("host", F.array_join("words", " ").alias("host_words"))
    odds = F.lit(prior) + F.coalesce("host_score", F.lit(0)) + F.coalesce("path_score", F.lit(0))
    joined = (
        urls.join(spelled.join(host_scores, "host", "left"), "host", "left")
        .join(path_scores, "path", "left")
        .withColumn("odds", odds)
    )
    says = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("label", says).alias("verdict"),
        F.coalesce("host_words", F.lit("")).alias("host_words"),
        (F.col("odds") / F.lit(float(UNIT))).alias("score"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
