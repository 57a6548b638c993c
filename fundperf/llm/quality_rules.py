"""Host-level quality rules in DataFrame operations only.

Measures of a document are expressions over its own text. Two rules reject at once (too few words, too many
repeated ones). Three softer rules count as failures: many symbols, many repeated lines, odd word lengths.
Failures are aggregated by host (``source``); a host's failure rate is shrunk towards the rate of all hosts
by a beta prior whose strength is fitted to the spread between hosts. A host is bad if its shrunken rate lies more than
DEVIATIONS posterior deviations above the rate of all; so the prior decides how much evidence that takes. A document
that fails a soft rule is rejected on a bad host and stays on others; documents that fail none stay on any host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, version_of

MIN_WORDS = 50
#: Per cent of words in repeated 3-word windows.
MAX_REPEATED = 50
#: Soft rules: symbols per 100 words, repeated lines per 100 words, mean characters of a word.
MAX_SYMBOLS, MAX_DUP_LINES, MEAN_LOW, MEAN_HIGH = 10, 10, 2, 12
#: Posterior deviations above the rate of all hosts from which a host is bad: it is then worse than all with a probability of 0.6.
DEVIATIONS = 0.25
#: Strength of the prior where the spread between hosts doesn't give one.
PRIOR_ROWS = 20.0
WORD = r"[^\x20\x09-\x0D]"


def sorted_windows(words: Column) -> Column:
    """The 3-word windows of an array by hash and place, so that equal windows are neighbours."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source) as doc_id, source and the measures of each text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    base = docs.select(
        "doc_id",
        "source",
        "version",
        F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0)).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = base.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        sorted_windows(F.col("words")).alias("windows"),
    ).drop("words", "lines")
    at = F.col("windows")
    twice = F.filter(
        at,
        lambda w, j: (F.try_element_at(at, j + 2)["h"] == w["h"]) | ((j > 0) & (F.get(at, j - 1)["h"] == w["h"])),
    )
    starts = windows.withColumn("starts", F.sort_array(F.transform(twice, lambda w: w["i"]))).drop("windows")
    found = F.col("starts")
    # Each repeated window adds the words that the one before it doesn't cover.
    covered = F.aggregate(
        found,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")),
        lambda acc: acc["n"],
    )
    return starts.withColumn("n_repeat_words", covered).drop("starts")


def failures(rows: DataFrame) -> DataFrame:
    """Measures with the hard and soft verdicts of each document."""
    n = F.col("n_words")
    hard = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    soft = (
        (100 * F.col("n_symbols") > MAX_SYMBOLS * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * n)
        | (F.col("word_chars") < MEAN_LOW * n)
        | (F.col("word_chars") > MEAN_HIGH * n)
    )
    return rows.withColumns({"base_failed": hard, "soft_failed": soft})


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, failed, shrunken rate and whether the host is bad: failures over both kinds of rules, under one fitted beta prior.

    The prior's mean is the rate over all documents. With m hosts, N documents and a weighted spread S of
    the host rates, the moments give the variance between hosts v and the prior's strength mean(1-mean)/v - 1,
    at least one row. Where hosts don't differ by more than chance, or there is one, it is PRIOR_ROWS. A host's posterior
    has the shrunken rate r as mean and r(1-r)/(n+strength+1) as variance.
    """
    hosts = rows.groupBy(F.col("source").alias("host")).agg(
        F.count("*").alias("n"),
        F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"),
    )
    total = hosts.agg(
        F.count("*").alias("m"),
        F.sum("n").alias("all_n"),
        F.sum("failed").alias("all_failed"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("spread"),
    ).withColumn("mean", F.col("all_failed") / F.col("all_n"))
    mean, all_n = F.col("mean"), F.col("all_n")
    noise = (F.col("m") - 1) * mean * (1 - mean)
    variance = F.try_divide(
        F.col("spread") - all_n * mean * mean - noise, all_n - F.col("squares") / all_n - (F.col("m") - 1)
    )
    strength = F.try_divide(mean * (1 - mean), variance) - 1
    prior = total.select(
        "mean", F.when(variance > 0, F.greatest(strength, F.lit(1.0))).otherwise(F.lit(PRIOR_ROWS)).alias("strength")
    )
    # One row, by its aggregate without keys.
    rates = hosts.join(F.broadcast(prior), how="cross").withColumn(
        "rate", (F.col("failed") + F.col("strength") * mean) / (F.col("n") + F.col("strength"))
    )
    rate = F.col("rate")
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("strength") + 1))
    return rates.select("host", "n", "failed", "rate", (rate - mean > DEVIATIONS * deviation).alias("bad"))


def judge(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, version, measures, host rate, base_failed and kept.

    Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows count once
    each, towards their host as well. Other columns aren't read; an empty table gives an empty result.
    The measures are one written table: hosts are aggregated from it and joined back to its narrow rows.
    """
    rows = cut(failures(measured(docs.select("doc_id", "text", "source", version_of().alias("version")))))
    hosts = cut(host_rates(rows))
    strict = F.col("bad") & F.col("soft_failed")
    return rows.join(hosts.select("host", "rate", "bad"), F.col("source").eqNullSafe(F.col("host"))).withColumn(
        "kept", ~F.col("base_failed") & ~strict
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "soft_failed",
    )


ORACLE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), parts AS (
    SELECT rid, doc_id, source, text,
        regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM texts
), grams AS (
    SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
    FROM parts p, unnest(range(1, len(words) - 1)) AS u(i)
), twice AS (
    SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) >= 2
), covered AS (
    SELECT rid, sum(new_words) AS n FROM (
        SELECT rid, least(3, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -3)) AS new_words FROM twice)
    GROUP BY rid
), measures AS (
    SELECT p.doc_id, p.source, len(words)::BIGINT AS n_words,
        length(regexp_replace(p.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(p.text) - length(regexp_replace(p.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM parts p LEFT JOIN covered c ON p.rid = c.rid
), verdicts AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 10 * n_words
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS soft_failed
    FROM measures
), hosts AS (
    SELECT source AS host, count(*) AS n, sum((base_failed OR soft_failed)::INT)::BIGINT AS failed
    FROM verdicts GROUP BY 1
), total AS (
    SELECT count(*) AS m, sum(n)::DOUBLE AS all_n, sum(failed) / sum(n) AS mean, sum(n * n)::DOUBLE AS squares,
        sum(failed * failed / n) AS spread
    FROM hosts
), moments AS (
    SELECT mean, (spread - all_n * mean * mean - (m - 1) * mean * (1 - mean))
        / nullif(all_n - squares / all_n - (m - 1), 0) AS variance
    FROM total
), prior AS (
    SELECT mean, CASE WHEN variance > 0 THEN greatest(mean * (1 - mean) / variance - 1, 1.0) ELSE 20.0 END AS strength
    FROM moments
), rates AS (
    SELECT host, rate - mean > 0.25 * sqrt(rate * (1 - rate) / (n + strength + 1)) AS bad
    FROM (SELECT *, (failed + strength * mean) / (n + strength) AS rate FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (bad AND soft_failed) AS kept, soft_failed
FROM verdicts JOIN rates ON source IS NOT DISTINCT FROM host
"""
