"""A training corpus from raw documents, in five stages over the operators of ``fundperf.llm``.

Every stage takes all that the one before it kept, and its decisions take effect. Rows are told apart by
doc_id and text; a decision about a row holds for its exact repetitions too. Rows without doc_id take part
like others. Other columns pass through, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundperf.llm.common import cut, table, version_of
from fundperf.llm.decontamination import find_leaks
from fundperf.llm.packing import pack_public
from fundperf.llm.quality_rules import judge
from fundperf.llm.simhash import DISTANCE, SHINGLE, near_duplicate_groups
from fundperf.llm.substring_dedup import dedup_substrings

ID, VERSION = "__row_id", "__row_version"
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def _id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumns({ID: _id(), VERSION: version_of()})


def _keys(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(_id().alias(ID), F.col("version").alias(VERSION), *more)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep."""
    host = "__row_host"
    rejected = _keys(judge(docs).filter("NOT kept"), F.col("source").alias(host)).distinct()
    marked = _marked(docs)
    same = [marked[c] == rejected[c] for c in (ID, VERSION)] + [marked["source"].eqNullSafe(rejected[host])]
    return marked.join(rejected, same, "left_anti").drop(ID, VERSION)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the smallest doc_id, null last; exact repetitions of it go."""
    groups = near_duplicate_groups(docs, SHINGLE, DISTANCE)
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "version")).alias("first")
    stays = _keys(groups.groupBy("root").agg(first).select("first.doc_id", "first.version"))
    return _marked(docs).join(stays, [ID, VERSION], "left_semi").dropDuplicates([ID, VERSION]).drop(ID, VERSION)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; n_chars follows the text."""
    rows = dedup_substrings(docs)
    columns = {name: F.col(f"others.`{name}`") for name in docs.columns if name != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(columns["n_chars"]).cast("long")
    return rows.select(*(columns[name].alias(name) for name in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = _keys(find_leaks(docs, table(spark, sf_dir, "benchmark"))).distinct()
    return _marked(docs).join(leaks, [ID, VERSION], "left_anti").drop(ID, VERSION)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences."""
    return pack_public(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No SQL expresses fingerprints, the latent space or tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
