"""The pipeline's stages on planted cases, and its contract."""

from __future__ import annotations

import hashlib
import zlib

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from fundperf.llm import queries
from fundperf.llm.common import cut
from tests.llm.cases import CLASHES, SCHEMA, edge_rows, prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with planted cases, as a tables folder."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    item, passage = prose(70, 40), prose(71, 80)
    rows = [(i, prose(100 + i, 200), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [
        (100, "too short", "en", "s0", 9),
        (101, rows[5][1], "en", "s1", 1),
        (102, rows[6][1] + " tail", "en", "s1", 1),
        (103, prose(600, 150) + " " + passage, "en", "s1", 1),
        (104, passage + " " + prose(601, 150), "en", "s2", 1),
        (105, prose(602, 100) + " " + item + " " + prose(603, 100), "en", "s2", 1),
        (None, prose(604, 120), "en", "s2", 1),
        (None, rows[7][1], "en", "s2", 1),
        (8, rows[8][1], "en", "s2", 1),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(72, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect_and_keep_clean_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, corpus))
        assert docs.columns == columns
        seen[name] = [tuple(r) for r in docs.collect()]
    ids = {name: sorted(r[0] for r in rows if r[0] is not None) for name, rows in seen.items()}
    clean = set(range(40)) | {103, 104}
    assert set(ids["quality_rules"]) == clean | {101, 102, 105}
    assert ids["near_duplicates"] == sorted(clean | {105})
    assert sum(r[0] is None for r in seen["near_duplicates"]) == 1
    texts = {r[0]: r for r in seen["substring_dedup"]}
    assert texts[104][1] == prose(601, 150) and texts[104][4] == len(prose(601, 150))
    assert texts[103][1].endswith(prose(71, 80))
    assert set(ids["decontamination"]) == clean
    packed = corpus_pipeline.run(spark, corpus).select("doc_id").distinct().collect()
    assert {r[0] for r in packed} == clean | {None}


def test_different_texts_of_one_crc_stay_apart(spark, tmp_path):
    """Rows without doc_id, or of one doc_id, are told apart by the whole text."""
    item = prose(70, 40)
    heads = ["too short", prose(600, 60) + " " + item + " " + prose(601, 60), prose(602, 120)]
    tails = [hashlib.md5(str(i).encode()).hexdigest() for i in range(300_000)]
    sums = [{zlib.crc32(f" {tail}".encode(), zlib.crc32(head.encode())): f"{head} {tail}" for tail in tails} for head in heads]

    def pair(a, b):
        both = min(sums[a].keys() & sums[b].keys())
        return sums[a][both], sums[b][both]

    folder = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for doc_id in (None, 5):

        def left(stage, texts):
            rows = [(doc_id, text, "en", "s0", 1) for text in texts]
            return sorted(r["text"] for r in stage(spark, spark.createDataFrame(rows, SCHEMA), folder).collect())

        short, clean = pair(0, 2)
        assert left(corpus_pipeline.quality_rules, [short, clean]) == [clean]
        leak, clean = pair(1, 2)
        assert left(corpus_pipeline.near_duplicates, [leak, clean]) == sorted([leak, clean])
        assert left(corpus_pipeline.decontamination, [leak, clean]) == [clean]


def test_awkward_rows_and_empty_tables_pass_all_stages(spark, corpus):
    extra = (None,) * len(CLASHES.split(", "))
    rows = [row + extra for row in edge_rows()]
    for docs in (spark.createDataFrame(rows, f"{SCHEMA}, {CLASHES}"), spark.createDataFrame([], f"{SCHEMA}, {CLASHES}")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = cut(stage(spark, docs, corpus))
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, corpus).count() >= docs.count()


def test_the_entry_registers_all(spark):
    names = contract.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.ORACLES) <= set(contract.oracle_sql())
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_written_tables_go_where_the_session_says(spark):
    from types import SimpleNamespace

    from fundperf.llm.common import shared_dir

    def asked(setting, master, kept=None):
        conf = SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" else default)
        context = SimpleNamespace(
            master=master, getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: kept
        )
        return shared_dir(SimpleNamespace(conf=conf, sparkContext=context))

    assert asked("hdfs://a/b/", "yarn") == "hdfs://a/b"
    assert asked(None, "yarn", "s3://kept") == "s3://kept"
    for master in ("yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            asked(None, master)
    assert shared_dir(spark)
