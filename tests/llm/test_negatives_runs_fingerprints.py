"""Hard negatives, periodic runs and document fingerprints against plain versions, on awkward rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fundperf.llm import document_fingerprints, hard_negatives, periodic_runs, queries
from tests.compare import connect, first_difference, oracle_rows, spark_rows
from tests.llm.cases import clashing_docs, edge_docs, edge_rows, empty_docs, plain_rows

SF_DIR = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# 11 hard negatives ----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def vector_rows():
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) + (i % 3 == 0) for _ in range(10)], rng.randrange(4)) for i in range(420)]
    copy = rows[30][1]
    rows += [(500 + i, copy, i % 3) for i in range(40)]  # ties
    rows += [rows[0], rows[0], rows[100], rows[7], rows[33], rows[33]]  # repeated rows, anchors among them
    rows += [(700, [0.0] * 10, 1), (800, [1.0] * 10, 9), (-100, copy, 2), (-200, None, 1), (900, copy, None)]
    rows += [(1000, [None] + copy[1:], 1), (1100, [math.nan] + copy[1:], 1), (1200, [math.inf] + copy[1:], 1), (None, copy, 1)]
    return rows


def plain_negatives(rows):
    kept = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (anchor_id, a, label) in enumerate(kept):
        if anchor_id % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), vec_id, l, j) for j, (vec_id, v, l) in enumerate(kept) if j != i]
        scored.sort()
        for positive, positive_id, _, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and 30 * -positive <= 100 * -s[0] <= 90 * -positive][:10]
            out += [(anchor_id, positive_id, k + 1, s[1], -positive, -s[0]) for k, s in enumerate(found)]
    return sorted(out)


NEGATIVE_COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives_equal_a_search_of_all_pairs(spark):
    frame = spark.createDataFrame(vector_rows(), VECTORS).repartition(5)
    clashing = frame.withColumns({name: F.lit(None).cast("int") for name in ("row", "v", "slot", "score", "place")})
    expected = plain_negatives(vector_rows())
    assert len(expected) > 150
    for docs in (frame, clashing):
        assert sorted(map(tuple, hard_negatives.mine_hard_negatives(docs).select(*NEGATIVE_COLUMNS).collect())) == expected


def test_blocks_and_tiles_do_not_change_hard_negatives(spark, monkeypatch):
    frame = spark.createDataFrame(vector_rows(), VECTORS).coalesce(1)
    for name, value in (("BLOCK", 40), ("TILE", 70), ("ANCHORS", 2), ("FIRST_ROWS", 3), ("LEAST_SEGMENT", 1), ("SPARSE", 0.4)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mine_hard_negatives(frame)
    assert sorted(map(tuple, got.select(*NEGATIVE_COLUMNS).collect())) == plain_negatives(vector_rows())


def test_vectors_of_any_length_and_size(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [], 2), (3, [0.5, 0.25, 9.0], 2), (4, [1e300, -1e300], 3), (5, [0.3, 0.2], 3)]
    got = sorted(map(tuple, hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()))
    # Row 0 has label 2 here; its positives are row 3 and, with a score of 0, row 2. Row 4 is held at the limit, far below the range.
    assert got == [(0, 3, 1, 5, 128 * 256 + 64 * 512, 76 * 256 + 51 * 512)]
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([(0, [1.0], 1)], VECTORS)).collect() == []


def test_segment_summaries_bound_every_score():
    rng = np.random.default_rng(3)
    for width in (1, 5, 12, 64):
        a, b = rng.integers(-300, 300, (40, width)), rng.integers(-300, 300, (30, width))
        one, two = hard_negatives.Summaries.of(a), hard_negatives.Summaries.of(b)
        exact = a @ b.T
        spreads = []
        for (m, d), (n, e) in zip(one.levels, two.levels):
            assert (m @ n.T + d @ e.T >= exact - 1e-6).all() and (m @ n.T - d @ e.T <= exact + 1e-6).all()
            spreads.append((d @ e.T).mean())
        assert spreads == sorted(spreads, reverse=True)
    huge = rng.integers(-(1 << 20), 1 << 20, (20, 64))
    assert (hard_negatives.exact_scores(huge, huge, float(64 << 40)) == huge @ huge.T).all()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_document_fingerprints"])
def test_registered_query_matches_its_sql(spark, name):
    names, rows = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    expected_names, expected = oracle_rows(connect(SF_DIR), queries.ORACLES[name])
    assert names == expected_names and rows
    assert first_difference(rows, expected) is None


# 12 periodic runs -----------------------------------------------------------------------------------------


def plain_runs(words):
    codes = np.array([hash(w) for w in words], np.int64)
    n, out = len(words), []
    for period in range(1, n // 4 + 1):
        same = np.concatenate(([False], codes[:-period] == codes[period:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for start, stop in edges.tolist():
            length = stop - start + period
            if length >= max(6, 4 * period):
                part = codes[start : start + length]
                if not any((part[:-q] == part[q:]).all() for q in range(1, period)):
                    out.append((start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(doc_id, text, planted=True):
    words = SPLIT.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = (None,) * 4
    if runs:
        s, length, q = max(runs, key=lambda r: (r[1] * math.prod({x[2] for x in runs}) // r[2], -r[0], -r[2]))
        best = (s, length, q, 1000 * length // q)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def digests(df):
    return df.withColumns({"runs_sha256": F.sha2("runs", 256), "collapsed_sha256": F.sha2("collapsed", 256)})


def random_words(rng):
    letters = rng.choice([1, 2, 2, 3, 5, 50])
    if rng.random() < 0.4:
        return [rng.randrange(letters) for _ in range(rng.randrange(300))]
    out = []
    while len(out) < 200:
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, 45))]
        if rng.random() < 0.3:
            base = [0] * (len(base) - 1) + [1]
        out += base * rng.randrange(1, 9) + base[: rng.randrange(len(base) + 1)]
        if rng.random() < 0.2:
            out = (out * 5)[:600]
    return out


def test_runs_equal_a_comparison_at_every_period():
    rng, found = random.Random(12), 0
    for _ in range(40):
        documents = [random_words(rng) for _ in range(10)]
        got = periodic_runs.runs_of([np.array(d, np.int64) for d in documents])
        for words, runs in zip(documents, got):
            assert runs == plain_runs(words)
            found += len(runs)
    assert found > 1000


def test_synchronising_positions_are_chosen_alike_and_often_enough():
    rng = np.random.default_rng(4)
    part = rng.integers(0, 3, 400)
    codes = np.concatenate((part, rng.integers(0, 3, 500), part))
    names = codes.astype(np.uint64)
    for scale in (1, 2, 4, 8):
        names = periodic_runs.splitmix(names * periodic_runs.GOLDEN + np.concatenate((names[scale:], np.arange(scale, dtype=np.uint64))))
    scale = 16
    chosen = periodic_runs.synchronising(names, scale, [])
    inside = chosen[chosen + 2 * scale <= 400]
    assert set(inside + 900) == set(chosen[(chosen >= 900) & (chosen + 2 * scale <= 1300)])
    assert np.diff(chosen).max() <= scale and len(chosen) < 4 * len(codes) / scale


def test_collapsed_documents_equal_the_definition(spark):
    rng = random.Random(13)
    rows = edge_rows() + [(100 + i, " \n".join(f"w{x}" for x in random_words(rng)), None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    for planted in (True, False):
        got = plain_rows(digests(periodic_runs.collapse_runs(docs, planted)), *RUN_COLUMNS)
        expected = [plain_collapse(r[0], r[1], planted) for r in rows]
        assert got == sorted(expected, key=lambda row: tuple((v is None, str(v)) for v in row))
    clashing = digests(periodic_runs.collapse_runs(clashing_docs(spark), True))
    assert plain_rows(clashing, *RUN_COLUMNS) == plain_rows(digests(periodic_runs.collapse_runs(edge_docs(spark), True)), *RUN_COLUMNS)
    assert periodic_runs.collapse_runs(empty_docs(spark)).collect() == []


def test_registered_runs_equal_the_definition(spark):
    got = queries.QUERIES["op12_periodic_runs"](spark, SF_DIR).select(*RUN_COLUMNS).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(got) == len(texts) and sum(r["n_runs"] for r in got) > 20
    for row in got:
        assert tuple(row) == plain_collapse(row["doc_id"], texts[row["doc_id"]])


def test_a_very_long_periodic_text(spark):
    base = [f"b{i}" for i in range(30_000)]
    text = " ".join(["start"] + base * 5 + ["end"] + ["x"] * 50_000)
    row = periodic_runs.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["runs"] == f"1,150000,30000\n150002,50000,1\n"
    assert (row["start"], row["period"], row["exponent_milli"]) == (150_002, 1, 50_000_000)
    assert row["collapsed"] == " ".join(["start"] + base + ["end", "x"])


# 13 document fingerprints ---------------------------------------------------------------------------------


def fingerprint_sql(rows):
    con = duckdb.connect()
    con.register("source", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
    con.execute("CREATE TABLE documents AS SELECT doc_id, text FROM source")
    return oracle_rows(con, document_fingerprints.ORACLE_SQL)


def test_fingerprints_of_awkward_rows_equal_the_sql(spark):
    names, expected = fingerprint_sql(edge_rows())
    for docs in (edge_docs(spark), clashing_docs(spark)):
        got_names, got = spark_rows(document_fingerprints.fingerprint_documents(docs))
        assert got_names == names and first_difference(got, expected) is None
    assert document_fingerprints.fingerprint_documents(empty_docs(spark)).collect() == []


def test_many_copies_of_one_row_give_the_same_rows(spark, monkeypatch):
    rows = edge_rows() + [(4, edge_rows()[3][1], "en", "a", 1)] * 40 + [(None, "one line\nand another", None, None, None)] * 90
    names, expected = fingerprint_sql(rows)
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    _, whole = spark_rows(document_fingerprints.fingerprint_documents(docs))
    for name, value in (("LEAST_COPIES", 10), ("COPIES_A_TASK", 7), ("RANGES", 3)):
        monkeypatch.setattr(document_fingerprints, name, value)
    _, once = spark_rows(document_fingerprints.fingerprint_documents(docs))
    assert first_difference(whole, expected) is None and first_difference(once, expected) is None


def test_a_doc_id_that_most_rows_have_is_split(spark, monkeypatch):
    rows = [(7 if i % 3 else i, f"text {i}. more of {i % 5}\nline") for i in range(300)] + [(None, f"none {i}") for i in range(150)]
    _, expected = fingerprint_sql(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.withColumn("version", F.unhex(F.md5(F.col("text").cast("binary"))))
    sizes = document_fingerprints.dealt(keyed, document_fingerprints.range_of(keyed, 32)).groupBy("part").count()
    assert sizes.agg(F.max("count")).first()[0] < 60
    _, got = spark_rows(document_fingerprints.fingerprint_documents(docs))
    assert first_difference(got, expected) is None


def test_one_row_follows_itself(spark):
    row = document_fingerprints.fingerprint_documents(spark.createDataFrame([(1, "ab cd. ef")], "doc_id long, text string")).first()
    assert row["n_chars"] == 9 and row["near_next"] == 1.0
    assert row["edited_sha256"] == hashlib.sha256(b"ab cdab c").hexdigest()


def test_paragraphs_are_added_and_taken_away(spark):
    texts = {1: "alpha beta\ngamma. delta", 2: "epsilon zeta! eta", 3: "eta\ndelta\nalpha beta\ngamma\nepsilon zeta", 4: "", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known = {r["doc_id"]: r["fingerprint"] for r in document_fingerprints.fingerprint_documents(docs).collect()}
    pair = spark.createDataFrame([(known[1], known[2], known[3], known[4])], "a string, b string, c string, none string")
    row = pair.select(
        document_fingerprints.plus(F.col("a"), F.col("b")).alias("sum"),
        document_fingerprints.minus(F.col("c"), F.col("b")).alias("rest"),
        document_fingerprints.minus(F.col("a"), F.col("a")).alias("nothing"),
    ).first()
    assert row["sum"] == known[3] and row["rest"] == known[1] and row["nothing"] == known[4] == known[5]
    assert known[4].strip("0") == ""


def test_likeness_follows_the_share_of_equal_paragraphs(spark):
    def text(own, shared, k):
        return "\n".join([f"shared {k} {i}" for i in range(shared)] + [f"own {own} {k} {i}" for i in range(40 - shared)])

    rows = [(2 * k + own, text(own, 40 * (k % 5) // 4, k)) for k in range(100) for own in (0, 1)]
    got = document_fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_share = {s: [r["near_next"] for r in got if r["doc_id"] % 2 == 0 and r["doc_id"] // 2 % 5 == s] for s in range(5)}
    for share, values in by_share.items():
        assert abs(sum(values) / len(values) - share / 4) < 0.06
    assert set(by_share[4]) == {1.0}


def test_fingerprints_need_no_python_and_one_shuffle_of_the_texts(spark):
    plan = document_fingerprints.fingerprint_documents(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    main = plan.split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(part", main)) == 1
