"""Published versions: atomic, repeatable, and rewriting only the files that a batch touches."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from fundperf.plans.published import publish_table, publish_upsert
from fundperf.sources import KEYS, SCHEMAS, StaleVersion, VersionedTable, parquet_tables
from fundperf.sources.storage import Exists, Folder, shared_folder
from tests.frames import make_tables, rows_of

SET_COLS = ["horizon_date", "target_price"]


def targets(spark, rows):
    return spark.createDataFrame(rows, SCHEMAS["holding"])


def base_rows(n=40):
    return [(fund, f"T{i:02d}", date(2024, 1, 1), float(i)) for fund in ("grad", "quant") for i in range(n)]


@pytest.fixture
def table(spark, tmp_path):
    return publish_table(spark, make_tables(spark, holding=base_rows()), "holding", str(tmp_path), 8)


def test_a_first_version_is_sorted_into_disjoint_files(spark, table):
    version = table.version()
    assert (version.number, version.operation, version.rows, len(version.files)) == (0, "create", 80, 8)
    ends = sorted((f.low, f.high) for f in version.files)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert rows_of(table.read()) == sorted(base_rows(), key=str)


def test_a_batch_of_one_key_rewrites_one_file(spark, table):
    before = table.version()
    after = table.upsert(targets(spark, [("quant", "T07", None, None)]), SET_COLS, 1)
    assert len(set(after.files) - set(before.files)) == after.written == 1
    assert len(set(before.files) - set(after.files)) == 1
    assert rows_of(table.read().filter("target_price IS NULL")) == [("quant", "T07", None, None)]
    assert table.read().count() == 80 and table.read(0).filter("target_price IS NULL").count() == 0


def test_only_files_near_the_batch_are_read_for_their_keys(spark, table):
    base = table.version()
    given = targets(spark, [("quant", "T07", None, None)]).select(*KEYS["holding"])
    assert len(table._near(given, base)) == 1
    outside = targets(spark, [("zeta", "T07", None, None)]).select(*KEYS["holding"])
    assert table._near(outside, base) == [] and table.touched(outside, base) == ()
    both = targets(spark, [("grad", "T00", None, None), ("quant", "T39", None, None)]).select(*KEYS["holding"])
    assert len(table._near(both, base)) == 8 and len(table.touched(both, base)) == 2


def test_new_keys_are_added_without_touching_files(spark, table):
    before = table.version()
    after = table.upsert(targets(spark, [("zeta", "A", None, 1.0), (None, None, None, 2.0)]), SET_COLS)
    assert set(before.files) <= set(after.files) and after.rows == 82
    assert table.read().filter("fund IS NULL OR fund = 'zeta'").count() == 2


def test_of_two_writers_on_one_version_one_fails_and_can_start_again(spark, table):
    base = table.version()
    one, two = targets(spark, [("grad", "T01", None, 100.0)]), targets(spark, [("grad", "T02", None, 200.0)])
    table.upsert(one, SET_COLS, 1, base)
    with pytest.raises(StaleVersion):
        table.upsert(two, SET_COLS, 1, base)
    assert table.read().filter("target_price = 200").count() == 0
    again = publish_upsert(table, "holding", two, 1, base=base)
    assert again.number == 2
    assert rows_of(table.read().filter("target_price >= 100").select("ticker")) == [("T01",), ("T02",)]


def test_writers_that_publish_at_the_same_moment(spark, table, monkeypatch):
    """Both look at the log before either writes to it: the second rename fails."""
    base, other = table.version(), VersionedTable(spark, table.path)
    monkeypatch.setattr(other, "numbers", lambda: [0])
    table.upsert(targets(spark, [("grad", "T01", None, 100.0)]), SET_COLS, 1, base)
    with pytest.raises(StaleVersion, match="another writer"):
        other.upsert(targets(spark, [("grad", "T02", None, 200.0)]), SET_COLS, 1, base)
    assert table.numbers() == [0, 1] and table.read().filter("target_price = 200").count() == 0


def test_too_many_attempts_give_up(spark, table, monkeypatch):
    def always_late(*_, **__):
        raise StaleVersion("late")

    monkeypatch.setattr(table, "upsert", always_late)
    with pytest.raises(StaleVersion):
        publish_upsert(table, "holding", targets(spark, []), attempts=3)


def test_readers_see_whole_versions_only(spark, table, monkeypatch):
    reader = table.read()
    monkeypatch.setattr(table, "_publish", lambda *_: None)  # the writer dies after its data files are there
    table.upsert(targets(spark, [("grad", "T01", None, 100.0)]), SET_COLS, 1)
    folder = Folder(spark, f"{table.path}/_versions")
    stream = folder._fs.create(folder._path(".00000000000000000001.json.part"), False)
    stream.write(bytearray(b"{"))
    stream.close()
    fresh = VersionedTable(spark, table.path)
    assert fresh.numbers() == [0] and rows_of(fresh.read()) == rows_of(reader) == sorted(base_rows(), key=str)


def test_a_batch_with_a_name_is_applied_once(spark, table):
    raised = table.read().filter("fund = 'grad'").withColumn("target_price", F.col("target_price") + 1)
    first = publish_upsert(table, "holding", raised, batch="raise")
    assert publish_upsert(table, "holding", table.read().limit(0), batch="raise") == first
    assert table.numbers() == [0, 1]


def test_a_key_twice_in_a_batch_publishes_nothing(spark, table):
    twice = targets(spark, [("grad", "T01", None, 1.0), ("grad", "T01", None, 2.0)])
    with pytest.raises(Exception, match="more than one row"):
        table.upsert(twice, SET_COLS, 2)
    assert table.numbers() == [0]
    with pytest.raises(Exception, match="more than one row"):
        VersionedTable(spark, f"{table.path}-other").create(twice, KEYS["holding"])


def test_changes_between_versions(spark, table):
    same = ("grad", "T03", date(2024, 1, 1), 3.0)
    table.upsert(targets(spark, [("grad", "T01", None, 1.0), same, ("zeta", "Z", None, None)]), SET_COLS, 3)
    table.delete(targets(spark, [("quant", "T05", None, None), ("quant", "T99", None, None)]), 2)
    found = rows_of(table.changes(0).select("fund", "ticker", "target_price", "change"))
    assert found == [("grad", "T01", 1.0, "update"), ("quant", "T05", 5.0, "delete"), ("zeta", "Z", None, "insert")]
    assert table.changes(1, 1).count() == 0 and table.changes(0, 1).count() == 2
    untouched = table.version().number
    assert table.delete(targets(spark, [("none", "T", None, None)])).rows == table.version(untouched).rows


def test_history_compaction_and_expiry(spark, table):
    for i in range(3):
        table.upsert(targets(spark, [("zeta", f"N{i}", None, float(i))]), SET_COLS, 1)
    rows = rows_of(table.read())
    table.compact(2)
    history = [tuple(r) for r in table.history().orderBy("version").select("version", "operation", "rows", "files", "written").collect()]
    assert history[0] == (0, "create", 80, 8, 8) and history[-1] == (4, "compact", 83, 2, 2)
    assert rows_of(table.read()) == rows
    gone = table.expire(2)
    assert gone == [] or set(gone).isdisjoint(f.name for n in table.numbers() for f in table.version(n).files)
    assert table.numbers() == [3, 4] and rows_of(table.read(3)) == rows == rows_of(table.read())
    assert len(table.expire(1)) >= 8 and rows_of(table.read()) == rows
    with pytest.raises(LookupError):
        table.read(3)
    assert table.expire(5) == []


def test_an_empty_table_takes_its_first_rows(spark, tmp_path):
    table = publish_table(spark, make_tables(spark), "portfolio", str(tmp_path))
    assert table.read().collect() == [] and table.version().rows == 0
    publish_upsert(table, "portfolio", spark.createDataFrame([("grad", 0.1, None)], SCHEMAS["portfolio"]), 1)
    assert rows_of(table.read()) == [("grad", 0.1, None)]
    with pytest.raises(StaleVersion):
        table.create(table.read(), ["fund"])


def test_readers_of_domain_tables_find_the_latest_version(spark, table, tmp_path):
    table.upsert(targets(spark, [("grad", "T01", None, 100.0)]), SET_COLS, 1)
    tables = parquet_tables(spark, str(tmp_path))
    assert tables["holding"].filter("target_price = 100").count() == 1


def test_a_name_is_written_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "log"))
    assert folder.names() == []
    folder.write_new("a.json", "één")
    with pytest.raises(Exists):
        folder.write_new("a.json", "two")
    assert folder.names() == ["a.json"] and folder.read("a.json") == "één"


def test_shared_folders_are_new_and_below_the_setting(spark):
    one, two = shared_folder(spark), shared_folder(spark)
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
