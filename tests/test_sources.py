"""Readers, schemas and sinks."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from fundperf import plans
from fundperf.__main__ import main
from fundperf.sources import (
    SCHEMAS,
    conform,
    demo_tables,
    equal_ranges,
    jdbc_partitioning,
    jdbc_settings,
    jdbc_tables,
    load_table,
    parquet_tables,
    write_report,
    write_series,
    write_snapshot,
)
from fundperf.sources import readers
from tests.compare import connect
from tests.frames import make_tables, rows_of
from oracle.views import VIEWS

SETTINGS = {"DB_ENDPOINT": "host", "DB_PORT": "5432", "DB_NAME": "fund", "DB_USER": "me", "DB_PASSWORD": "secret"}


def test_conform_lowers_names_and_turns_decimals_into_doubles(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "grad", Decimal("7.25"), 1)], "CALDT string, FUND string, STOCK decimal(18,2), OTHER int"
    )
    df = conform(raw, "nav")
    assert df.schema.names == SCHEMAS["nav"].names
    assert df.first() == (date(2024, 1, 2), "grad", 7.25)


def test_open_tables_keep_further_columns(spark):
    raw = spark.sql("SELECT DATE'2024-01-02' AS caldt, 'grad' AS fund, 'ok' AS Status")
    assert conform(raw, "logs").columns == ["caldt", "fund", "status"]


def test_a_missing_column_fails_at_once(spark):
    with pytest.raises(Exception, match="stock"):
        conform(spark.sql("SELECT DATE'2024-01-02' AS caldt, 'grad' AS fund"), "nav")


@pytest.mark.parametrize("suffix", ["", ".parquet"])
def test_parquet_tables(spark, tmp_path, suffix):
    rows = [("2024-01-02", "grad", 7.0)]
    make_tables(spark, nav=rows)["nav"].write.parquet(str(tmp_path / f"nav{suffix}"))
    tables = parquet_tables(spark, str(tmp_path))
    assert set(tables) == set(SCHEMAS) and len(tables) == 11
    assert rows_of(tables["nav"]) == [(date(2024, 1, 2), "grad", 7.0)]
    with pytest.raises(KeyError):
        tables["nothing"]


def test_other_formats(spark, tmp_path):
    make_tables(spark, nav=[("2024-01-02", "grad", 7.0)])["nav"].write.option("header", "true").csv(str(tmp_path / "c"))
    df = load_table(spark, "nav", str(tmp_path / "c"), "csv", header="true")
    assert df.first() == (date(2024, 1, 2), "grad", 7.0)


def test_jdbc_options():
    options = jdbc_settings(SETTINGS)
    assert options["url"] == "jdbc:postgresql://host:5432/fund"
    assert "secret" not in options["url"] and options["password"] == "secret"
    assert jdbc_partitioning("2024-01-01", "2024-12-31", 8) == {
        "partitionColumn": "caldt", "lowerBound": "2024-01-01", "upperBound": "2024-12-31", "numPartitions": "8"
    }
    with pytest.raises(KeyError):
        jdbc_settings({})


def test_jdbc_ranges_span_the_history_and_not_the_window(monkeypatch):
    asked, loaded = [], {}
    monkeypatch.setattr(readers, "load_table", lambda spark, name, **options: loaded.setdefault(name, options))
    monkeypatch.setattr(
        readers, "table_days", lambda spark, name, connection: asked.append(name) or (date(2001, 1, 1), date(2024, 12, 31))
    )
    tables = jdbc_tables(None, SETTINGS, partitions=8)
    assert tables["positions"]["lowerBound"] == "2001-01-01" and tables["positions"]["upperBound"] == "2024-12-31"
    assert tables["positions"]["fetchsize"] == "10000" and tables["positions"]["numPartitions"] == "8"
    assert "lowerBound" not in tables["portfolio"] and asked == ["positions"]
    given = jdbc_tables(None, SETTINGS, partitions=4, history=("1999-01-01", "2024-12-31"))
    loaded.clear()
    assert given["nav"]["lowerBound"] == "1999-01-01" and asked == ["positions"]
    loaded.clear()
    assert "lowerBound" not in jdbc_tables(None, SETTINGS)["nav"]


def test_two_tables_of_one_name_are_refused(spark, tmp_path):
    nav = make_tables(spark, nav=[("2024-01-02", "grad", 7.0)])["nav"]
    for name in ("nav", "nav.parquet"):
        nav.write.parquet(str(tmp_path / name))
    with pytest.raises(ValueError, match="several tables"):
        parquet_tables(spark, str(tmp_path))["nav"]


def test_a_report_can_run_beside_the_remains_of_another(spark, tmp_path):
    demo = demo_tables(spark, "/root/testdata/sf0.001")
    for name in SCHEMAS:
        write_snapshot(demo[name], str(tmp_path / "tables" / name))
    (tmp_path / "out" / "first" / "overall_performance").mkdir(parents=True)
    main(
        ["--tables", str(tmp_path / "tables"), "--out", str(tmp_path / "out"), "--start", "1995-07-01", "--end", "2001-06-29"]
        + ["--funds", "grad", "quant", "--rf-fill", "previous", "--run", "second"]
    )
    overall = spark.read.parquet(str(tmp_path / "out" / "second" / "overall_performance"))
    assert sorted(r["Fund"] for r in overall.collect()) == ["All", "Grad", "Quant"]


def test_ranges_of_equal_counts_hold_every_row_once(spark):
    import random

    rng = random.Random(51)
    for partitions in (1, 2, 5, 16):
        days = sorted(rng.sample(range(400), 120))
        counts = [(date.fromordinal(730000 + d), 5000 if i == 60 else 1 + i * i // 40) for i, d in enumerate(days)]
        conditions = equal_ranges(counts, partitions)
        assert 1 <= len(conditions) <= partitions
        rows = [(day, n) for day, n in counts] + [(date(1900, 1, 1), 1), (date(2999, 1, 1), 1), (None, 1)]
        frame = spark.createDataFrame(rows, "caldt date, n long")
        found = [frame.filter(condition) for condition in conditions]
        assert sum(f.count() for f in found) == len(rows)
        sizes = [f.agg({"n": "sum"}).first()[0] for f in found]
        total, largest = sum(n for _, n in counts), max(n for _, n in counts)
        assert all(sizes) and max(sizes) <= total / partitions + largest + 3
    assert equal_ranges([], 8) == equal_ranges([(date(2024, 1, 1), 9)], 8) == ["1 = 1"]


def test_balanced_jdbc_reads_use_the_histogram(monkeypatch):
    asked = {}

    class Reader:
        def jdbc(self, url, table, predicates, properties):
            asked[table] = (url, predicates, properties)
            return table

    class Session:
        read = Reader()

    monkeypatch.setattr(readers, "table_histogram", lambda spark, name, connection: [(date(2024, 1, d), d) for d in range(1, 9)])
    monkeypatch.setattr(readers, "conform", lambda df, name: df)
    monkeypatch.setattr(readers, "load_table", lambda spark, name, **options: ("plain", name))
    tables = jdbc_tables(Session(), SETTINGS, partitions=3, balanced=True)
    assert tables["nav"] == "nav" and tables["portfolio"] == ("plain", "portfolio")
    url, predicates, properties = asked["nav"]
    assert url == "jdbc:postgresql://host:5432/fund" and len(predicates) == 3
    assert "url" not in properties and properties["user"] == "me" and properties["fetchsize"] == "10000"


def test_jdbc_settings_come_from_the_environment(monkeypatch):
    for name, value in SETTINGS.items():
        monkeypatch.setenv(name, value)
    assert jdbc_settings() == jdbc_settings(SETTINGS)


def test_sinks_write_and_refuse_to_overwrite(spark, tmp_path):
    tables = demo_tables(spark, "/root/testdata/sf0.001")
    args = ("1995-07-01", "2001-06-29")
    report = str(tmp_path / "report")
    write_report(plans.performance_report_formatted(tables, *args), report)
    assert spark.read.parquet(report).columns[1] == "Total Return"
    write_report(plans.performance_report_formatted(tables, *args), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 5
    with pytest.raises(Exception, match="(?i)exists"):
        write_report(plans.performance_report(tables, *args), report)

    series = str(tmp_path / "series")
    write_series(plans.combined_return_series(tables, *args), series)
    assert sorted(p.name for p in (tmp_path / "series").glob("fund=*")) == [
        "fund=brigham_capital", "fund=grad", "fund=quant", "fund=undergrad"
    ]
    write_series(plans.total_return_series(tables, *args), str(tmp_path / "total"))


def test_snapshot_versions(spark, tmp_path):
    first, second = str(tmp_path / "v1"), str(tmp_path / "v2")
    write_snapshot(make_tables(spark, portfolio=[("grad", 0.1, 0.2)])["portfolio"], first)
    stored = {"portfolio": load_table(spark, "portfolio", first)}
    write_snapshot(plans.upsert_portfolio(stored, "grad", 0.3, None), second)
    assert rows_of(load_table(spark, "portfolio", second)) == [("grad", 0.3, None)]
    with pytest.raises(Exception, match="(?i)exists"):
        write_snapshot(stored["portfolio"], first)


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_demo_tables_have_the_declared_schema_and_the_oracle_rows(spark, name):
    df = demo_tables(spark, "/root/testdata/sf0.001")[name]
    declared = {field.name: field.dataType for field in SCHEMAS[name]}
    assert {f.name: f.dataType for f in df.schema if f.name in declared} == declared
    con = connect("/root/testdata/sf0.001")
    ctes = ", ".join(f"{view} AS ({sql})" for view, sql in VIEWS.items())
    view = "bmk" if name == "benchmark" else name
    expected = con.execute(f"WITH {ctes} SELECT * FROM {view}").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))
    assert df.count() > 0


def test_annual_report_from_stored_tables(spark, tmp_path):
    demo = demo_tables(spark, "/root/testdata/sf0.001")
    for name in SCHEMAS:
        write_snapshot(demo[name], str(tmp_path / "tables" / name))
    out = tmp_path / "out"
    main(["--tables", str(tmp_path / "tables"), "--out", str(out), "--start", "1995-07-01", "--end", "2001-06-29"])
    assert {p.name for p in out.iterdir()} == {
        "overall_performance", "holdings_performance", "total_return_series", "fund_return_series",
        "combined_return_series", "fund_daily_returns", "benchmark_daily_returns", "overall_measures",
        "holdings_measures",
    }
    measures = spark.read.parquet(str(out / "overall_measures"))
    assert {(str(r["period_start"]), str(r["period_end"])) for r in measures.collect()} == {("1995-07-01", "2001-06-29")}
    series = spark.read.parquet(str(out / "fund_return_series")).select("fund", "caldt", "cumulative_return", "cumulative_return_bmk")
    assert rows_of(series) == rows_of(plans.fund_return_series(demo, "1995-07-01", "2001-06-29"))
    overall = spark.read.parquet(str(out / "overall_performance"))
    assert overall.count() == 5
    holdings = spark.read.parquet(str(out / "holdings_performance"))
    direct = plans.holdings_report_formatted(demo, "1995-07-01", "2001-06-29").select(*holdings.columns)
    assert rows_of(holdings) == rows_of(direct)
