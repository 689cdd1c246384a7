from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import added, merge, trend, validate
from tradeloom.plans import stages

FLOW = "year int, reporter_country string, partner_country string, product_code string, value double, quantity double"
MFN = "reporter_country string, year int, product_code string, tariff_rate double, min_rate double, max_rate double"
PREF = "reporter_country string, partner_country string, year int, product_code string, tariff_rate double, min_rate double, max_rate double"


def _tables(spark):
    flows = spark.createDataFrame([(2000, "A", "B", p, 1.0, 1.0) for p in ("pref", "mfn", "both", "none")], FLOW)
    mfn = spark.createDataFrame([("B", 2000, "mfn", 5.0, 1.0, 9.0), ("B", 2000, "mfn", 4.0, 2.0, 8.0), ("B", 2000, "both", 7.0, 7.0, 7.0), ("B", 1999, "none", 1.0, 1.0, 1.0)], MFN)
    pref = spark.createDataFrame([("A", "B", 2000, "pref", 2.0, 2.0, 2.0), ("A", "B", 2000, "both", 0.0, 0.0, 0.0), ("B", "A", 2000, "none", 3.0, 3.0, 3.0)], PREF)
    return flows, mfn, pref


def test_precedence_and_duplicates(spark, rows):
    out = merge.build_panel(*_tables(spark))
    assert rows(out, "product_code", "average_tariff", "min_rate_mfn") == [("both", 0.0, 7.0), ("mfn", 4.0, 1.0), ("none", None, None), ("pref", 2.0, None)]


def test_preferential_reporter_may_be_the_importer(spark, rows):
    out = merge.build_panel(*_tables(spark), pref_reporter_is="importer")
    assert rows(out, "product_code", "average_tariff") == [("both", 7.0), ("mfn", 4.0), ("none", 3.0), ("pref", None)]
    with pytest.raises(ValueError):
        merge.build_panel(*_tables(spark), pref_reporter_is="anyone")


def _panel(spark):
    data = [(2000, "A", "B", "01", 10.0, 2.0), (2000, "C", "B", "01", 20.0, 4.0), (2001, "A", "B", "01", 30.0, 0.0), (2000, "A", "B", "02", 8.0, 1.0)]
    return spark.createDataFrame(data, FLOW).withColumn("average_tariff", F.lit(1.0))


def test_detrend_and_idempotence(spark, rows):
    once = trend.detrend(trend.add_unit_value(_panel(spark)))
    assert rows(once, "year", "reporter_country", "product_code", "unit_value_detrended", "value_detrended") == [
        (2000, "A", "01", 0.0, 5.0), (2000, "A", "02", 0.0, 0.0), (2000, "C", "01", 0.0, 15.0), (2001, "A", "01", None, None)]
    twice = trend.detrend(once)
    assert twice.columns == once.columns and rows(twice) == rows(once)


def test_line_of_one_year_is_null(spark):
    out = {r.product_code: r for r in trend.detrend_by_line(_panel(spark), "value").filter("reporter_country = 'A' and year = 2000").collect()}
    assert out["02"]["detrended_value"] is None
    # Product 01: 10 and 20 in 2000, 30 in 2001; the line goes through 15 and 30.
    assert out["01"]["trend_line_value"] == pytest.approx(15.0, abs=1e-6)


def _official(spark):
    data = [("01", dt.date(2000, 7, 1), 4.0), ("01", dt.date(2000, 8, 1), 6.0), ("03", dt.date(2002, 1, 1), 9.0)]
    return spark.createDataFrame(data, "product_code string, effective_date date, rate double")


def test_densify_carries_forward_over_missing_years(spark, rows):
    assert rows(added.densify(_official(spark), 2003)) == [("01", y, 5.0) for y in range(2000, 2004)] + [("03", 2002, 9.0), ("03", 2003, 9.0)]
    assert added.densify(_official(spark), 1999).count() == 0


def test_overlay_traps(spark, rows):
    p = spark.createDataFrame(
        [(2001, "156", "840", "01", 1.0), (2001, "999", "840", "01", 1.0), (2001, "999", "840", "720610", 1.0), (1990, "156", "840", "760110", None), (2001, "156", "999", "01", 1.0)],
        "year int, reporter_country string, partner_country string, product_code string, average_tariff double")
    out = added.overlay_official(p, _official(spark))
    assert rows(out, "reporter_country", "partner_country", "product_code", "official_tariff", "average_tariff_official") == [
        ("156", "840", "01", 5.0, 6.0), ("156", "840", "760110", 0.10, None), ("156", "999", "01", 0.0, 1.0), ("999", "840", "01", 0.0, 1.0), ("999", "840", "720610", 0.25, 1.25)]
    assert rows(added.overlay_official(out, _official(spark))) == rows(out)


def test_prepare_added(spark):
    lists = spark.createDataFrame([("01", dt.date(2018, 7, 1), 0.25), ("01", dt.date(2018, 7, 4), 0.10)], "product_code string, effective_date date, rate double")
    row = added.prepare_added(lists).first()
    assert (row["effective_date"], round(row["rate"], 9), row["hs_revision"]) == (dt.date(2018, 7, 2), 17.5, "HS6")


def test_headings_keep_the_last_row(spark, rows):
    codes = spark.createDataFrame([("8412.21.00", "h1"), ("8412.21.00", "h1"), ("8412.29.00", "h2")], "hs_code string, heading string")
    log = spark.createDataFrame([(" h1", dt.date(2018, 1, 1), 0.1, 1), ("h1 ", dt.date(2019, 1, 1), None, 2)], "hts_heading string, effective_date date, applied_rate double, seq int")
    mapped = added.rates_by_heading(codes, log)
    assert rows(mapped, "hs_code", "rate") == [("8412.21.00", 0.0), ("8412.29.00", None)]
    assert rows(added.six_digit_rates(mapped), "product_code", "rate") == [("841221", 0.0)]


def test_preset_actions(spark, rows):
    from tradeloom import presets
    from tradeloom.sources.added import action_log

    codes = spark.createDataFrame([("0101.21.00", "9903.88.03"), ("0101.29.00", "9903.88.15")], "hs_code string, heading string")
    mapped = added.rates_by_heading(codes, presets.tariff_action_log(spark))
    assert rows(mapped, "heading", "rate") == [("9903.88.03", 0.25), ("9903.88.15", 0.075)]
    assert len(set(presets.STEEL_AND_ALUMINIUM_PRODUCTS)) == 187


def test_row_checks(spark, rows):
    df = spark.createDataFrame([(1, "a", 100.0, "x"), (2, "b", None, None), (3, "c", 5.0, "y"), (3, "c", 5.0, "y")], "id int, k string, v double, t string")
    wanted = spark.createDataFrame([(1, "a", "100.9", "x"), (2, "b", None, None), (3, "c", "5", "y"), (4, "d", "1", "x")], "id int, k string, expected_v string, expected_t string")
    assert rows(validate.check_rows(df, wanted, ["id", "k"], ["v", "t"]), "id", "matches", "passed") == [(1, 1, True), (2, 1, True), (3, 2, False), (4, 0, False)]
    assert rows(validate.check_rows(df, wanted, ["id", "k"], ["v", "t"], unique=False), "id", "passed")[2] == (3, True)
    assert rows(validate.check_rows(df, wanted, ["id", "k"], ["v"], tolerance=0.001), "id", "passed")[0] == (1, False)
    with pytest.raises(ValueError):
        validate.check_rows(df, wanted, ["nope"], ["v"])


def test_all_stages(spark, tmp_path):
    (tmp_path / "flows").mkdir()
    (tmp_path / "flows" / "Y2000.csv").write_text("t,i,j,k,v,q\n2000,156,840,010111,10,2\n2000,490,918,010190,4,1\n")
    header = "NomenCode,Reporter_ISO_N,Year,ProductCode,{p}Sum_Of_Rates,Min_Rate,Max_Rate,SimpleAverage,a,b,c,d,e,f,EstCode\n"
    for kind, partner, line in (("AVEMFN", "", "H1,840,2000,111111,0,1,3,2,0,0,0,0,1,1,\n"), ("AVEPref", "Partner,", "H1,158,2000,010190,G1,0,0,1,0.5,0,0,0,0,1,1,\n")):
        folder = tmp_path / "tariffs" / kind / f"{kind}_H1_840_2000_U2"
        folder.mkdir(parents=True)
        (folder / "JobID-1.CSV").write_text(header.format(p=partner) + line)
    concordance = spark.createDataFrame([("H1", "111111", "010111")], "hs_revision string, source_code string, target_code string")
    members = spark.createDataFrame([("G1", "040")], "pref_group_code string, country_iso_num string")
    from tradeloom import presets

    areas = presets.area_code_table(spark)
    official = spark.createDataFrame([("010111", dt.date(2000, 1, 1), 25.0)], "product_code string, effective_date date, rate double")
    out = spark.read.parquet(stages.run(spark, f"{tmp_path}/flows/*.csv", f"{tmp_path}/tariffs", concordance, members, areas, areas, official, f"{tmp_path}/out"))
    assert out.count() == 29
    assert out.filter("product_code = '010111'").select("average_tariff", "official_tariff", "average_tariff_official").first() == (2.0, 25.0, 27.0)
    assert [tuple(r) for r in out.filter("average_tariff = 0.5").select("reporter_country", "partner_country").collect()] == [("158", "040")]
