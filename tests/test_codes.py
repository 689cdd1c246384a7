from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tradeloom import presets
from tradeloom.functions import columns as C
from tradeloom.operators import harmonise


def test_zfill_never_cuts(spark):
    out = spark.createDataFrame([("4",), ("1234",), (None,)], "c string").select(C.zfill("c", 3).alias("c")).collect()
    assert [r.c for r in out] == ["004", "1234", None]


def test_rate_text(spark):
    out = spark.createDataFrame([(" 1.5 ",), ("NA",), ("",), (None,)], "c string").select(C.rate_from_text("c").alias("c")).collect()
    assert [r.c for r in out] == [1.5, None, None, None]


def test_logs_and_ratios_are_null_not_infinite(spark):
    out = spark.createDataFrame([(0.0, 1.0), (-1.0, 0.0), (1.0, 2.0)], "a double, b double")
    got = out.select(C.log_or_null("a").alias("l"), C.ratio("a", "b").alias("r"), C.is_number(C.log_or_null("a")).alias("n")).collect()
    assert [(r.l, r.r, r.n) for r in got] == [(None, 0.0, False), (None, None, False), (0.0, 0.5, True)]


def test_nan_and_null_are_told_apart(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan), (2, None), (3, 1.0), (4, float("inf"))], "i int, x double")
    assert sorted(r.i for r in C.drop_nan(df, ["x"]).collect()) == [2, 3, 4]
    assert sorted(r.i for r in C.drop_null(df, ["x"]).collect()) == [1, 3, 4]
    assert sorted(r.i for r in df.filter(C.is_number("x")).collect()) == [3]
    assert [r.f for r in df.orderBy("i").select(C.fill_missing("x", 7).alias("f")).collect()][:3] == [7.0, 7.0, 1.0]


def test_weighted_mean_counts_the_weight_of_missing_values(spark):
    df = spark.createDataFrame([(2.0, 1.0), (None, 3.0)], "x double, w double")
    assert df.agg(C.weighted_mean("x", "w")).first()[0] == 0.5


def test_empty_sum_is_zero(spark):
    df = spark.createDataFrame([(1.0,)], "x double").filter("x > 2")
    assert df.agg(C.sum_or_zero("x")).first()[0] == 0.0


CONCORDANCE = [("H1", "100", "200"), ("H1", "100", "201"), ("H6", "300", "400"), ("H0", "500", "900"), ("HS6", "600", "700")]
ROWS = [("H1", "100", 1), ("H1", "999", 2), ("H0", "500", 3), (None, "100", 4), ("H6", "300", 5), ("HS6", "600", 6), ("HS9", "600", 7)]


def test_translation(spark, rows):
    df = spark.createDataFrame(ROWS, "hs_revision string, product_code string, v int")
    table = spark.createDataFrame(CONCORDANCE, "hs_revision string, source_code string, target_code string")
    out = harmonise.translate_products(df, table)
    assert out.columns == ["product_code", "v"]
    assert rows(out) == [("200", 1), ("201", 1), ("400", 5), ("500", 3), ("600", 7), ("700", 6), ("999", 2)]
    report = harmonise.translation_report(df, table).first().asDict()
    assert report == {"codes_before": 5, "base_rows": 1, "dropped_rows": 1, "translated_rows": 4, "left_alone_rows": 2, "codes_after": 7}


def test_area_codes_repeat_the_full_value(spark, rows):
    table = presets.area_code_table(spark)
    df = spark.createDataFrame([("918", 10.0), ("490", 1.0), ("004", 2.0), (None, 3.0)], "i string, v double")
    out = harmonise.remap_countries(df, table, "i")
    assert out.filter(F.col("v") == 10.0).count() == 28
    assert rows(out.filter(F.col("v") < 10)) == [("004", 2.0), ("158", 1.0), (None, 3.0)]


def test_country_precedence(spark, rows):
    codes = spark.createDataFrame([(c,) for c in ("918", "004", "X1", "X2", "X3", "X4")] + [(None,)], "original_code string")
    standard = spark.createDataFrame([("004", "004"), ("Belgium", "056"), ("fra", "250"), ("918", "111")], "label string, iso_num string")
    first = spark.createDataFrame([("X1", "BELGIUM", "FRA"), ("X2", "Nowhere", "FRA"), ("X3", "", None)], "country_code string, country_name string, country_iso3 string")
    second = spark.createDataFrame([("X3", "Belgium", None), ("X2", "Belgium", None)], "country_code string, country_name string, country_iso3 string")
    areas = spark.createDataFrame([("918", "040"), ("918", "056")], "original_code string, iso_num string")
    out = harmonise.country_map(codes, areas, standard, [first, second])
    # X2: the first table's name wins even though it is unknown; then its ISO3 decides.
    assert rows(out) == [("004", "004"), ("918", "040"), ("918", "056"), ("X1", "056"), ("X2", "250"), ("X3", "056"), ("X4", "X4")]


def test_group_expansion(spark, rows):
    members = spark.createDataFrame([("G1", "001"), ("G1", "002"), ("G1", "002")], "pref_group_code string, country_iso_num string")
    df = spark.createDataFrame([("G1", 1), ("777", 2)], "partner_country string, v int")
    assert rows(harmonise.expand_groups(df, members)) == [("001", 1), ("002", 1), ("002", 1)]
    assert rows(harmonise.expand_groups(df, members, keep_individuals=True)) == [("001", 1), ("002", 1), ("002", 1), ("777", 2)]


def test_preset_groups_name_known_countries():
    for group in presets.COUNTRY_GROUPS:
        codes = presets.country_group(group)
        assert len(codes) == len(set(codes)) and all(len(c) == 3 for c in codes)
    with pytest.raises(KeyError):
        presets.country_group("nobody")


def test_nearest_labels(spark, rows):
    labels = spark.createDataFrame([(x,) for x in ("Germany", "Guinea", "Guyana", "Mali", "Malta", "Viet Nam", "United Kingdom", "", None)], "label string")
    names = ["germny", "GERMANY", "Guiana", "Mal", "Vietnam", "Untied Kingdom", "Atlantis", "x", "", None]
    found = harmonise.nearest_labels(spark.createDataFrame([(n,) for n in names], "name string"), labels)
    # Guiana is one letter from Guyana and two from Guinea; Mal may be one edit away; x is too short for any.
    assert rows(found) == [("germany", "germany", 0), ("germny", "germany", 1), ("guiana", "guyana", 1), ("mal", "mali", 1), ("untied kingdom", "united kingdom", 2), ("vietnam", "viet nam", 1)]


def test_inexact_names_come_after_exact_ones(spark, rows):
    codes = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "original_code string")
    standard = spark.createDataFrame([("france", "250"), ("Germany", "276"), ("deu", "999"), ("fra", "998")], "label string, iso_num string")
    table = spark.createDataFrame([("1", "France", "FRA"), ("2", "Germny", "DEU"), ("3", "Nowhere", "DEU"), ("4", None, None)], "country_code string, country_name string, country_iso3 string")
    none = spark.createDataFrame([], "original_code string, iso_num string")
    assert rows(harmonise.country_map(codes, none, standard, [table], inexact=2)) == [("1", "250"), ("2", "276"), ("3", "999"), ("4", "4")]
    assert rows(harmonise.country_map(codes, none, standard, [table])) == [("1", "250"), ("2", "999"), ("3", "999"), ("4", "4")]
