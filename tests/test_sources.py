from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tradeloom.functions import columns as C
from tradeloom.sources import added, dimensions, flows, panel, sinks, tariffs

MFN_HEADER = "NomenCode,Reporter_ISO_N,Year,ProductCode,Sum_Of_Rates,Min_Rate,Max_Rate,SimpleAverage,Nbr_NA_Lines,Nbr_Free_Lines,Nbr_AVE_Lines,Nbr_Dutiable_Lines,TotalNoOfValidLines,TotalNoOfLines,EstCode"


def test_flows(spark, tmp_path, rows):
    (tmp_path / "Y1995.csv").write_text("t,i,j,k,v,q\n1995,4,842,010111,  1.50,NA\n")
    (tmp_path / "Y1996.csv").write_text("t,i,j,k,v,q\n1996,251,36,010190,2,  3.0\n")
    out = flows.name_columns(flows.pad_countries(flows.scan_flows(spark, f"{tmp_path}/Y*.csv")))
    assert rows(out) == [(1995, "004", "842", "010111", 1.5, None), (1996, "251", "036", "010190", 2.0, 3.0)]
    with pytest.raises(AnalysisException):
        flows.scan_flows(spark, f"{tmp_path}/none*.csv")
    (tmp_path / "Y1997.csv").write_text("t,j,i,k,v,q\n1997,4,842,010111,1,2\n")  # columns in another order
    with pytest.raises(Exception, match="header"):
        flows.scan_flows(spark, f"{tmp_path}/Y1997.csv").collect()


def test_tariff_files(spark, tmp_path, rows):
    folder = tmp_path / "AVEMFN_H3_840_2010_U2"
    folder.mkdir()
    (folder / "AVEMFN_JobID-1.CSV").write_text(
        MFN_HEADER + "\n"
        + 'H3,840,2010,010111,"0","0","NA", 2.50 ,0,0,0,0,1,1,\n'
        + "H3,840,2010,010190,0,,7,oops,x,0,0,0,1,1,N,extra,fields\n"
    )
    (folder / "notes.CSV").write_text(MFN_HEADER + "\nH3,999,2010,1,0,0,0,0,0,0,0,0,1,1,\n")
    raw = tariffs.scan_tariffs(spark, "AVEMFN", str(tmp_path))
    out = tariffs.tidy_tariffs(raw, "AVEMFN")
    assert rows(out) == [
        (2010, "840", "010111", "H3", 2.5, 0.0, None, "AVEMFN"),
        (2010, "840", "010190", "H3", None, None, 7.0, "AVEMFN"),
    ]
    assert rows(raw.select("folder_revision", "folder_country", "folder_year").distinct()) == [("H3", "840", 2010)]
    assert tariffs.unparsed_rates(raw).first()["SimpleAverage"] == 1
    with pytest.raises(ValueError):
        tariffs.scan_tariffs(spark, "AVEother", str(tmp_path))


def test_latin1_positions(spark, tmp_path, rows):
    for r in ("H1", "H2"):
        (tmp_path / f"{r}_to_H0.CSV").write_bytes(f"a,b,c\n10{r[1]},café,200\n".encode("latin-1"))
    assert rows(dimensions.scan_concordance(spark, str(tmp_path), ("H1", "H2"))) == [("H1", "101", "200"), ("H2", "102", "200")]
    (tmp_path / "groups.csv").write_bytes("RegionCode,Name,Country\nG1,é,4\nG1,é,36\nG1,é,36\n".encode("latin-1"))
    lists = dimensions.member_lists(dimensions.scan_membership(spark, f"{tmp_path}/groups.csv")).first()
    assert lists["members"] == ["004", "036", "036"] and lists["distinct_members"] == ["004", "036"]


def test_added_lists(spark, tmp_path, rows):
    for i, line in enumerate(["2018m7,01011100,0.25", "2019m12,01019000,0.1"]):
        (tmp_path / f"part{i}.csv").write_text("time,hs_code,tariff_add\n" + line + "\n")
    out = added.scan_added(spark, [f"{tmp_path}/part0.csv", f"{tmp_path}/part1.csv"])
    assert rows(out) == [(dt.date(2018, 7, 1), "010111", 0.25), (dt.date(2019, 12, 1), "010190", 0.1)]


def test_action_log_rules_last_wins(spark):
    log = added.action_log(spark, [{"action_entity": "A", "applied_rate": 0.25}, {"action_entity": "B"}])
    out = added.set_where(log, "hts_heading", [(F.col("action_entity") == "A", "1"), (F.col("applied_rate") > 0, "2")])
    assert {r.action_entity: r.hts_heading for r in out.collect()} == {"A": "2", "B": None}


def test_exclusions(spark, rows):
    details = [{"date_of_exclusion_start": "2018-07-06", "chapter_99_code": "c1", "source_document_url": "u"}, {"date_of_exclusion_start": "2018-08-23", "chapter_99_code": "c2", "source_document_url": "u"}]
    from pyspark.sql import types as T

    df = spark.createDataFrame([({"8412": details, "8418": details[:1]},)], T.StructType([T.StructField("exclusions", added.EXCLUSIONS)]))
    out = added.flatten_exclusions(df)
    assert rows(out, "hts_code", "chapter_99_code") == [("8412", "c1"), ("8412", "c2"), ("8418", "c1")]


def _flows(spark):
    return spark.createDataFrame([(1995, "a", 1.0), (1995, "b", 2.0), (1996, "a", 3.0)], "year int, k string, value double")


def test_year_overwrite_keeps_other_years(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    sinks.write_by_year(_flows(spark), path)
    sinks.write_by_year(spark.createDataFrame([(1996, "z", 9.0)], "year int, k string, value double"), path, only_years_present=True)
    assert rows(panel.scan_panel(spark, path), "year", "k") == [(1995, "a"), (1995, "b"), (1996, "z")]
    sinks.write_by_year(_flows(spark).filter("year = 1996"), path)
    assert rows(panel.scan_panel(spark, path), "year", "k") == [(1996, "a")]


def test_partition_pruning_and_pushdown(spark, tmp_path):
    path = sinks.write_by_year(_flows(spark), f"{tmp_path}/t")
    plan = panel.scan_panel(spark, path).filter("year = 1995 and value > 1").select("k")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThan(value,1.0)" in plan


def test_next_version_leaves_the_source(spark, tmp_path, rows):
    path = sinks.write_by_year(_flows(spark), f"{tmp_path}/t")
    out = sinks.write_next_version(panel.scan_panel(spark, path).withColumn("x", C.ratio("value", "value")), path, "v2")
    assert out != path and "x" not in panel.scan_panel(spark, path).columns
    assert panel.scan_panel(spark, out).count() == 3
    assert panel.scan_recursive(spark, out).count() == 3


def test_shared_dir_needs_a_setting_on_a_cluster(spark, monkeypatch):
    from tradeloom import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster())


def test_rejected_fields(spark, tmp_path):
    folder = tmp_path / "AVEMFN_H3_840_2010_U2"
    folder.mkdir()
    good = "H3,840,2010,010101,0,NA,5.0, 2.5,1,1,1,1,1,1,x"
    lines = [good, good.replace("2010", "20x0"), good.replace("5.0", "n/a"), good + ",more", good.rsplit(",", 3)[0], good.replace(",1,1,", ",one,1,", 1)]
    (folder / "JobID_1.CSV").write_text("\n".join([",".join(f.name for f in tariffs.tariff_schema("AVEMFN")), *lines]) + "\n")
    got = sorted((r.reason, r.column or "", r.text, r.folder_year) for r in tariffs.rejected_fields(spark, "AVEMFN", str(tmp_path)).collect())
    assert got == sorted([("type", "Year", "20x0", 2010), ("rate", "Max_Rate", "n/a", 2010), ("fields", "", lines[3], 2010), ("fields", "", lines[4], 2010), ("type", "Nbr_NA_Lines", "one", 2010)])
    assert tariffs.scan_tariffs(spark, "AVEMFN", str(tmp_path)).count() == len(lines)
