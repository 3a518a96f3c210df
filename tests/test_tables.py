import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skein.scratch import Scratch, shared_dir
from skein.sources import tables as t


def catalogue(tmp_path, text):
    path = tmp_path / "c.csv"
    path.write_text(text)
    return str(path)


def test_catalogue_by_synonyms(spark, tmp_path):
    raw = t.read_catalogue(spark, catalogue(tmp_path, "ID , X,y,z,A_V,extra\n 200041998458135987.0 ,1,2,3,,q\nb,4,5,6,0.5,r\n"))
    rows = t.load_points(raw).orderBy("x_pc").collect()
    assert [(r.source_id, r.x_pc, r.reddening_mag) for r in rows] == [("200041998458135987", 1.0, None), ("b", 4.0, 0.5)]
    with pytest.raises(ValueError, match="no column for distance_pc"):
        t.find_column(raw, "distance_pc")
    bad = t.read_catalogue(spark, catalogue(tmp_path, "id,x,y,z,av\n1,nan,0,0,1\n"))
    with pytest.raises(ValueError, match="finite"):
        t.load_points(bad)


def test_kinematics(spark):
    base = spark.createDataFrame([("1.0", 5), (" 2", 6), (None, 7)], "source_id string, v int")
    kin = spark.createDataFrame([("1", 9.0), ("3", 8.0)], "id string, v double")
    rows = {r.source_id: (r.v, r.matched) for r in t.join_kinematics(base, kin, ["v"]).collect()}
    assert rows == {"1.0": (9.0, True), " 2": (None, False), None: (None, False)}
    for wrong in ([("1", 1.0), ("1.0", 2.0)], [("", 1.0)]):
        with pytest.raises(ValueError):
            t.join_kinematics(base, spark.createDataFrame(wrong, "id string, v double"), ["v"])


def test_kinematic_modes(spark):
    direct = spark.createDataFrame([("1", "2.5", "x", 0.0, 0.0)], "id string, V_L_LSR_KMS string, vb_lsr string, glon double, glat double")
    assert tuple(t.kinematics(direct).first()) == ("1", 2.5, None)
    assert t.kinematics(direct, frame="heliocentric").first().vl_lsr_kms == pytest.approx(2.5 + 12.24)
    raw = spark.createDataFrame([("1.0", 10.0, 20.0, 3.0, 4.0), ("2", 10.0, 20.0, 3.0, 4.0)], "id string, ra double, dec double, pmra double, pmdec double")
    base = spark.createDataFrame([("1", 1000.0), ("2", -1.0)], "source_id string, distance double")
    rows = {r.source_id: r for r in t.kinematics(raw, base).collect()}
    assert rows["1"].vl_lsr_kms is not None and rows["2"].vl_lsr_kms is None
    for wrong in (lambda: t.kinematics(direct, frame="icrs"), lambda: t.kinematics(direct.drop("vb_lsr")), lambda: t.kinematics(raw)):
        with pytest.raises(ValueError):
            wrong()


def test_runs_from_folders_and_zips(spark, tmp_path):
    for n in (3, 12):
        folder = tmp_path / "dirs" / f"mc_{n:04d}"
        folder.mkdir(parents=True)
        (folder / "DONE.json").write_text(json.dumps({"realisation": n, "scale": n / 2}))
        (tmp_path / "zips").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / "zips" / f"mc_{n:04d}.zip", "w") as z:
            z.writestr("in/DONE.json", json.dumps({"realisation": n, "scale": n / 2}))
            z.writestr("in/placements.csv", 'label,rotation\na,"[[1,0],[0,1]]"\n')
    for root in ("dirs", "zips"):
        rows = t.read_run_json(spark, str(tmp_path / root), "DONE.json", "realisation long, scale double").collect()
        assert {(r.realisation, r.scale) for r in rows} == {(3, 1.5), (12, 6.0)}
    few = t.read_run_csv(spark, str(tmp_path / "zips"), "placements.csv", start=4, end=13).collect()
    assert [(r.realisation, r.cells["label"]) for r in few] == [(12, "a")]
    with pytest.raises(Exception, match="holds 0 files"):
        t.read_run_csv(spark, str(tmp_path / "zips"), "absent.csv").collect()


def test_runs_need_the_files_beside_and_hand_lines_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "PIECE_LINES", 2)
    for n, names in ((1, ("DONE.json", "placements.csv")), (2, ("placements.csv",))):
        folder = tmp_path / f"mc_{n:04d}"
        folder.mkdir()
        for name in names:
            (folder / name).write_text("{}" if name == "DONE.json" else 'label,note\na,"two\nlines"\nb\nc,x,beyond\n\nd,\n')
    both = t.read_run_csv(spark, str(tmp_path), "placements.csv").groupBy("realisation").count().collect()
    assert {(r[0], r[1]) for r in both} == {(1, 4), (2, 4)}
    rows = t.read_run_csv(spark, str(tmp_path), "placements.csv", beside=("DONE.json",)).orderBy("line").collect()
    assert [(r.realisation, r.line, r.cells) for r in rows] == [(1, 0, {"label": "a", "note": "two\nlines"}), (1, 1, {"label": "b", "note": ""}), (1, 2, {"label": "c", "note": "x"}), (1, 3, {"label": "d", "note": ""})]


def test_typed_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text("v,ID,other\n1.5,000123,x\nbad, 7 ,y\n,,\n")
    rows = t.read_typed(spark, str(tmp_path / "c.csv"), "id bigint, v double").collect()
    assert [(r.id, r.v) for r in rows] == [(123, 1.5), (7, None), (None, None)]


def test_sinks_and_resume(spark, tmp_path):
    frame = spark.range(4).selectExpr("id realisation", "id * 2 v")
    t.write_result(frame, str(tmp_path / "o"), form="csv", gzip=True)
    assert list((tmp_path / "o").glob("*.csv.gz")) and spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 4
    t.write_config(spark, str(tmp_path / "config.json"), {"n": 1})
    assert json.loads((tmp_path / "config.json").read_text())["n"] == 1
    assert "mean x: 0.5" in t.summary_text({"mean_x": 0.5}) and "| a |" in t.markdown_report("R", [{"a": 1}])
    assert sorted(r[0] for r in t.unfinished(frame, frame.where("realisation < 2")).select("realisation").collect()) == [2, 3]
    numbers = spark.createDataFrame([("x/MC_0012.zip",), ("x/y",)], "p string").select(t.run_number(F.col("p")))
    assert [r[0] for r in numbers.collect()] == [12, 10**9]


def test_scratch_is_in_the_shared_folder(spark):
    scratch = Scratch(spark, "job")
    kept = scratch.keep(spark.range(3).toDF("a"))
    assert kept.count() == 3 and kept._scratch_path.startswith(shared_dir(spark))
    scratch.drop(kept)


def test_entry_contract(spark):
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and {"p1_found", "p2_found"} <= names
    assert __spark_entry__.entry(spark).limit(1).count() == 1
