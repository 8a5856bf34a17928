"""Whole conversions: what is refused, what is recorded, what comes back, and what a proof finds."""

import gzip
import hashlib
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from peakloom.operators import arrays, lookup, verify
from peakloom.plans import convert, corpus, export, fidelity
from peakloom.sources import archive, samples, terms, xml
from peakloom.streaming import ingest

SCHEMA = "spectrum_index long, native_id string, ms_level int, representation string, x long, y long, z long, intensity_type string, mz array<double>, intensity array<double>"
PIXELS = [
    (0, "a", 1, "profile", 1, 1, None, "f32", [100.0, 101.0, 102.0, 103.0, 104.0], [0.0, 0.0, 5.0, 0.0, 0.0]), (1, "b", 1, "centroid", 3, 1, None, "f64", [5.0, 3.0, 4.0], [1.0, 2.0, 0.1]),
    (2, "c", 2, "unknown", 2, 3, None, "f32", [7.0, 7.0], [0.0, 1.5]), (3, "d", 1, "profile", 2, 2, None, "f32", [1.0, 2.0], [0.0, 0.0]), (4, "e", 1, "centroid", 1, 2, None, "f32", [], []),
]


@pytest.fixture
def pixels(spark):
    return spark.createDataFrame(PIXELS, SCHEMA)


@pytest.fixture
def run(spark, pixels, tmp_path):
    """An exported image with its geometry and a picture."""
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (4).to_bytes(4, "big") + (5).to_bytes(4, "big")
    (tmp_path / "slide.png").write_bytes(png)
    image = {"file": "slide.png", "of_analysed": True, "adjacent": False, "morphology": "a & b", "staining": "H&E", "alignment": None}
    export.export_imzml(pixels, str(tmp_path / "run"), geometry={"grid_x": 3, "grid_y": 3, "pixel_x": 10.0, "pixel_y": 20.0, "offset_x": 5}, images=[image])
    return str(tmp_path / "run")


def damaged(pixels, spark, **change):
    rows = [dict(zip(pixels.columns, r, strict=True)) for r in PIXELS]
    rows[1] |= change
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


@pytest.mark.parametrize("change, text", [({"intensity": [1.0]}, "length"), ({"x": 0}, "COORDINATE"), ({"z": 0}, "COORDINATE"), ({"mz": [1.0, float("nan"), 2.0]}, "finite"), ({"mz": [1.0, float("inf"), 2.0]}, "finite")])
def test_writes_are_checked(spark, pixels, tmp_path, change, text):
    with pytest.raises(Exception, match=text) as e:
        archive.write_archive(damaged(pixels, spark, **change), str(tmp_path / "a"))
    assert convert.classified(e.value).code == (4 if text == "COORDINATE" else 1)
    assert not os.path.exists(tmp_path / "a" / "index")


def test_index_says_what_was_done(spark, pixels, tmp_path):
    index = archive.write_archive(pixels, str(tmp_path / "a"))
    assert index["resorted"] == 1 and index["warnings"] == [{"kind": "m/z not ascending, sorted", "n": 1, "first": [1]}] and index["content"] == ["ms1", "msn"]
    assert index["narrowed"] and "intensities narrowed to 32 bits" in index["processing"]
    wide = archive.write_archive(pixels, str(tmp_path / "b"), intensity_width="source")
    assert wide["intensity_width"] == "double" and not wide["narrowed"]
    got = {r["spectrum_index"]: r for r in archive.read_archive(spark, str(tmp_path / "b")).collect()}
    assert got[0]["mz"] == [101.0, 102.0, 103.0] and got[1]["mz"] == [3.0, 4.0, 5.0] and got[1]["intensity"] == [2.0, 0.1, 1.0] and got[3]["mz"] == [] and got[2]["intensity"] == [0.0, 1.5]
    assert archive.write_archive(pixels.filter("intensity_type = 'f32'"), str(tmp_path / "c"))["narrowed"] is False
    only = archive.read_archive(spark, str(tmp_path / "a"), "profile")
    assert only.count() == 2 and "spectra_peaks" not in "".join(only.inputFiles())


def made(spark, n=600, points=400):
    """Centroid spectra over 10 to 2000 Th whose neighbouring m/z may lie a factor of two apart."""
    draw = lambda seed: f"(xxhash64(id, j, {seed}) & 1048575) / 1048576D"
    steps = f"sequence(1, {points})"
    return spark.range(n).selectExpr("id AS spectrum_index", "concat('s', id) AS native_id", "'centroid' AS representation", "id % 30 + 1 AS x", "floor(id / 30) + 1 AS y", f"array_sort(transform({steps}, j -> 10 + 1990 * {draw(1)})) AS mz", f"transform({steps}, j -> {draw(2)}) AS intensity")


@pytest.mark.parametrize("encoding", ["delta", "numpress"])
def test_chunks_are_pruned_by_windows(spark, tmp_path, encoding):
    rows = made(spark).coalesce(2)
    rows.write.parquet(str(tmp_path / "source"))
    rows = spark.read.parquet(str(tmp_path / "source"))
    archive.write_archive(rows, str(tmp_path / "a"), mz_encoding=encoding, group_bytes=20_000, intensity_width="source")
    groups = []
    for folder, _, files in os.walk(tmp_path / "a" / "facet=spectra_peaks"):
        for f in files:
            if f.endswith(".parquet"):
                meta = pq.ParquetFile(os.path.join(folder, f)).metadata
                for g in range(meta.num_row_groups):
                    cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
                    groups.append((cols["intensity.list.element"].num_values, cols["chunk_start"].statistics.min, cols["chunk_end"].statistics.max))
    assert len(groups) > 60 and max(g[0] for g in groups) < 12_000 and sum(g[0] for g in groups) >= 600 * 400
    low, high = 400.0, 430.0
    met = [g for g in groups if g[2] >= low and g[1] <= high]
    assert len(met) < len(groups) / 10
    image = {(r["x"], r["y"]): r["tic"] for r in archive.window_image(spark, str(tmp_path / "a"), low, high).filter("present").collect()}
    want = {(r["x"], r["y"]): r["t"] for r in rows.selectExpr("x", "y", f"aggregate(filter(arrays_zip(mz, intensity), p -> p.mz BETWEEN {low} AND {high}), 0D, (s, p) -> s + p.intensity) AS t").filter("t > 0").collect()}
    if encoding == "delta":
        assert image.keys() == want.keys() and all(abs(image[k] - want[k]) < 1e-9 for k in want)
    plan = archive.window_rows(spark, str(tmp_path / "a"), low, high)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(chunk_end" in plan


def test_lossless_is_exact(spark, tmp_path):
    rows = made(spark, 300, 12)
    rows.write.parquet(str(tmp_path / "source"))
    rows = spark.read.parquet(str(tmp_path / "source"))
    archive.write_archive(rows, str(tmp_path / "a"), mz_encoding="delta", intensity_width="source")
    back = archive.read_archive(spark, str(tmp_path / "a"))
    assert fidelity.report(rows, back, fidelity.Level.L1, by="index").first()["equal"]
    assert {r["spectrum_index"]: r["mz"] for r in rows.collect()} == {r["spectrum_index"]: r["mz"] for r in back.collect()}


@pytest.mark.parametrize("encoding", ["plain", "delta", "numpress"])
def test_archives_are_read_without_an_exchange(spark, pixels, tmp_path, encoding):
    archive.write_archive(pixels, str(tmp_path / "a"), mz_encoding=encoding)
    back = archive.read_archive(spark, str(tmp_path / "a"))
    assert sorted(len(r["mz"]) for r in back.collect()) == [0, 0, 2, 3, 3]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_further_arrays_in_chunks(spark, tmp_path):
    mz = [float(v) for v in range(10, 200, 3)]
    whole = [2**60 + k for k in range(len(mz))]
    rows = [(0, "centroid", mz, mz, [("i", "whole array", None, "i8", None, whole), ("s", "short array", None, "f4", [1.5], None)]), (1, "centroid", [], [], None)]
    df = spark.createDataFrame(rows, f"spectrum_index long, representation string, mz array<double>, intensity array<double>, others {xml.OTHERS}")
    archive.write_archive(df, str(tmp_path / "a"), mz_encoding="delta")
    a, b = archive.read_archive(spark, str(tmp_path / "a")).orderBy("spectrum_index").collect()
    assert a["mz"] == mz and a["others"][0]["integers"] == whole and a["others"][0]["values"] is None and a["others"][1]["values"] == [1.5] and not b["others"] and b["mz"] == []


def test_late_wide_intensities(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "SAMPLED", 2)
    rows = spark.createDataFrame([(k, "centroid", "f64" if k == 5 else "f32", [1.0], [0.1]) for k in range(6)], "spectrum_index long, representation string, intensity_type string, mz array<double>, intensity array<double>").coalesce(1)
    index = archive.write_archive(rows, str(tmp_path / "a"), intensity_width="source")
    assert index["intensity_width"] == "double" and archive.read_archive(spark, str(tmp_path / "a")).filter("intensity[0] = 0.1D").count() == 6


def test_other_arrays_follow_mz(spark):
    rows = [(0, "profile", [3.0, 1.0, 2.0, 4.0], [0.0, 0.0, 0.0, 9.0], [("m", "mobility array", None, "f8", [30.0, 10.0, 20.0, 40.0], None), ("s", "short array", None, "f4", [1.0], None), ("i", "whole array", None, "i8", None, [3, 1, 2, 2**60 + 1])]), (1, "centroid", None, None, None)]
    df = spark.createDataFrame(rows, f"spectrum_index long, representation string, mz array<double>, intensity array<double>, others {xml.OTHERS}")
    a, b = arrays.canonical(df, True, True).orderBy("spectrum_index").collect()
    assert a["mz"] == [3.0, 4.0] and a["intensity"] == [0.0, 9.0] and [o["values"] for o in a["others"]] == [[30.0, 40.0], [1.0], None] and a["others"][2]["integers"] == [3, 2**60 + 1] and a["was_unsorted"]
    assert b["mz"] is None and b["others"] is None and not b["was_unsorted"]
    uneven = spark.createDataFrame([(0, "profile", [2.0, 1.0], [5.0], None), (1, "profile", [2.0, 1.0, 3.0], [0.0, 4.0, 0.0], None)], df.schema)
    a, b = arrays.canonical(uneven, True, True).orderBy("spectrum_index").collect()
    assert a["mz"] == [1.0, 2.0] and a["intensity"] == [5.0] and b["mz"] == [1.0, 2.0] and b["intensity"] == [4.0, 0.0]


def test_round_trip_with_header_and_pictures(spark, run, tmp_path):
    text = open(f"{run}.imzML").read()
    for part in ("<cvList", "<softwareList", "<scanSettingsList", "<instrumentConfigurationList", "<dataProcessingList", "H&amp;E"):
        assert part in text
    assert text.index("<cvList") < text.index("<fileDescription") < text.index("<sampleList") < text.index("<softwareList") < text.index("<scanSettingsList") < text.index("<run ")
    index = convert.convert(spark, f"{run}.imzML", str(tmp_path / "a"), pictures=str(tmp_path / "*.png"), check=True)
    m = index["metadata"]
    assert m["imaging"]["pixel_size"] == {"x": 10.0, "y": 20.0} and "offset" not in m["imaging"] and m["imaging"]["grid"]["source"] == "declared"
    assert [f["id"] for f in m["source_files"]] == ["imzml", "ibd"] and m["run"]["default_source_file"] == "imzml" and m["software"][0]["parameters"][0]["accession"] == terms.CUSTOM_SOFTWARE
    assert [e["status"] for e in m["imaging"]["images"]] == ["ok"] and {t["accession"] for t in m["content"]} >= {terms.MS1_SPECTRUM, terms.MSN_SPECTRUM}
    (tmp_path / "out").mkdir()
    got = convert.convert(spark, str(tmp_path / "a"), str(tmp_path / "out" / "again.imzML"))
    assert got["images"] == ["slide.png"] and (tmp_path / "out" / "slide.png").read_bytes() == (tmp_path / "slide.png").read_bytes() and got["warnings"] == []
    again = str(tmp_path / "out" / "again")
    assert xml.preflight(spark, f"{again}.imzML", f"{again}.ibd").first()["ok"] and not [f for f in os.listdir(tmp_path / "out") if f.endswith(".tmp")]
    pair = (xml.read_geometry(spark, f"{run}.imzML"), xml.read_geometry(spark, f"{again}.imzML"))
    proof = fidelity.report(xml.read_imzml(spark, f"{run}.imzML", f"{run}.ibd"), xml.read_imzml(spark, f"{again}.imzML", f"{again}.ibd"), geometry=pair).first()
    assert proof["equal"] and proof["geometry_fields"] == 0
    o = xml.header_elements(spark, f"{again}.imzML", "sample", f"_id string, cvParam array<{xml.PARAM}>").first()
    assert "H&E" in [p["_value"] for p in o["cvParam"]] and "a & b" in [p["_value"] for p in o["cvParam"]]


def test_observed_grids_are_not_declared(spark, pixels, tmp_path):
    export.export_imzml(pixels, str(tmp_path / "r"), geometry={"grid_x": 2, "grid_y": 2, "pixel_x": float("nan")})
    index = convert.convert(spark, str(tmp_path / "r.imzML"), str(tmp_path / "a"))
    assert index["metadata"]["imaging"]["grid"]["source"] == "observed_exceeds_declared"
    convert.convert(spark, str(tmp_path / "a"), str(tmp_path / "again"))
    back = xml.read_geometry(spark, str(tmp_path / "again.imzML")).first()
    assert back["grid_x"] is None and back["pixel_x"] is None


def test_pictures_by_name_are_strict(spark, run, tmp_path):
    (tmp_path / "other.png").write_bytes((tmp_path / "slide.png").read_bytes() + b"x")
    index = convert.convert(spark, f"{run}.imzML", str(tmp_path / "a"), pictures=[str(tmp_path / "other.png"), str(tmp_path / "slide.png")])
    listed = index["metadata"]["imaging"]["images"]
    assert [os.path.basename(e["location"]) for e in listed] == ["other.png", "slide.png"] and [e["ordinal"] for e in listed] == [0, 1] and listed[1]["modality"] == "H&E"
    (tmp_path / "not.png").write_text("no picture")
    with pytest.raises(convert.ConversionError, match="not a picture"):
        convert.convert(spark, f"{run}.imzML", str(tmp_path / "b"), pictures=[str(tmp_path / "not.png")])
    with pytest.raises(convert.ConversionError):
        convert.convert(spark, f"{run}.imzML", str(tmp_path / "c"), pictures=[str(tmp_path / "absent.png")])


def test_unsafe_names_are_left_out(spark, tmp_path):
    assert [export.safe_name(n) for n in ("a.png", "", None, "..", ".", "a/b", "a\\b")] == [True, False, False, False, False, False, False]
    listed = [{"status": "ok", "archive_path": "images/0", "location": "..", "modality": None, "subtype": None}, {"status": "ok", "archive_path": "images/9", "location": "gone.png", "modality": None, "subtype": None}]
    none = spark.createDataFrame([], "spectrum_index long, representation string, mz array<double>, intensity array<double>")
    archive.write_archive(none, str(tmp_path / "a"))
    done, warnings = export.export_images(spark, str(tmp_path / "a"), listed, str(tmp_path))
    assert done == [] and len(warnings) == 2


def test_equal_names_are_numbered():
    assert export.numbered({"a": "x.png", "b": "X.png", "c": "x-2.png", "d": "", "e": "x.png"}) == {"a": "x.png", "b": "X-3.png", "c": "x-2.png", "d": "", "e": "x-4.png"}


def test_errors_have_their_class(spark, run, tmp_path):
    convert_ = lambda path, **o: convert.convert(spark, path, str(tmp_path / "x"), **o)
    with pytest.raises(convert.ConversionError, match="no conversion") as e:
        convert_(str(tmp_path / "run.raw"))
    assert e.value.code == 1
    text = open(f"{run}.imzML").read()
    (tmp_path / "bad.imzML").write_text(text.replace(terms.POSITION_X, "IMS:0"))
    with pytest.raises(convert.ConversionError) as e:
        convert_(str(tmp_path / "bad.imzML"), sidecar=f"{run}.ibd")
    assert e.value.code == 4
    (tmp_path / "int.imzML").write_text(text.replace(terms.FLOAT_64, terms.INTEGER_64))
    with pytest.raises(convert.ConversionError) as e:
        convert_(str(tmp_path / "int.imzML"), sidecar=f"{run}.ibd")
    assert e.value.code == 3
    with pytest.raises(convert.ConversionError, match="own source"):
        convert.convert(spark, f"{run}.imzML", f"{tmp_path}/./run.imzML")
    plain = spark.createDataFrame([(0, "centroid", [1.0], [1.0])], "spectrum_index long, representation string, mz array<double>, intensity array<double>")
    archive.write_archive(plain, str(tmp_path / "plain"))
    with pytest.raises(convert.ConversionError) as e:
        convert.convert(spark, str(tmp_path / "plain"), str(tmp_path / "y"))
    assert e.value.code == 4 and not os.path.exists(tmp_path / "y.imzML")


def test_both_files_or_neither(tmp_path):
    (tmp_path / "a.tmp").write_text("new")
    (tmp_path / "a").write_text("old")
    with pytest.raises(OSError):
        export.publish({str(tmp_path / "a.tmp"): str(tmp_path / "a"), str(tmp_path / "gone.tmp"): str(tmp_path / "b")})
    assert (tmp_path / "a").read_text() == "old" and not (tmp_path / "b").exists()


def test_headers_are_read_no_further(spark, tmp_path):
    group = f'<referenceableParamGroupList><referenceableParamGroup id="g"><cvParam accession="{terms.GRID_X}" name="n" value="7"/></referenceableParamGroup></referenceableParamGroupList>'
    head = f'<?xml version="1.0" encoding="ISO-8859-1"?><mzML>{group}<scanSettingsList><scanSettings id="s"><referenceableParamGroupRef ref="g"/><cvParam accession="{terms.PIXEL_X}" name="é" value="2"/></scanSettings></scanSettingsList><run id="r1" defaultInstrumentConfigurationRef="I"><spectrumList count="1">'
    for name, write in (("a.imzML", lambda p, b: p.write_bytes(b)), ("b.imzML.gz", lambda p, b: p.write_bytes(gzip.compress(b)))):
        write(tmp_path / name, head.encode("latin-1") + b"<spectrum <<< not XML")
        row = xml.read_geometry(spark, str(tmp_path / name)).first()
        assert row["grid_x"] == 7 and row["pixel_x"] == 2.0 and row["grid_y"] is None
        assert xml.detect_encoding(spark, str(tmp_path / name)) == ("ISO-8859-1" if name == "a.imzML" else "UTF-8") or name.endswith("gz")
    assert xml.read_run(spark, str(tmp_path / "a.imzML"))["run"] == {"id": "r1", "default_source_file": None, "default_instrument": "I"}


def test_proofs(spark, pixels, tmp_path):
    archive.write_archive(pixels, str(tmp_path / "a"))
    output = archive.read_archive(spark, str(tmp_path / "a"))
    proof = lambda s, o, **k: fidelity.report(s, o, **k).first()
    assert proof(pixels, output)["equal"] and proof(pixels, output, by="index")["equal"]
    moved = output.withColumn("x", F.when(F.col("spectrum_index") == 2, 3).otherwise(F.col("x")))
    got = proof(pixels, moved)
    assert not got["equal"] and got["missing"] == 1 and got["extra"] == 1
    assert proof(pixels, moved, by="index")["misplaced"] == 1
    fewer = proof(pixels, output.filter("spectrum_index > 0"))
    assert not fewer["equal"] and fewer["missing"] is None
    twice = output.withColumns({"x": F.lit(1), "y": F.lit(1)})
    assert proof(pixels, twice)["duplicate_output"] == 1
    # a dropped point that isn't zero, an added one, and values off by more or less than the bounds
    lost = output.withColumns({"mz": F.expr("filter(mz, m -> m <> 102)"), "intensity": F.expr("filter(intensity, v -> v <> 5)")})
    assert proof(pixels, lost)["mz_spectra"] == 1 and proof(pixels, lost)["tic_spectra"] == 1
    near, far = (output.withColumn("mz", F.transform("mz", lambda m: m * (1 + e))) for e in (5e-8, 2e-7))  # noqa: B023
    assert not proof(pixels, near)["equal"] and proof(pixels, near, level=fidelity.Level.L2)["equal"] and not proof(pixels, far, level=fidelity.Level.L2)["equal"]
    assert str(fidelity.Level.L2) == "l2" and fidelity.first_mismatches(fidelity.mismatches(pixels, lost)).count() == 1
    nan = damaged(pixels, spark, intensity=[1.0, float("nan"), 0.1])
    assert proof(nan, nan)["intensity_spectra"] == 1  # what isn't finite is never equal


def test_merge_by_brute_force():
    rng = np.random.default_rng(4)
    for k in range(2000):
        n = int(rng.integers(0, 9))
        sm, si = np.sort(rng.integers(1, 6, n).astype(float)), rng.integers(0, 3, n).astype(float)
        stays = rng.random(n) < 0.6
        om, oi = sm[stays].copy(), si[stays].copy()
        if len(om) and k % 3 == 0:
            om[rng.integers(len(om))] += rng.choice([1e-8, 0.5])
            om.sort()
        args = (sm, si), (om, oi), (0.0, 1e-7, 0.3)[k % 3], 0.0
        assert arrays.merged(*args) == arrays.merged_slowly(*args)


def test_isa_bundles(spark, tmp_path):
    (tmp_path / "i_x.txt").write_text('STUDY\nStudy Identifier\t"S1"\nStudy Title\t""\nINVESTIGATION\nInvestigation Title\t"Whole"\nSTUDY\nStudy File Name\t"s_there.txt"\n')
    with pytest.raises(FileNotFoundError, match="s_there"):
        samples.locate_isa(str(tmp_path))
    (tmp_path / "s_there.txt").write_text('"Source Name"\t"Characteristics[organ]"\t"Term Source REF"\t"Term Accession Number"\t"Sample Name"\t"Factor Value[dose]"\n"src"\t"liver"\t"BTO"\t"BTO:759"\t"P1"\t"high"\n')
    (tmp_path / "a_1.txt").write_text('"Sample Name"\t"Raw Spectral Data File"\n"P1"\t"run.raw"\n')
    files = samples.locate_isa(str(tmp_path / "a_1.txt"))
    assert [os.path.basename(f) for f in files["studies"] + files["assays"]] == ["s_there.txt", "a_1.txt"]
    (tmp_path / "run.mzML").write_text(f'<mzML><run><spectrumList><spectrum index="0" id="s"><cvParam accession="{terms.MS_LEVEL}" name="n" value="1"/></spectrum></spectrumList></run></mzML>')
    index = convert.convert(spark, str(tmp_path / "run.mzML"), str(tmp_path / "a"), isa=str(tmp_path), factors=True, check=True)
    m = index["metadata"]
    assert m["study"]["dataset_accession"] == "S1" and m["study"]["title"] == "Whole" and m["sample_ids"] == ["P1"]
    assert m["sample_list"][0]["traits"][0]["value"]["accession"] == "BTO:759" and m["factor_values"][0]["factor"] == "dose"
    assert convert.reconstruct(spark, str(tmp_path / "a"), str(tmp_path / "back.txt"), "isa") == len((tmp_path / "i_x.txt").read_bytes()) or (tmp_path / "back.txt").exists()
    audit = archive.conformance(spark, [str(tmp_path / "a"), str(tmp_path / "nothing")]).orderBy("path").collect()
    assert audit[0]["reasons"] == [] and audit[0]["injected"] and audit[1]["reasons"] == ["no index"]


def test_own_reporter_arrays(spark):
    rows = [(0, 2, [126.127726, 130.0], [9.0, 1.0], None), (1, 2, [1.0], [1.0], [("u", convert.REPORTER_ARRAY, None, "f8", [4.0], None)]), (2, 1, [1.0], [1.0], None)]
    df = spark.createDataFrame(rows, f"spectrum_index long, ms_level int, mz array<double>, intensity array<double>, others {xml.OTHERS}")
    got = [r["reporters"] and [(c["channel"], c["intensity"]) for c in r["reporters"]] for r in convert.with_reporters(df, [("A", 126.127726), ("B", 127.1)]).orderBy("spectrum_index").collect()]
    assert got == [[("A", 9.0), ("B", 0.0)], [("A", 4.0), ("B", 0.0)], None]
    points = spark.createDataFrame([(1, 10.0, 3.0), (1, 10.2, 4.0), (2, 50.0, 5.0)], "k int, mz double, v double")
    near = lookup.nearest_points(points, spark.createDataFrame([("A", 10.1), ("B", None)], "channel string, target double"), "k", "mz", "v", 0.11)
    assert {(r["k"], r["channel"], r["intensity"]) for r in near.collect()} == {(1, "A", 3.0), (2, "A", 0.0)}


def test_corpus_tables(spark, tmp_path):
    found = corpus.findings(spark.createDataFrame([("a", '{"verdict": "fail", "findings": [{"ruleId": "r1", "level": "Error", "message": "m"}, {"ruleId": "r2", "level": "warn", "message": "w"}]}'), ("b", "x")], "file string, report string"))
    rows = {r["file"]: r for r in found.collect()}
    assert rows["a"]["verdict"] == "FAIL" and rows["a"]["errors"][0]["rule"] == "r1" and rows["a"]["warnings"][0]["rule"] == "r2" and rows["b"]["verdict"] == "ENGINE_ERROR"
    total = corpus.manifest_totals(spark.createDataFrame([("p", 5, "Y", ""), ("q", 7, "N", "")], "path string, bytes long, stored string, recover_via string")).first()
    assert (total["files"], total["bytes"], total["stored_files"], total["stored_bytes"]) == (2, 12, 1, 5)
    assert hashlib.sha1(b"").hexdigest() == export.file_sha1(spark, str((tmp_path / "e").touch() or tmp_path / "e"))
    assert verify.EXACT.mz == 0


def test_streams_into_archives(spark, pixels, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "run")
    stream = lambda: ingest.into_archives(ingest.arriving(spark, source, pixels.schema, files=1), target, str(tmp_path / "checkpoint")).awaitTermination(120)
    pixels.filter("spectrum_index < 3").coalesce(1).write.parquet(source)
    stream()
    fold = ingest.committed_fold(spark, target).first()
    assert (fold["batches"], fold["spectra"], fold["resorted"], fold["max_x"], fold["max_y"], fold["mz_lo"], fold["mz_hi"], fold["has_msn"]) == (1, 3, 1, 3, 3, 3.0, 103.0, True)
    files = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(target) for f in names}
    assert not ingest.commit(spark, pixels, target, 0)  # a batch that comes again changes nothing
    assert files == {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(target) for f in names}
    pixels.filter("spectrum_index >= 3").coalesce(1).write.mode("append").parquet(source)
    stream()
    stream()
    assert ingest.committed_fold(spark, target).first()["spectra"] == 5 and len(ingest.committed(spark, target)) == 2
    back = {r["spectrum_index"]: (r["batch"], r["mz"]) for r in ingest.read_committed(spark, target).collect()}
    assert len(back) == 5 and back[1] == (0, [3.0, 4.0, 5.0]) and back[3][0] == 1
    # a commit that didn't end is written anew
    (tmp_path / "run" / "batch=7" / "facet=spectra_data").mkdir(parents=True)
    (tmp_path / "run" / "batch=7" / "facet=spectra_data" / "part-0.parquet").write_text("half")
    assert len(ingest.committed(spark, target)) == 2 and ingest.commit(spark, pixels.limit(2), target, 7) and len(ingest.committed(spark, target)) == 3


PIECES = """<indexedmzML><mzML><referenceableParamGroupList count="1"><referenceableParamGroup id="g"><cvParam accession="MS:1000130" name="positive scan" value=""/><userParam name="lab" type="xsd:string" value="x"/></referenceableParamGroup></referenceableParamGroupList>
<run id="r"><spectrumList count="1"><spectrum index="0" id="s0" defaultArrayLength="0"><referenceableParamGroupRef ref="g"/><cvParam accession="MS:1000511" name="ms level" value="2"/><scanList count="1"><cvParam accession="MS:1000795" name="no combination"/><scan instrumentConfigurationRef="IC2"><cvParam accession="MS:1000512" name="filter string" value="a &lt; b"/><scanWindowList count="1"><scanWindow><cvParam accession="MS:1000501" name="scan window lower limit" value="50" unitAccession="MS:1000040" unitName="m/z"/></scanWindow></scanWindowList></scan></scanList>
<precursorList count="2"><precursor spectrumRef="p1"/><precursor spectrumRef="p2"><isolationWindow><cvParam accession="MS:1000827" name="target" value="7.5"/></isolationWindow></precursor></precursorList><productList count="1"><product><isolationWindow><cvParam accession="MS:1000827" name="target" value="9"/></isolationWindow></product></productList></spectrum></spectrumList>
"""


@pytest.mark.parametrize("indexed", [True, False])
def test_many_chromatograms_are_split(spark, tmp_path, monkeypatch, indexed):
    monkeypatch.setattr(xml, "RANGE_BYTES", 40_000)
    one = '<chromatogram index="{k}" id="SRM {k}" defaultArrayLength="0"><cvParam accession="MS:1001473" name="SRM" value=""/><userParam name="n" value="{k}"/><precursor><isolationWindow><cvParam accession="MS:1000827" name="target" value="{k}"/></isolationWindow></precursor><product><isolationWindow><cvParam accession="MS:1000827" name="target" value="{h}"/></isolationWindow></product></chromatogram>\n'
    head = PIECES + '<chromatogramList count="5000">\n'
    offset = len(head.encode())
    text = head + "".join(one.format(k=k, h=k / 2) for k in range(5000)) + "</chromatogramList></run></mzML>"
    if indexed:
        text += f'<indexList count="2"><index name="spectrum"><offset idRef="s0">9</offset></index>\n<index name="chromatogram"><offset idRef="SRM 0">{offset}</offset></index></indexList>'
        text += f"<indexListOffset>{text.index('<indexList ')}</indexListOffset></indexedmzML>"
    (tmp_path / "run.mzML").write_text(text)
    path = str(tmp_path / "run.mzML")
    assert xml.first_chromatogram(spark, path, len(text.encode())) == (offset if indexed else 0)
    traces = xml.read_chromatograms(spark, path)
    assert traces.rdd.getNumPartitions() > 10
    rows = {r["chrom_index"]: r for r in traces.collect()}
    assert len(rows) == 5000 and rows[77]["id"] == "SRM 77" and rows[77]["product"][0]["value"] == "38.5" and rows[77]["precursor"]["isolation"][0]["value"] == "77" and rows[77]["params"][1]["name"] == "n"


def test_parameters_are_kept_whole(spark, tmp_path):
    (tmp_path / "run.mzML").write_text(PIECES + "</run></mzML></indexedmzML>")
    convert.convert(spark, str(tmp_path / "run.mzML"), str(tmp_path / "a"), check=True)
    r = archive.read_archive(spark, str(tmp_path / "a")).first()
    assert [(p["accession"], p["name"], p["value"], p["type"]) for p in r["params"]] == [("MS:1000130", "positive scan", "", None), ("MS:1000511", "ms level", "2", None), (None, "lab", "x", "xsd:string")]
    assert r["scans"][0]["instrument"] == "IC2" and r["scans"][0]["params"][0]["value"] == "a < b" and r["scans"][0]["windows"][0][0]["unit_name"] == "m/z" and r["combination"][0]["accession"] == "MS:1000795"
    assert [p["ref"] for p in r["precursors"]] == ["p1", "p2"] and r["precursors"][0]["isolation"] is None and r["precursors"][1]["isolation"][0]["value"] == "7.5" and r["products"][0][0]["value"] == "9"


def test_long_headers_fail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xml, "HEADER_LIMIT", 1000)
    (tmp_path / "long.imzML").write_text("<mzML>" + " " * 200_000 + "<spectrumList>")
    with pytest.raises(ValueError, match="no spectra"):
        xml.header_text(spark, str(tmp_path / "long.imzML"))


def test_places_of_mismatches(spark, pixels, tmp_path):
    archive.write_archive(pixels, str(tmp_path / "a"))
    output = archive.read_archive(spark, str(tmp_path / "a"))
    changed = output.withColumn("intensity", F.when(F.col("spectrum_index") == 0, F.transform("intensity", lambda v: (v + 1).cast("float"))).otherwise(F.col("intensity")))
    got = {r["s_index"]: r for r in fidelity.mismatches(pixels, changed, by="index").collect()}
    assert got[0]["mz_first"] is None and got[0]["intensity_first"] == 1  # the first point that masking kept
    lost = output.withColumns({"mz": F.expr("filter(mz, m -> m <> 102)"), "intensity": F.expr("filter(intensity, v -> v <> 5)")})
    assert {r["s_index"]: r["mz_first"] for r in fidelity.mismatches(pixels, lost, by="index").collect()}[0] == 2


@pytest.mark.parametrize("indexed", [True, False])
def test_few_spectra_read_few_bytes(spark, tmp_path, indexed):
    head, tail, offsets = "<indexedmzML><mzML><run><spectrumList>", "</spectrumList></run></mzML>", []
    text = head
    for k in range(1000):
        offsets.append(len(text))
        text += f'<spectrum index="{k}" id="s{k}" defaultArrayLength="0"><cvParam accession="MS:1000511" name="ms level" value="{k % 3}"/>{" " * 500}</spectrum>\n'
    text += tail
    if indexed:
        listed = "".join(f'<offset idRef="s{k}">{o}</offset>' for k, o in enumerate(offsets))
        text += f'<indexList count="1"><index name="spectrum">{listed}</index></indexList><indexListOffset>{len(text)}</indexListOffset></indexedmzML>'
    path = tmp_path / "run.mzML"
    path.write_text(text)
    ranges = xml.spectrum_ranges(spark, str(path), 300, 309)
    if indexed:
        r = ranges.collect()
        assert sum(x["stop"] - x["start"] for x in r) < 0.015 * len(text)
        assert sorted(x["spectrum_index"] for x in xml.read_mzml(spark, str(path), between=(995, 2000)).collect()) == [995, 996, 997, 998, 999]
    else:
        assert ranges is None
    got = xml.read_mzml(spark, str(path), between=(300, 309)).collect()
    assert sorted((x["spectrum_index"], x["ms_level"]) for x in got) == [(k, k % 3 or 1) for k in range(300, 310)]
