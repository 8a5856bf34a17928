"""Sample metadata on runs, optical images, archive members, dry runs."""

import base64
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.functions import cells
from peakloom.plans import convert, study
from peakloom.sources import archive, images, optical, samples, terms, xml
from tests.test_domain import imaging, term  # noqa: F401

TABLE = """source name\tcharacteristics[organism]\tcomment[data file]\tcomment[label]\tcomment[modification parameters]\tcomment[carrier channel]\tfactor value[disease]
A\tx\trun.raw\tTMT126\tNT=TMT6plex;PP=N;AC=UNIMOD:737\tTMT127C\ttumor
B\tx\tF/run.raw\t TMT127C\tNT=Oxidation;AC=unimod:35\t\tnone
C\tx\trun.raw\tTMT132N\t\t\ttumor
D\tx\tother.raw\tlabel free sample\t\t\tx
"""


@pytest.fixture
def sdrf(tmp_path):
    path = tmp_path / "PXD000001.sdrf.tsv"
    path.write_text(TABLE)
    return str(path)


def test_sample_list(spark, sdrf):
    table = samples.read_table(spark, sdrf)
    runs = spark.createDataFrame([("/d/run.mzML",), ("/d/other.mzML",), ("/d/none.mzML",)], "path string")
    bound = samples.bind_runs(runs, table)
    listed = {(r["path"], r["name"]): r for r in study.sample_list(table, bound).collect()}
    assert {k[1] for k in listed if k[0] == "/d/run.mzML"} == {"A", "B", "C"} and not any(k[0] == "/d/none.mzML" for k in listed)
    a, b, c = (listed["/d/run.mzML", n] for n in "ABC")
    assert [p["value"] for p in a["parameters"]] == ["TMT126", "126.127726", "sample", "TMT6plex"]
    assert [p["value"] for p in b["parameters"]] == ["TMT127C", "127.131081", "carrier", "Oxidation"] and b["parameters"][3]["accession"] == "UNIMOD:35"
    assert [p["value"] for p in c["parameters"]] == ["TMT132N", "sample"] and c["target"] is None
    assert listed["/d/other.mzML", "D"]["parameters"] == []
    assert [r["id"] for r in study.vocabularies(spark, study.sample_list(table, bound)).orderBy("id").collect()] == ["MS", "UNIMOD", "UO", "peakloom"]
    levels = {r["path"]: r["levels"] for r in study.factor_values(runs, table).collect()}
    assert [tuple(v) for v in levels["/d/run.mzML"]] == [("A", "tumor"), ("B", "none"), ("C", "tumor")]
    assert study.dataset_accession(table, sdrf).first()["accession"] == "PXD000001"
    assert [study.dataset_accession(table, f).first()["accession"] for f in ("/d/MSV1-x.sdrf.tsv", "mine.sdrf.tsv")] == ["MSV1-x", "mine.sdrf"]
    given = spark.createDataFrame([(0, 0, "Characteristics[ProteomeXchange accession number]", "not available"), (1, 0, "Characteristics[ProteomeXchange accession number]", " PXD9 ")], table.schema)
    assert study.dataset_accession(given, sdrf).first()["accession"] == "PXD9"
    assert "run_sample_binding" not in study.study_block("a", "a", "m", "r", [])


@pytest.mark.parametrize(
    "text, want",
    [
        (" plain ", (" plain ", None, False, None)), ("Anonymized", ("Anonymized", None, True, None)),
        ("NT=a;AC=MS:1;MT=x=y;NT=b", ("b", "MS:1", False, [("MT", "x=y")])), ("first;second;K=v", ("first", None, False, [("_bare", "second"), ("K", "v")])),
        ("AC=free text;NT=n", ("n", None, False, [("AC", "free text")])), ("UO=UO:1;UNIT=bad;nt=q", ("", None, False, [("UNIT", "bad"), ("nt", "q")])),
    ],
)
def test_cell_grammar(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(cells.cell(F.col("t")).alias("c")).first()["c"]
    assert (r["value"], r["accession"], r["is_na"], r["extra"] and [tuple(e) for e in r["extra"]]) == want


def test_reporters_and_members(spark, sdrf, tmp_path):
    mz, values = np.array([126.1277, 126.12773, 127.2]), np.array([5.0, 9.0, 1.0])
    code = lambda a: base64.b64encode(a.astype("<f8").tobytes()).decode()
    arrays = "".join(f"<binaryDataArray>{term(a)}{term(terms.FLOAT_64)}<binary>{code(v)}</binary></binaryDataArray>" for a, v in ((terms.MZ_ARRAY, mz), (terms.INTENSITY_ARRAY, values)))
    spectrum = lambda k, level: f'<spectrum index="{k}" id="s={k}">{term(terms.MS_LEVEL, level)}{term(terms.CENTROID)}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'
    trace = f'<chromatogramList><chromatogram index="0" id="tic"><binaryDataArrayList><binaryDataArray>{term(terms.TIME_ARRAY)}{term(terms.FLOAT_64)}<binary>{code(mz)}</binary></binaryDataArray></binaryDataArrayList></chromatogram></chromatogramList>'
    path = tmp_path / "run.mzML"
    path.write_text(f"<mzML><run><spectrumList>{spectrum(0, 1)}{spectrum(1, 2)}</spectrumList>{trace}</run></mzML>")
    counts = {(r["kind"], r["ms_level"]): r["n"] for r in xml.inspect(spark, str(path)).collect()}
    assert counts == {("spectrum", 1): 1, ("spectrum", 2): 1, ("chromatogram", None): 1}
    target = str(tmp_path / "archive")
    index = convert.convert_run(spark, str(path), target, sdrf, reporters=True, factors=True, preset="compact")
    assert index["metadata"]["transform"]["transform"] == "MS:1002312" and index["metadata"]["study"]["run_sample_binding"]["sample_ids"] == ["sample-1", "sample-2", "sample-3"]
    rows = {r["spectrum_index"]: r["reporters"] for r in archive.read_archive(spark, target).collect()}
    assert rows[0] is None and [tuple(r) for r in rows[1]] == [("sample-1", 9.0), ("sample-2", 0.0)]
    assert archive.extract_member(spark, target, "sdrf.tsv") == TABLE.encode() and archive.read_chromatograms(spark, target).first()["time"] == mz.tolist()
    with pytest.raises(FileNotFoundError):
        archive.extract_member(spark, target, "gone")
    assert {r["path"]: r["reasons"] for r in archive.conformance(spark, [target]).collect()}[target] == []
    assert archive.oversized_row_groups(spark, target, 1).count() > 0 and archive.oversized_row_groups(spark, target).count() == 0


def test_isa_bundle(spark, tmp_path):
    (tmp_path / "i_x.txt").write_text("INVESTIGATION\nInvestigation Identifier\tI1\n")
    (tmp_path / "s_x.txt").write_text('"Source Name"\t"Sample Name"\n"src"\t"P"\n"src"\t"Q"\n')
    (tmp_path / "a_x.txt").write_text('"Sample Name"\t"MS Assay Name"\t"Raw Spectral Data File"\t"Derived Spectral Data File"\n"P"\t""\t"FILES/run.raw"\t"x.mzML"\n"Q"\tq\trun.d\t\n')
    files = samples.locate_isa(str(tmp_path))
    assert files["investigation"].endswith("i_x.txt") and len(files["assays"]) == 1
    rows = samples.isa_assays([samples.read_table(spark, f) for f in files["assays"]])
    assert [(r["assay_id"], r["sample"], r["data_files"]) for r in rows.orderBy("row_idx").collect()] == [("assay-1", "P", ["FILES/run.raw", "x.mzML"]), ("q", "Q", ["run.d"])]
    bound = samples.bind_isa_runs(spark.createDataFrame([("run.mzML",), ("no.mzML",)], "path string"), rows).collect()
    assert {r["path"]: (r["samples"], r["diagnostic"]) for r in bound} == {"run.mzML": (["P", "Q"], "several rows"), "no.mzML": ([], "no row")}
    named = samples.isa_study_samples(samples.read_table(spark, files["studies"][0])).orderBy("sample_id").collect()
    assert [(r["name"], r["source"]) for r in named] == [("P", "src"), ("Q", "src")]
    with pytest.raises(FileNotFoundError):
        samples.locate_isa(str(tmp_path / "none") + "/")


def test_optical_images(spark, imaging, tmp_path):  # noqa: F811
    path, ibd, _ = imaging
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 5, 2)
    (tmp_path / "pic").mkdir()
    (tmp_path / "pic" / "a.PNG").write_bytes(png)
    more = f'<sampleList><sample id="s">{term(optical.STAINING, "early")}{term(optical.LOCATION, "pic/a.PNG")}{term(optical.OF_ANALYSED)}{term(optical.STAINING, "H&amp;E")}{term(optical.MORPHOLOGY, "tumor")}{term(optical.LOCATION, "../up.tif")}{term(optical.LOCATION, "file://host/gone.tif")}</sample></sampleList>'
    text = open(path, encoding="latin-1").read().replace("<run>", more + "<run>")
    open(path, "w", encoding="latin-1").write(text)
    refs = optical.read_optical(spark, path, "ISO-8859-1").orderBy("ordinal").collect()
    assert [(r["location"], r["of_analysed"], r["staining"], r["morphology"]) for r in refs] == [("pic/a.PNG", True, "H&E", "tumor"), ("../up.tif", False, None, None), ("file://host/gone.tif", False, None, None)]
    index = convert.convert_imaging(spark, path, ibd, str(tmp_path / "archive"), "ISO-8859-1", pictures=str(tmp_path / "pic"))
    entries = {e["location"]: e for e in index["metadata"]["imaging"]["images"]}
    assert [entries[k]["status"] for k in ("pic/a.PNG", "../up.tif", "file://host/gone.tif")] == ["ok", "rejected", "missing"]
    one = entries["pic/a.PNG"]
    assert one["archive_path"] == "images/image_0000.png" and one["modality"] == "H&E" and one["subtype"] == "of-analysed-sample: tumor" and one["affine"][0] == 0.5
    assert archive.extract_member(spark, str(tmp_path / "archive"), "images/image_0000.png") == png and one["sha256"] == hashlib.sha256(png).hexdigest()
    assert index["metadata"]["imaging"]["grid"] == {"x": 3, "y": 3, "source": "declared"}
    assert [p["accession"] for p in index["metadata"]["scan_settings"]] == [terms.GRID_X, terms.GRID_Y, terms.PIXEL_X]
    plan = convert.plan_imaging(spark, path, ibd, "ISO-8859-1")
    assert plan["integrity"]["ok"] and plan["spectra"] == {1: 9} and plan["geometry"]["grid_x"] == 3
    json.dumps(index)
    assert images.header(png)[0] == "image/png"


def test_locations(spark):
    rows = [("file:///a/b",), ("file://host/c",), ("file://rel",), ("/x/y",), ("d/e..f",), ("a/../b",)]
    got = spark.createDataFrame(rows, "l string").select(optical.resolve_location(F.col("l"), F.lit("/base")).alias("p")).collect()
    assert [r["p"] for r in got] == ["/a/b", "/c", "/base/rel", "/x/y", "/base/d/e..f", None]
    assert convert.optical_path("file://host/c", "/base") == "/c" and convert.optical_path("file://rel", "/base") == "/base/rel" and convert.optical_path("d/e", "/base") == "/base/d/e"
