"""Readers, writers and operators on small hand-made inputs."""

import base64
import hashlib
import json
import math
import struct
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.functions import cells
from peakloom.functions.numpress import decode_linear, encode_linear
from peakloom.operators import folds, lookup, signal, verify
from peakloom.plans import convert, export
from peakloom.sources import archive, images, samples, terms, xml
from peakloom.streaming import ingest


def term(accession, value="", unit=None):
    return f'<cvParam cvRef="MS" accession="{accession}" name="n" value="{value}"' + (f' unitAccession="{unit}"' if unit else "") + "/>"


@pytest.fixture
def imaging(tmp_path):
    """A 3 by 3 processed image with 3 to 11 points a pixel."""
    key = uuid.UUID(int=7)
    data, body, want = key.bytes, "", {}
    for k in range(9):
        mz, intensity = 100 + 0.5 * np.arange(3 + k), (np.arange(3 + k) + 1).astype("<f4")
        want[(k % 3 + 1, k // 3 + 1)] = (mz.tolist(), intensity.tolist())
        arrays = ""
        for accession, width, values in ((terms.MZ_ARRAY, terms.FLOAT_64, mz.astype("<f8")), (terms.INTENSITY_ARRAY, terms.FLOAT_32, intensity)):
            raw = values.tobytes()
            arrays += f"<binaryDataArray>{term(accession)}{term(width)}{term(terms.EXTERNAL_OFFSET, len(data))}{term(terms.EXTERNAL_LENGTH, len(values))}{term(terms.EXTERNAL_BYTES, len(raw))}<binary/></binaryDataArray>"
            data += raw
        place = term(terms.POSITION_X, k % 3 + 1) + term(terms.POSITION_Y, k // 3 + 1)
        body += f'<spectrum index="{k}" id="s={k}">{term(terms.CENTROID)}<scanList><scan>{place}</scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>\n'
    head = f"<fileDescription><fileContent>{term(terms.IBD_UUID, '{' + str(key) + '}')}{term(terms.IBD_SHA1, hashlib.sha1(data).hexdigest())}{term(terms.PROCESSED)}</fileContent></fileDescription>"
    grid = f'<scanSettingsList><scanSettings id="g">{term(terms.GRID_X, 3)}{term(terms.GRID_Y, 3)}{term(terms.PIXEL_X, "100")}{term(terms.PIXEL_Y, "bad")}</scanSettings></scanSettingsList>'
    path = tmp_path / "run.imzML"
    path.write_text(f'<?xml version="1.0" encoding="ISO-8859-1"?>\n<mzML>{head}{grid}<run><spectrumList>{body}</spectrumList></run></mzML>', encoding="latin-1")
    (tmp_path / "run.ibd").write_bytes(data)
    return str(path), str(tmp_path / "run.ibd"), want


def test_imaging_round_trip(spark, imaging, tmp_path):
    path, ibd, want = imaging
    encoding = xml.sniff_encoding(open(path, "rb").read(512))
    assert encoding == "ISO-8859-1"
    got = {(r["x"], r["y"]): (r["mz"], r["intensity"]) for r in xml.read_imzml(spark, path, ibd, encoding).collect()}
    assert got == want
    target = str(tmp_path / "archive")
    index = convert.convert_imaging(spark, path, ibd, target, encoding)
    assert index["spectra"] == 9 and index["metadata"]["imaging"]["grid_x"] == 3 and index["metadata"]["imaging"]["pixel_y"] is None
    out = export_again(spark, target, str(tmp_path / "again"))
    assert {(r["x"], r["y"]): (r["mz"], r["intensity"]) for r in out.collect()} == want
    proof = convert.fidelity(xml.read_imzml(spark, path, ibd, encoding), archive.read_archive(spark, target)).first()
    assert proof["equal"] and proof["n_source"] == 9


def export_again(spark, source, target):
    info = convert.export_imaging(spark, source, target)
    assert hashlib.sha1(open(f"{target}.ibd", "rb").read()).hexdigest() == info["sha1"]
    assert xml.preflight(spark, f"{target}.imzML", f"{target}.ibd").first()["ok"]
    return xml.read_imzml(spark, f"{target}.imzML", f"{target}.ibd")


def test_integrity_gate(spark, imaging, tmp_path):
    path, ibd, _ = imaging
    data = open(ibd, "rb").read()
    open(ibd, "wb").write(data[:-1] + b"\x01")
    with pytest.raises(convert.ConversionError) as e:
        convert.convert_imaging(spark, path, ibd, str(tmp_path / "a"), "ISO-8859-1")
    assert e.value.code == 2
    assert xml.preflight(spark, path, ibd, "ISO-8859-1", allow_mismatch=True).first()["ok"]


def test_mzml(spark, tmp_path):
    mz, intensity = np.array([3.0, 1.0, 2.0]), np.array([30.0, 10.0, 20.0])
    code = lambda a: base64.b64encode(zlib.compress(a.astype("<f8").tobytes())).decode()
    arrays = "".join(f'<binaryDataArray><referenceableParamGroupRef ref="z"/>{term(a)}{term(terms.FLOAT_64)}<binary>{code(v)}</binary></binaryDataArray>' for a, v in ((terms.MZ_ARRAY, mz), (terms.INTENSITY_ARRAY, intensity)))
    times = f"<binaryDataArray>{term(terms.TIME_ARRAY)}{term(terms.FLOAT_64)}<binary>{base64.b64encode(mz.tobytes()).decode()}</binary></binaryDataArray>"
    precursor = f'<precursorList><precursor spectrumRef="s=0"><isolationWindow>{term(terms.ISOLATION_TARGET, "445.3")}</isolationWindow><selectedIonList><selectedIon>{term(terms.SELECTED_MZ, "445.34")}{term(terms.CHARGE, 2)}</selectedIon></selectedIonList></precursor></precursorList>'
    text = f"""<mzML><referenceableParamGroupList><referenceableParamGroup id="z">{term(terms.ZLIB)}</referenceableParamGroup></referenceableParamGroupList><run><spectrumList>
    <spectrum index="0" id="s=0">{term(terms.MS_LEVEL, 1)}{term(terms.PROFILE)}<scanList><scan>{term(terms.SCAN_START, "5.5", terms.MINUTE)}</scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>
    <spectrum index="1" id="s=1">{term(terms.MS_LEVEL, 2)}<scanList><scan>{term(terms.SCAN_START, "42", terms.SECOND)}</scan></scanList>{precursor}</spectrum>
    </spectrumList><chromatogramList><chromatogram index="0" id="tic"><binaryDataArrayList>{times}</binaryDataArrayList></chromatogram></chromatogramList></run></mzML>"""
    path = tmp_path / "run.mzML"
    path.write_text(text)
    a, b = xml.read_mzml(spark, str(path)).orderBy("spectrum_index").collect()
    assert a["mz"] == mz.tolist() and a["rt_seconds"] == 330 and a["representation"] == "profile"
    assert b["mz"] is None and b["ms_level"] == 2 and b["rt_seconds"] == 42 and b["precursor"]["charge"] == 2
    assert xml.read_chromatograms(spark, str(path)).first()["time"] == mz.tolist()
    (tmp_path / "s.sdrf.tsv").write_text("source name\tcomment[data file]\nA\tFILES/run.raw\n")
    index = convert.convert_run(spark, str(path), str(tmp_path / "archive"), str(tmp_path / "s.sdrf.tsv"))
    assert index["resorted"] == 1 and index["metadata"]["sample_ids"] == ["sample-1"]
    back = archive.read_archive(spark, str(tmp_path / "archive")).orderBy("spectrum_index").collect()
    assert back[0]["mz"] == [1.0, 2.0, 3.0] and back[0]["intensity"] == [10.0, 20.0, 30.0]


@pytest.mark.parametrize("encoding", ["plain", "delta", "numpress"])
def test_archive_encodings(spark, tmp_path, encoding):
    rows = [(0, "profile", [1.0, 2.5, 3.0, 4.0], [0.0, 0.0, 5.0, 0.0]), (1, "centroid", [], []), (2, "unknown", [7.0, 7.0], [0.0, 1.5])]
    df = spark.createDataFrame(rows, "spectrum_index long, representation string, mz array<double>, intensity array<double>")
    archive.write_archive(df, str(tmp_path / "a"), mz_encoding=encoding)
    got = {r["spectrum_index"]: r for r in archive.read_archive(spark, str(tmp_path / "a")).collect()}
    assert got[0]["mz"] == pytest.approx([2.5, 3.0, 4.0], rel=1e-7) and got[0]["intensity"] == [0.0, 5.0, 0.0]
    assert got[1]["mz"] == [] and got[2]["mz"] == pytest.approx([7.0, 7.0], rel=1e-7)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(50, 4000), max_size=60))
def test_numpress_bound(values):
    a = np.sort(np.array(values, float))
    assert np.allclose(decode_linear(encode_linear(a)), a, rtol=1e-6, atol=0)


def test_masking_keeps_the_sum(spark):
    rows = [([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [0.0, 0.0, 3.0, 0.0, 0.0, 0.0]), ([1.0, 2.0], [0.0, 0.0]), ([], [])]
    df = spark.createDataFrame(rows, "mz array<double>, i array<double>").select(signal.mask_zero_runs(F.col("mz"), F.col("i")).alias("p"), signal.tic(F.col("i")).alias("t"))
    got = df.collect()
    assert [p["mz"] for p in got[0]["p"]] == [2, 3, 4] and got[1]["p"] == [] and got[2]["t"] == 0


def test_order_checks(spark):
    rows = [([1.0, 2.0],), ([2.0, 2.0],), ([2.0, 1.0],), ([],), ([1.0, float("nan")],)]
    df = spark.createDataFrame(rows, "a array<double>")
    got = df.select(signal.is_ascending(F.col("a")), signal.first_descent(F.col("a")), signal.first_non_finite(F.col("a"))).collect()
    assert [r[0] for r in got[:4]] == [True, True, False, True]
    assert [r[1] for r in got[:4]] == [None, 1, 1, None]
    assert got[4][2] == 1 and got[0][2] is None


def test_points_round_trip(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0], [5.0, 6.0])], "k int, mz array<double>, intensity array<double>")
    points = signal.explode_points(df)
    assert points.count() == 2 and signal.collect_points(points, ["k"]).first()["mz"] == [3.0, 1.0]
    deltas = df.select(signal.delta_decode(signal.delta_encode(F.col("mz"))).alias("d")).first()["d"]
    assert deltas == [3.0, 1.0]


def test_nearest_value(spark):
    df = spark.createDataFrame([([99.995, 100.005, 101.0], [1.0, 2.0, 3.0])], "m array<double>, v array<double>")
    near = lambda t: lookup.nearest_value(F.col("m"), F.col("v"), F.lit(t))
    assert tuple(df.select(near(100.006), near(101.02), near(99.99)).first()) == (2.0, 0.0, 1.0)


def test_tolerances(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 5e-8), (0.0, 0.0), (0.0, 1e-12), (float("nan"), float("nan")), (None, 1.0)], "a double, b double")
    got = df.select(verify.differs(F.col("a"), F.col("b"), 0.0), verify.differs(F.col("a"), F.col("b"), 1e-7)).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (True, True), (True, True), (True, True)]


def test_merge_tolerant(spark):
    schema = "k int, mz array<double>, intensity array<double>"
    s = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [5.0, 0.0, 7.0]), (2, [1.0], [1.0])], schema)
    o = spark.createDataFrame([(1, [1.0 + 1e-9, 3.0], [5.0, 7.1]), (2, [2.0], [1.0])], schema)
    got = {r["k"]: r for r in verify.merge_tolerant(s, o, "k").collect()}
    assert (got[1]["kept"], got[1]["dropped"], got[1]["dropped_nonzero"], got[1]["changed"]) == (2, 1, 0, 1)
    assert (got[2]["dropped_nonzero"], got[2]["added"]) == (1, 1)


def test_sample_table(spark, tmp_path):
    path = tmp_path / "x.sdrf.tsv"
    path.write_text('source name\tcharacteristics[organism]\tcomment[data file]\tcomment[label]\tfactor value[time]\nS1\tNT=Homo "x";AC=NCBITaxon:9606\tF\\run.raw\tTMT126\t1h\nS2\tnot available\ta/run.raw\tTMT131C\t\nS1\tother\tb.raw\n')
    table = samples.read_table(spark, str(path))
    assert table.count() == 15
    first, second = samples.samples(table).orderBy("sample_id").collect()
    assert first["name"] == "S1" and first["characteristics"][0]["cell"]["value"] == 'Homo "x"' and first["characteristics"][0]["cell"]["accession"] == "NCBITaxon:9606"
    assert second["characteristics"][0]["cell"]["is_na"]
    assert [(r["factor"], r["sample"], r["value"]) for r in samples.factors(table).collect()] == [("time", "S1", "1h")]
    runs = spark.createDataFrame([("/d/run.mzML",), ("/d/none.mzML",)], "path string")
    bound = {r["path"]: r for r in samples.bind_runs(runs, table).collect()}
    assert bound["/d/run.mzML"]["sample_ids"] == ["sample-1", "sample-2"] and bound["/d/none.mzML"]["diagnostic"] == "no row"
    targets = {r["label"]: r["target"] for r in samples.channels(spark, samples.assays(table).filter("label <> ''")).collect()}
    assert targets["TMT126"] == 126.127726


def test_isa(spark, tmp_path):
    (tmp_path / "i.txt").write_text('INVESTIGATION\nInvestigation Identifier\t"I1"\nSTUDY\nStudy Title\t\t"A study"\n')
    blocks = samples.isa_blocks(spark, str(tmp_path / "i.txt"))
    assert samples.isa_value(blocks, "STUDY", "Study Title").first()["value"] == "A study"
    doc = {"identifier": "I1", "studies": [{"materials": {"sources": [{"@id": "#src", "name": "S"}], "samples": [{"@id": "#smp", "name": "P"}]}, "assays": [{"filename": "a", "dataFiles": [{"@id": "#f", "name": "x.raw"}], "processSequence": [{"@id": "#p", "inputs": [{"@id": "#smp"}, {"@id": "#gone"}], "outputs": [{"@id": "#f"}]}]}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    got = {(r["file"], r["sample"], r["diagnostic"]) for r in samples.isa_files(samples.read_isa_json(spark, str(tmp_path / "i.json"))).collect()}
    assert got == {("x.raw", "P", None), ("x.raw", "#gone", "unresolved")}
    header = spark.createDataFrame([(["Characteristics[a]", "Term Source REF", "Term Accession Number", "Unit"],)], "h array<string>")
    pairs = header.select(samples.paired_columns(F.col("h")).alias("p")).first()["p"]
    assert [(p["pos"], p["ref_pos"], p["accession_pos"]) for p in pairs] == [(0, 1, 2), (3, None, None)]


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 2, 3)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 4, 0) + struct.pack("<HHII", 257, 4, 1, 3)
    jpeg = b"\xff\xd8\xff\xc4\x00\x04ab\xff\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 5, 6) + b"\x01\x01\x11\x00"
    assert images.header(png) == ("image/png", 2, 3) and images.header(tiff) == ("image/tiff", 4, 3) and images.header(jpeg) == ("image/jpeg", 6, 5)
    assert images.header(b"\xff\xd8\xff\xc0\x00\x05\x08\0\0") == (None, None, None) and images.header(b"what") == (None, None, None)
    (tmp_path / "a.png").write_bytes(png)
    assert images.read_images(spark, str(tmp_path / "a.png")).first()["width"] == 2


def test_cells(spark):
    df = spark.createDataFrame([("MS:1:2", "{ABCDEF01-2345-6789-abcd-ef0123456789}", 3 << 20)], "c string, u string, n long")
    r = df.select(cells.curie(F.col("c")).alias("c"), cells.normal_uuid(F.col("u")).alias("u"), cells.human_size(F.col("n")).alias("h")).first()
    assert r["c"]["accession"] == "1:2" and r["u"] == "abcdef0123456789abcdef0123456789" and r["h"] == "3.0 MB"
    cells.register(spark)
    assert spark.sql("SELECT tic(array(1D, 2D)) AS t, file_stem('a/b.c.raw') AS s").first().asDict() == {"t": 3.0, "s": "b.c"}
    r = spark.sql("SELECT zero_run_mask(array(1D, 2D, 3D, 4D), array(0D, 0D, 5D, 0D)) AS m, nearest_intensity(array(1D, 2D), array(7D, 8D), 1.9D, 0.2D) AS v, numpress_decode(numpress_encode(array(100D, 101.5D, 103D))) AS d, curie_accession('MS:1:2') AS c").first()
    assert [p["mz"] for p in r["m"]] == [2, 3, 4] and r["v"] == 8 and r["d"] == pytest.approx([100, 101.5, 103]) and r["c"] == "1:2"


def test_gap_sample_and_levels(spark):
    sizes = spark.createDataFrame([(float(v),) for v in (10, 12, 13.2, 20, 100)], "v double")
    assert sorted(r["value"] for r in folds.gap_sample(sizes, "v").collect()) == [10.0, 13.2, 20.0, 100.0]
    levels = spark.createDataFrame([(0,), (None,), (2,)], "l int").select(folds.ms_level_or_ms1(F.col("l")).alias("l")).collect()
    assert [r["l"] for r in levels] == [1, 1, 2]


def test_offsets(spark):
    rows = spark.createDataFrame([(k, k // 2, 10 + k) for k in range(6)], "id int, part int, size long")
    a = {r["id"]: r["offset"] for r in lookup.offsets_in_parts(rows, "part", ["id"], "size", 16).collect()}
    b = {r["id"]: r["offset"] for r in lookup.running_offsets(rows, ["id"], "size", 16).collect()}
    assert a == b and a[0] == 16 and a[5] == 16 + 10 + 11 + 12 + 13 + 14


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, math.nan)], "k int, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.once(ingest.arriving(spark, str(tmp_path / "in"), rows.schema), ["k"])
    ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2
    fold = {r["k"]: r for r in ingest.running_fold(out, ["k"], "v", "v").collect()}
    assert fold[2]["mz_lo"] is None and fold[1]["tic"] == 5.0
