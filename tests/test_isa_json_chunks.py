"""ISA-JSON documents that many tasks read, in chunks that begin anywhere."""

import json
import random

import pytest

from peakloom.sources import samples

ODD = ['a}b', '{[,:"', "\\", '\\"}', "é}{", "", "] , [", "\\\\", "x" * 50]


def document(seed: int) -> dict:
    rng = random.Random(seed)
    odd = lambda: rng.choice(ODD)
    sources = [{"@id": f"#source/{k}", "name": odd(), "characteristics": [{"category": {"@id": "#c}/1"}, "value": {"annotationValue": odd(), "termAccession": "EFO:1"}}]} for k in range(20)]
    own = [{"comments": {odd(): [odd()]}, "@id": f"#sample}}/{k}", "name": odd() + str(k), "derivesFrom": [{"@id": f"#source/{k}"}], "characteristics": [{"category": {"@id": "x/y"}, "value": k / 2, "unit": {"@id": "#u"}}], "factorValues": [{"category": {"@id": "#f"}, "value": odd()}]} for k in range(20)]
    study = {"materials": {"samples": own, odd(): {}, "sources": sources}, "title": 'T}"', "characteristicCategories": [{"@id": "#c}/1", "characteristicType": {"annotationValue": "na}me"}}], "factors": [], "unitCategories": [{"@id": "#u", "annotationValue": "eu{ro", "termAccession": "UO:7"}]}
    study["assays"] = [{"filename": odd(), "dataFiles": [{"@id": f"#d{a}{k}", "name": f"r}}{k}"} for k in range(3)], "processSequence": [{"@id": "#p", "inputs": [{"@id": f"#sample}}/{k}"}], "outputs": [{"@id": f"#d{a}{k}"}]} for k in range(3)]} for a in range(2)]
    items = list(study.items())
    rng.shuffle(items)
    return {"comments": [{odd(): odd()}], "studies": [dict(items), {"title": "other", "materials": {"samples": own}}], "title": None, "identifier": 'I}"1'}


@pytest.mark.parametrize(("seed", "size", "how", "encoding"), [(1, 1, {}, "utf-8"), (2, 40, {"indent": 1}, "utf-8"), (3, 300, {"ensure_ascii": False}, "utf-8"), (4, 40, {"ensure_ascii": False}, "utf-16")])
def test_values_of_chunks(spark, tmp_path, monkeypatch, seed, size, how, encoding):
    monkeypatch.setattr(samples, "CHUNK", size)
    doc = document(seed)
    (tmp_path / "i.json").write_text(json.dumps(doc, **how), encoding=encoding)
    found = samples.read_isa_json(spark, f"{tmp_path}/i.json")
    got = {(r["kind"], r["assay"], r["place"]): json.loads(r["text"]) for r in found.collect()}
    first = doc["studies"][0]
    want = {("identifier", 0, 0): doc["identifier"], ("title", 0, 0): None, ("study.title", 0, 0): first["title"]}
    lists = [(c, 0, first[c]) for c in ("characteristicCategories", "factors", "unitCategories")] + [(c, 0, first["materials"][c]) for c in ("samples", "sources")]
    lists += [(c, a, x[c]) for a, x in enumerate(first["assays"]) for c in ("dataFiles", "processSequence")]
    assert got == want | {(kind, a, k): v for kind, a, values in lists for k, v in enumerate(values)}
    assert samples.isa_json_identity(found).first().asDict() == {"accession": 'I}"1', "title": 'T}"'}
    traits = {(r["place"], r["pos"]): (r["sample"], r["category"], r["value"]["value"]) for r in samples.isa_json_traits(found).collect()}
    assert len(traits) == 60 and all(traits[k, 1] == (own["name"], "y", str(k / 2)) for k, own in enumerate(first["materials"]["samples"]))
    assert all(traits[k, 0][1:] == ("na}me", s["characteristics"][0]["value"]["annotationValue"]) for k, s in enumerate(first["materials"]["sources"]))


def test_document_is_read_by_many_tasks(spark, tmp_path):
    doc = {"studies": [{"materials": {"samples": [{"@id": f"#{k}", "name": f"n{k}"} for k in range(60_000)]}}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = samples.read_isa_json(spark, f"{tmp_path}/i.json")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found.count() == 60_000 and found.select("text").distinct().count() == 60_000
    assert len(found.inputFiles()) > 4


@pytest.mark.parametrize("text", ["", "{", '{"studies": [{"materials": {"samples": [{"@id": "a"}', '{"title": "x}'])
def test_document_that_does_not_end(spark, tmp_path, text):
    (tmp_path / "i.json").write_text(text)
    with pytest.raises(ValueError, match="MALFORMED"):
        samples.read_isa_json(spark, f"{tmp_path}/i.json")
