"""Sample metadata projected onto runs: sample lists with isobaric channels, factor values, study blocks, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import cells as cell_functions
from peakloom.operators import lookup
from peakloom.sources import samples

SAMPLE_LABEL, LOCAL = "MS:1002602", "peakloom"
# Identifier, official name, address and version of the vocabularies that parameters may refer to.
VOCABULARIES = (
    ("MS", "Proteomics Standards Initiative Mass Spectrometry Ontology", "http://purl.obolibrary.org/obo/ms/4.1.248/ms.obo", "4.1.248"),
    ("UO", "Units of measurement ontology", "http://purl.obolibrary.org/obo/uo/releases/2026-01-16/uo.obo", "2026-01-16"),
    ("IMS", "Imaging Mass Spectrometry Ontology", "https://raw.githubusercontent.com/imzML/imzML/master/imagingMS.obo", "1.1.0"),
    ("UNIMOD", "UNIMOD protein modification database", "http://www.unimod.org/obo/unimod.obo", "2024.01"),
    ("EFO", "Experimental Factor Ontology", "http://www.ebi.ac.uk/efo/efo.obo", None),
    ("OBI", "Ontology for Biomedical Investigations", "http://purl.obolibrary.org/obo/obi.obo", None),
    ("BFO", "Basic Formal Ontology", "http://purl.obolibrary.org/obo/bfo.obo", None),
    ("NCIT", "NCI Thesaurus OBO Edition", "http://purl.obolibrary.org/obo/ncit.obo", None),
    ("BTO", "BRENDA Tissue Ontology", "http://purl.obolibrary.org/obo/bto.obo", None),
    ("PRIDE", "PRIDE Controlled Vocabulary", "http://purl.obolibrary.org/obo/pride_cv.obo", None),
    ("HANCESTRO", "Human Ancestry Ontology", "http://purl.obolibrary.org/obo/hancestro.obo", None),
    (LOCAL, "terms of this library that no vocabulary has", "urn:peakloom:terms", "0.2"),
)
#: Vocabularies that every archive refers to.
ALWAYS = ("MS", "UO")


def channel_params(label: Column, target: Column, role: Column, tag: Column) -> Column:
    """Array of (cv_ref, accession, name, value): label, reporter ion (left out if unknown), role, tag modification."""

    def param(cv: Column, accession: Column, name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(cv.alias("cv_ref"), accession.alias("accession"), F.lit(name).alias("name"), value.alias("value")))

    own = lambda name: F.lit(f"{LOCAL}:{name}")
    return F.array_compact(F.array(
        param(F.lit("MS"), F.lit(SAMPLE_LABEL), "sample label", label),
        param(F.lit(LOCAL), own("reporter_ion_mz"), "reporter ion m/z", F.when(target.isNotNull(), F.format_string("%.6f", target))),
        param(F.lit(LOCAL), own("channel_role"), "channel role", role),
        param(F.lit("UNIMOD"), tag["accession"], "tag modification", tag["value"]),
    ))


def distinct_values(cells: DataFrame, header: str, name: str) -> DataFrame:
    """(name, True) of the distinct non-empty trimmed values of a column."""
    return samples.column(cells, header).filter("value <> ''").select(F.col("value").alias(name)).distinct()


def sample_list(cells: DataFrame, bound: DataFrame, run: str = "path", pooled: bool = False) -> DataFrame:
    """(run, place, sample_id, name, label, target, parameters) of the samples bound to each run, in their order.

    The label is that of the sample's first assay of the whole table. Samples that aren't isobaric have no parameters.
    pooled: whether a source name with "pool" in it makes a pooled channel. Runs without samples give no rows.
    """
    first = samples.assays(cells).groupBy("sample").agg(F.min_by(F.struct("row_idx", F.trim("label").alias("label")), "row_idx").alias("a")).select(F.col("sample").alias("name"), "a.row_idx", "a.label")
    modified = cells.filter(F.contains(F.lower("header"), F.lit("modification parameters"))).select("row_idx", "pos", cell_functions.cell(F.col("raw")).alias("c"))
    modified = modified.filter(F.upper("c.accession").startswith("UNIMOD:"))
    tags = modified.groupBy("row_idx").agg(F.min_by(F.struct(F.upper("c.accession").alias("accession"), F.col("c.value").alias("value")), "pos").alias("tag"))
    carriers, references = (distinct_values(cells, f"comment[{kind} channel]", f"__{kind}") for kind in ("carrier", "reference"))
    ids = bound.select(run, F.posexplode("sample_ids").alias("place", "sample_id")).join(samples.samples(cells).select("sample_id", "name"), "sample_id")
    rows = ids.join(first, "name", "left").join(tags, "row_idx", "left")
    rows = rows.join(carriers, F.col("label") == F.col("__carrier"), "left").join(references, F.col("label") == F.col("__reference"), "left")
    rows = samples.channels(cells.sparkSession, rows)
    is_pooled = F.contains(F.lower("name"), F.lit("pool")) if pooled else F.lit(False)
    role = cell_functions.channel_role(F.col("__carrier").isNotNull(), F.col("__reference").isNotNull(), is_pooled)
    params = channel_params(F.col("label"), F.col("target"), role, F.col("tag"))
    isobaric = F.coalesce(cell_functions.is_isobaric(F.col("label")), F.lit(False))
    return rows.select(run, "place", "sample_id", "name", "label", "target", F.when(isobaric, params).otherwise(F.filter(params, lambda p: F.lit(False))).alias("parameters"))


def reporter_channels(listed: DataFrame) -> DataFrame:
    """(run..., channel, target) of listed samples whose reporter ion is known."""
    return listed.filter(F.col("target").isNotNull() & (F.size("parameters") > 0)).withColumn("channel", F.col("sample_id"))


def factor_values(runs: DataFrame, cells: DataFrame, run: str = "path") -> DataFrame:
    """(run, factor_name, levels array<struct<sample, value>>): distinct levels of each factor in the run's rows, in their order.

    Empty cells and rows without a source name don't count; factors without levels are left out.
    """
    matched = samples.match_rows(runs, cells, run)
    values = cells.filter(F.lower("header").startswith("factor value[") & F.col("header").endswith("]"))
    values = values.select("row_idx", "pos", F.trim(F.regexp_extract("header", r"\[(.*)\]$", 1)).alias("factor_name"), F.col("raw").alias("value")).filter("value <> '' and factor_name <> ''")
    named = samples.column(cells, "source name").select("row_idx", F.col("value").alias("sample")).filter("sample <> ''")
    levels = matched.join(values, "row_idx").join(named, "row_idx").groupBy(run, "pos", "factor_name", "sample", "value").agg(F.min("row_idx").alias("first_row"))
    nested = levels.groupBy(run, "pos", "factor_name").agg(F.array_sort(F.collect_list(F.struct("first_row", "sample", "value"))).alias("s"))
    return nested.select(run, "factor_name", F.transform("s", lambda v: F.struct(v["sample"].alias("sample"), v["value"].alias("value"))).alias("levels"))


def dataset_accession(cells: DataFrame, sample_file: str) -> DataFrame:
    """One row (accession): first given ProteomeXchange accession, else the table's name up to its last two extensions
    if that begins as a repository's accessions do, else its name up to the last one."""
    given = F.lower("header") == "characteristics[proteomexchange accession number]"
    px = cells.filter(given).select("row_idx", "pos", F.trim("raw").alias("v")).filter(F.col("v") != "").filter(~cell_functions.is_na(F.col("v")))
    name = lookup.stem(F.lit(sample_file))
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    named = F.when(bare.rlike("^(PXD|MTBLS|MSV)"), bare).otherwise(name)
    return px.agg(F.min_by("v", F.struct("row_idx", "pos")).alias("px")).select(F.coalesce("px", named).alias("accession"))


def study_block(accession: str, title: str, reference: str, run: str, sample_ids: list[str] | None) -> dict:
    """The study part of an archive's metadata; a run without samples has no binding."""
    block = {"dataset_accession": accession, "title": title, "sample_metadata_ref": reference}
    if sample_ids:
        block["run_sample_binding"] = {"run_id": run, "sample_ids": list(sample_ids), "binding_provenance": "sample table"}
    return block


def known_vocabularies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCABULARIES, "id string, full_name string, uri string, version string")


def vocabularies(spark: SparkSession, listed: DataFrame, params: str = "parameters") -> DataFrame:
    """(id, full_name, uri, version) of the vocabularies that parameters refer to by themselves or by their unit, and of those
    that are always; all but the id is null for an unknown one."""
    fields = {f.name for f in listed.schema[params].dataType.elementType.fields}
    refs = None
    for c in ("cv_ref", "unit_cv_ref"):
        if c in fields:
            own = listed.select(F.explode(params).alias("p")).select(F.col(f"p.{c}").alias("id"))
            refs = own if refs is None else refs.union(own)
    return vocabulary_set(refs.filter("id <> ''"))


def vocabulary_set(refs: DataFrame, always: tuple[str, ...] = ALWAYS) -> DataFrame:
    """The same for a table of identifiers (id)."""
    spark = refs.sparkSession
    ids = refs.select("id").union(spark.createDataFrame([(v,) for v in always], "id string")).distinct()
    return ids.join(F.broadcast(known_vocabularies(spark)), "id", "left")
