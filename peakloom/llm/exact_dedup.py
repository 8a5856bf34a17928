"""Exact dedup on a persistent digest index (DataFrame functions only).

The index is a folder of Parquet files bucketed and sorted by digest; the folder alone says what it holds and how it is
bucketed, so any session goes on with it. New data is reduced to one row per digest by a partial aggregation and
anti-joined to the index by sort-merge (the index side is read bucket by bucket and isn't shuffled). Digests that the
index lacks are appended with the id of the document that stays; of known digests only a count is appended, so group
sizes grow with later batches. Buckets that have gathered many files are merged to one file each. Documents come in
batches from the largest ids down.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peakloom.llm.common import ascii_lower, join_groups, text_of
from peakloom.session import materialize, scratch_path

#: Batches in which documents meet the index, by ranges of their ids.
BATCHES = 2
#: Files a bucket of the index may gather, on average, before its buckets are merged.
MOST_FILES = 8


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text, lower-cased in A-Z only, as 32 bytes. A null text counts as empty."""
    digest = F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256))
    return docs.select(F.col(id_col).alias("id"), digest.alias("digest"))


class DigestIndex:
    """A folder with (digest, keep_id, group_size), bucketed and sorted by digest; sizes of a digest are summed when it is read.

    Under `path` lie generations of the data, `data-N`, and for each a file in `layouts` that is written when the
    generation is whole; the highest one counts. The number of buckets is that of the first append. One writer at a
    time: an append that another one overtakes isn't guarded against.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        jvm = spark.sparkContext._jvm
        self.at = jvm.org.apache.hadoop.fs.Path
        self.store = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def layout(self) -> dict | None:
        """The highest generation's: its number, buckets and columns; None where nothing was ever appended."""
        folder = self.at(f"{self.path}/layouts")
        names = [f.getPath().getName() for f in self.store.listStatus(folder)] if self.store.exists(folder) else []
        whole = [n for n in names if n.endswith(".json") and n[0] not in "._"]
        if not whole:
            return None
        stream = self.store.open(self.at(f"{self.path}/layouts/{max(whole)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, layout: dict) -> None:
        """Write a layout under another name and rename it: it is there whole or not at all."""
        name = f"{layout['generation']:09d}.json"
        stream = self.store.create(self.at(f"{self.path}/layouts/_{name}"), True)
        try:
            stream.write(bytearray(json.dumps(layout).encode()))
        finally:
            stream.close()
        if not self.store.rename(self.at(f"{self.path}/layouts/_{name}"), self.at(f"{self.path}/layouts/{name}")):
            raise OSError(f"{self.path} has a layout {name} already: another writer was at work")

    def exists(self) -> bool:
        return self.layout() is not None

    def table(self, layout: dict) -> str:
        """The generation's folder under a name in this session's catalogue, bucketed as its layout says."""
        place = f"{self.path}/data-{layout['generation']}"
        name = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, place).hex}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromJson(layout["schema"]).fields)
            quoted = place.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {layout['buckets']} BUCKETS LOCATION '{quoted}'")
        return name

    def rows(self) -> DataFrame:
        name = self.table(self.layout())
        self.spark.catalog.refreshTable(name)  # another session may have added files
        return self.spark.table(name)

    def read(self) -> DataFrame:
        """One row per digest. The table is bucketed by it, so nothing is shuffled."""
        return self.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Those of the groups whose digest the index lacks."""
        if not self.exists():
            return groups
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def seen(self, groups: DataFrame) -> DataFrame:
        """Those whose digest it has, as rows that add to the size of a group and leave its document as it is."""
        if not self.exists():
            return groups.limit(0)
        known = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_semi")
        return known.withColumn("keep_id", F.lit(None).cast(groups.schema["keep_id"].dataType))

    def append(self, groups: DataFrame) -> None:
        """Add groups: new digests with their documents, known ones with their counts. What is there stays, whoever wrote it."""
        layout = self.layout()
        if layout is None:
            self.generation(0, groups, self.wanted)
            return
        out = self.unseen(groups).unionByName(self.seen(groups)).select("digest", "keep_id", "group_size")
        kinds = [f.dataType for f in StructType.fromJson(layout["schema"]).fields]
        out = out.select(*[F.col(c).cast(t) for c, t in zip(out.columns, kinds, strict=True)])
        self.written(out, layout["buckets"], self.table(layout))
        if len(self.rows().inputFiles()) > MOST_FILES * layout["buckets"]:
            self.compact()

    def written(self, rows: DataFrame, buckets: int, table: str, **options) -> None:
        dealt = rows.select("digest", "keep_id", "group_size").repartition(buckets, "digest")
        dealt.write.mode("append").format("parquet").options(**options).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)

    def generation(self, number: int, rows: DataFrame, buckets: int) -> None:
        """Write a generation, then the layout by which it counts. What a writer that was lost left of it goes first."""
        place = f"{self.path}/data-{number}"
        self.store.delete(self.at(place), True)
        rows = rows.select("digest", "keep_id", "group_size")
        layout = {"generation": number, "buckets": buckets, "schema": rows.schema.jsonValue()}
        name = f"digests_{uuid.uuid4().hex}"
        try:
            self.written(rows, buckets, name, path=place)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
        self.publish(layout)

    def compact(self) -> None:
        """Merge each bucket to one file with one row per digest, in a new generation; the old one goes when that is whole."""
        layout = self.layout()
        self.generation(layout["generation"] + 1, self.read(), layout["buckets"])
        self.forget(layout)

    def forget(self, layout: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(layout)}")
        for left in (f"{self.path}/layouts/{layout['generation']:09d}.json", f"{self.path}/data-{layout['generation']}"):
            self.store.delete(self.at(left), True)

    def drop(self) -> None:
        """Delete the index."""
        if layout := self.layout():
            self.forget(layout)
        self.store.delete(self.at(self.path), True)


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id stays. Counts combine before the shuffle, so a hot text is no hot task."""
    return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def label(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group: (id, digest, keep_id, group_size, kept). Hot digests are told by their rows here.

    groups has (digest, keep_id, group_size, here), the last being the rows of the digest in `rows`.
    """
    found = join_groups(rows, groups, "digest", "here").drop("here")
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def batches_of(rows: DataFrame, batches: int) -> list[DataFrame]:
    """rows in ranges of their ids, the largest first and null ids with the smallest; ids that can't be ranged are one batch."""
    kind = rows.schema["id"].dataType.simpleString()
    if batches < 2 or kind not in ("tinyint", "smallint", "int", "bigint"):
        return [rows]
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = rows.agg(F.percentile_approx("id", shares, 1000).alias("c")).first()["c"] or []
    out, above = [], F.lit(True)
    for cut in cuts:
        own = F.coalesce(F.col("id") > cut, F.lit(False))
        out.append(rows.filter(own & above))
        above = ~own
    return [*out, rows.filter(above)]


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document: (id, digest, keep_id, group_size, kept).

    Texts are equal when identical after lower-casing A-Z; null counts as empty; of equal texts the row with the
    largest id stays, or the row the index had before. Rows that repeat both id and text are one document and come
    back once. A null id is a document of its own group's texts and stays only where no id is known. An empty table
    gives no rows. Other columns of docs are ignored. group_size counts all documents that the index has seen,
    those of earlier calls too. An index of the call's own is dropped again.
    """
    own = index is None
    index = index or fresh_index(docs.sparkSession)
    rows = materialize(digests(docs, id_col, text_col).distinct(), "digests")
    for batch in batches_of(rows, batches):
        index.append(groups_of(batch))
    here = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("here"))
    groups = materialize(here.join(index.read(), "digest").select("digest", "keep_id", "group_size", "here"), "digest-groups")
    if own:
        index.drop()
    return label(rows, groups)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay, whatever their names.

    Rows that repeat both id and text stay once.
    """
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates([id_col, text_col])
    labels = exact_dedup(docs, id_col, text_col)
    lost = labels.filter(~F.col("kept")).select(F.col("id").alias("__lost"))
    return docs.join(lost, docs[id_col].eqNullSafe(lost["__lost"]), "left_anti")
