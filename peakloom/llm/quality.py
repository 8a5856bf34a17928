"""Quality classifier by compression.

Two zstandard dictionaries are trained on good and on bad labelled texts. A text is compressed in blocks with either;
the difference of the compressed sizes per byte of text is turned into a probability by logistic calibration on
labelled texts that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import least_rows, text_of, within_budget

#: The fit draws at most FIT_ROWS labelled texts of each class and takes them as a whole, until they have FIT_BYTES.
FIT_ROWS, FIT_BYTES = 1000, 16 << 20
DICTIONARY_BYTES = 112_640
#: A text is compressed block by block, so that each block leans on the dictionary.
BLOCK = 1024
LEVEL = 3
KEEP_SCORE = 0.3
#: A text's difference is that of itself and PRIOR_BYTES of average text: a few words alone prove little.
PRIOR_BYTES = 100


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [b for t in texts for b in blocks(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY_BYTES]


class Sizer:
    """The normalised difference of compressed sizes under the bad and the good dictionary."""

    def __init__(self, good: bytes, bad: bytes, average: float = 0.0):
        import zstandard

        self.average = average  # difference per byte of an average good text

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else zstandard.ZstdCompressor(level=LEVEL, **plain) for d in (good, bad))

    def difference(self, text: str) -> float:
        data = text.encode("utf-8", "replace")
        parts = blocks(data)
        found = sum(len(self.bad.compress(b)) - len(self.good.compress(b)) for b in parts)
        return (found + PRIOR_BYTES * self.average) / (len(data) + PRIOR_BYTES)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of P(y=1), by Newton's method on standardised x; the slope isn't below 0."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.c_[np.ones(len(x)), (x - mean) / scale]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve(design.T @ (design * w[:, None]) + ridge * np.eye(2), design.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(beta[1], 0.0) / scale
    return float(beta[0] - slope * mean), float(slope)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out=None) -> dict:
    """The model, from a bounded sample: labels are drawn by a hash of the id, then only their texts are fetched.

    held_out is a condition on the label rows that are left out. Without rows of both classes every text gets the
    share of label 1 (0.5 without any labels).
    """
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out is not None:
        rows = rows.filter(~held_out)
    rows = rows.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).distinct()
    drawn = least_rows(rows.withColumn("__draw", F.xxhash64("__id")), "__y", "__draw", FIT_ROWS, ["__id"]).select("__id", "__y", F.col("k").alias("__k"))
    texts = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    wanted = texts.join(F.broadcast(drawn), "__id").select("__y", "__k", "__text")

    taken = within_budget(wanted.withColumnRenamed("__k", "k"), "__y", F.octet_length("__text"), FIT_BYTES)
    got = taken.orderBy("__y", "k", "__text").select("__text", "__y").limit(2 * FIT_ROWS).collect()
    y = np.array([r["__y"] for r in got], int)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return {"good": b"", "bad": b"", "average": 0.0, "intercept": float(np.log((share + 1e-6) / (1 - share + 1e-6))), "slope": 0.0}
    share = rows.agg(F.avg("__y")).first()[0]
    data = [r["__text"].encode("utf-8", "replace") for r in got]
    nth = np.r_[np.arange((y == 0).sum()), np.arange((y == 1).sum())]
    trains = nth % 3 != 2  # two thirds for the dictionaries, one for the calibration
    good, bad = (dictionary([d for d, t, k in zip(data, trains, y, strict=True) if t and k == c]) for c in (1, 0))
    held = ~trains if len(set(y[~trains].tolist())) == 2 else np.ones(len(y), bool)
    sizer = Sizer(good, bad)
    neutral = [sizer.difference(r["__text"]) for r, h in zip(got, held, strict=True) if h and r["__y"] == 1]
    sizer.average = float(np.median(neutral))
    x = np.array([sizer.difference(r["__text"]) for r, h in zip(got, held, strict=True) if h])
    intercept, slope = fit_logistic(x, y[held].astype(float))
    drawn_share = min(max(float(y[held].mean()), 1e-6), 1 - 1e-6)
    prior = min(max(float(share), 1e-6), 1 - 1e-6)  # the classes were drawn alike; move to their share of all labels
    intercept += float(np.log(prior / (1 - prior)) - np.log(drawn_share / (1 - drawn_share)))
    return {"good": good, "bad": bad, "average": sizer.average, "intercept": intercept, "slope": slope}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, difference, score): the probability of label 1 for every whole text.

    Null counts as empty, and an empty text has the difference of an average good one; null ids pass through; repeated rows repeat; an empty
    table gives no rows; columns other than the two named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model["good"], model["bad"], model["average"])
        for batch in batches:
            x = np.array([sizer.difference(str(t)) for t in batch.column(1)])
            p = 1 / (1 + np.exp(-np.clip(model["intercept"] + model["slope"] * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(p)], names=["id", "difference", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, difference double, score double")


def kept_documents(docs: DataFrame, model: dict, text_col: str = "text", least: float = KEEP_SCORE) -> DataFrame:
    """docs without the rows that score below least; all columns stay, and rows don't move between tasks."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model["good"], model["bad"], model["average"])
        for batch in batches:
            x = np.array([sizer.difference(t.as_py() or "") for t in batch.column(place)])
            p = 1 / (1 + np.exp(-np.clip(model["intercept"] + model["slope"] * x, -30, 30)))
            yield batch.filter(pa.array(p >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
