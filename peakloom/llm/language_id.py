"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the maximum of each filter over its
window goes through a softmax layer, and a document's windows are averaged in log probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import least_rows, within_budget

#: The fit draws at most FIT_DOCS texts of each language and takes them as a whole, until they have FIT_WINDOWS windows.
FIT_DOCS, FIT_WINDOWS = 1000, 4000
WINDOW = 256
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 16
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"


def windows_of(data: bytes) -> np.ndarray:
    """All windows of the text, the last one padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """The weights: embedding (256, EMBED), one filter bank over the widest window, output layer."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.wide, self.n = max(WIDTHS), len(WIDTHS) * FILTERS
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        mask = np.zeros((self.wide, EMBED, self.n), np.float32)
        for k, w in enumerate(WIDTHS):
            mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = mask.reshape(-1, self.n)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.n, np.float32)
        self.out = rng.normal(0, 0.1, (self.n, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Each position's embedded bytes from it on, side by side: (windows, positions, wide * EMBED)."""
        e = self.embed[x]
        m = x.shape[1] - self.wide + 1
        return np.concatenate([e[:, k : k + m] for k in range(self.wide)], axis=2)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self.columns(x)
        act = cols.reshape(-1, cols.shape[2]) @ self.filters
        act = act.reshape(cols.shape[0], cols.shape[1], self.n)
        return cols, act, np.maximum(act.max(axis=1) + self.bias, 0)

    def log_probabilities(self, x: np.ndarray, block: int = 32) -> np.ndarray:
        """Of each class for each window."""
        parts = []
        for k in range(0, len(x), block):
            z = self.pooled(x[k : k + block])[2] @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.out_bias)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; the gradient flows to the position of each filter's maximum."""
        cols, act, h = self.pooled(x)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ self.out.T) * (h > 0)
        at = act.argmax(axis=1)  # (windows, filters)
        hit = np.take_along_axis(cols, at[:, :, None], axis=1)  # (windows, filters, wide * EMBED)
        grads = {"out": h.T @ p, "out_bias": p.sum(axis=0), "bias": dh.sum(axis=0)}
        grads["filters"] = np.einsum("wf,wfc->cf", dh, hit) * self.mask
        dcols = dh[:, :, None] * self.filters.T[None]
        grads["embed"] = np.zeros_like(self.embed)
        for j in range(self.wide):
            bytes_at = np.take_along_axis(x, at + j, axis=1)
            np.add.at(grads["embed"], bytes_at.ravel(), dcols[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Cross entropy by Adam."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                xb, yb = x[order[k : k + BATCH]], y[order[k : k + BATCH]]
                grads = self.gradients(xb, yb)
                step += 1
                for n in names:
                    g = grads[n]
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    change = RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - change).astype(np.float32))


def sample_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list:
    """(lang, windows) of a bounded sample: texts are drawn by a hash of the id, each with all its windows, until the budget of windows is used up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [windows_of(str(t).encode("utf-8", "replace")).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], names=["lang", "windows"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("draw"), F.col(text_col).alias("text"))
    drawn = least_rows(rows, "lang", "draw", FIT_DOCS, [F.xxhash64("text"), "text"])
    drawn = within_budget(drawn, "lang", F.ceil(F.octet_length("text") / WINDOW), FIT_WINDOWS)
    return drawn.select("lang", "text").mapInArrow(run, "lang string, windows binary").collect()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages and a trained network (None without rows)."""
    rows = sorted(sample_windows(docs, id_col, text_col, lang_col))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return {"langs": [], "network": None}
    x = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in rows]
    y = np.concatenate([np.full(len(w), langs.index(r["lang"])) for w, r in zip(x, rows, strict=True)])
    network = Network(len(langs))
    network.fit(np.concatenate(x), y)
    return {"langs": langs, "network": network}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) from every window of every whole text; score is the probability of lang_pred.

    A text that is null or has no letter is `und` with score 0, as is every text under a model without languages.
    Null ids pass through; repeated rows repeat; an empty table gives no rows; other columns are ignored.
    """
    langs, network = model["langs"], model["network"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 200):
                rows, parts, weights = [], [], []
                for k, t in enumerate(batch.column(1).slice(lo, 200).to_pylist(), lo):
                    if langs and t is not None and any(map(str.isalpha, t)):
                        data = t.encode("utf-8", "replace")
                        w = windows_of(data)
                        rows.append((k, len(w)))
                        parts.append(w)
                        n = np.full(len(w), WINDOW, np.float64)
                        n[-1] = len(data) - (len(w) - 1) * WINDOW
                        weights.append(n / n.sum())
                if not rows:
                    continue
                logp = network.log_probabilities(np.concatenate(parts)) * np.concatenate(weights)[:, None]
                starts = np.cumsum([0] + [n for _, n in rows[:-1]])
                mean = np.add.reduceat(logp, starts, axis=0)
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for (k, _), best, q in zip(rows, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    preds[k], scores[k] = langs[best], q
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
