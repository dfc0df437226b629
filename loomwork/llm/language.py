"""op1: language identification with a small byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's
largest response in the window is kept, and a softmax layer names the language.  Training is
plain numpy (Adam) over a few windows, spread over the whole text, of a bounded sample of
labelled rows; prediction runs over every window of every whole text, many windows to a batch,
and adds the log-probabilities of a text's windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, persisted, utf8

UNKNOWN = "und"
WINDOW, WIDTHS = 128, (2, 3, 4)
#: Windows of a sample text that are learned from, unless ``per_text`` says otherwise.
PER_TEXT = 4
#: Windows that are predicted together.
BATCH_WINDOWS = 1 << 14


@dataclass
class ByteConvNet:
    """One row of ``filters`` per tap: taps beyond a filter's width are zero."""

    labels: list[str]
    embedding: np.ndarray  # 256 x E
    filters: np.ndarray  # (taps * E) x F
    bias: np.ndarray  # F
    dense: np.ndarray  # F x L
    dense_bias: np.ndarray  # L
    window: int
    taps: int

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled responses of N windows, and the place of each."""
        n, width = windows.shape
        e = self.embedding.shape[1]
        flat = self.embedding[windows].reshape(n, width * e)
        slots = width - self.taps + 1
        view = np.lib.stride_tricks.as_strided(flat, (n, slots, self.taps * e), (flat.strides[0], 4 * e, 4), writeable=False)
        seen = np.ascontiguousarray(view).reshape(n * slots, self.taps * e) @ self.filters
        seen = seen.reshape(n, slots, -1)
        at = seen.argmax(1) if slots and self._train else None
        top = seen.max(1) + self.bias
        return np.maximum(top, 0), at

    _train: bool = False

    def log_probabilities(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for k in range(0, len(windows), block):
            z = self.features(windows[k : k + block])[0] @ self.dense + self.dense_bias
            z -= z.max(1, keepdims=True)
            out[k : k + block] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def cut(data: bytes, window: int, taps: int) -> np.ndarray:
    """Fixed-length windows that cover all of ``data``; neighbours share ``taps - 1`` bytes.

    The rest of the last window is filled with spaces.
    """
    step = window - taps + 1
    n = max(1, -(-max(0, len(data) - taps + 1) // step))
    raw = np.full((n - 1) * step + window, 32, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)[: len(raw)]
    return np.lib.stride_tricks.sliding_window_view(raw, window)[::step]


def spread(text: str | None, window: int = WINDOW, taps: int = max(WIDTHS), many: int | None = PER_TEXT) -> np.ndarray:
    """At most ``many`` evenly spaced windows of a text, or all of them (None)."""
    w = cut(utf8(text), window, taps)
    return w if many is None else w[np.unique(np.linspace(0, len(w) - 1, min(many, len(w))).astype(int))]


def train(
    windows: list[np.ndarray], labels: list[str], *, widths: tuple[int, ...] = WIDTHS, per_width: int = 16,
    embed: int = 8, epochs: int = 4, steps: int = 300, batch: int = 128, rate: float = 0.01, seed: int = 7,
) -> ByteConvNet:
    """Fits the network on windows (a two-dimensional array for each sample text).

    Small samples are gone through more often, to make ``steps`` steps."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    taps, f, window = max(widths), per_width * len(widths), windows[0].shape[1]
    number = {name: k for k, name in enumerate(names)}
    x = np.concatenate(windows)
    y = np.repeat([number[label] for label in labels], [len(w) for w in windows])
    mask = np.zeros((taps, embed, f), np.float32)
    for k, w in enumerate(widths):
        mask[:w, :, k * per_width : (k + 1) * per_width] = 1
    mask = mask.reshape(taps * embed, f)
    net = ByteConvNet(
        names, rng.normal(0, 0.5, (256, embed)).astype(np.float32),
        (rng.normal(0, (2 / (taps * embed)) ** 0.5, mask.shape) * mask).astype(np.float32), np.zeros(f, np.float32),
        rng.normal(0, (1 / f) ** 0.5, (f, len(names))).astype(np.float32), np.zeros(len(names), np.float32), window, taps,
    )
    net._train = True
    params = [net.embedding, net.filters, net.bias, net.dense, net.dense_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    # Rare languages weigh as much as common ones.
    share = np.bincount(y, minlength=len(names)).clip(1)
    weight = (len(y) / len(names) / share)[y].astype(np.float32)
    step = 0
    for _ in range(max(epochs, -(-steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            xb, yb, n = x[pick], y[pick], len(pick)
            pooled, at = net.features(xb)
            z = pooled @ net.dense + net.dense_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p *= weight[pick][:, None] / n
            g_dense, g_dbias = pooled.T @ p, p.sum(0)
            g_pool = (p @ net.dense.T) * (pooled > 0)
            # Only the winning place of each filter passes a gradient on.
            spots = at[:, :, None] + np.arange(taps)  # n x f x taps
            seen = net.embedding[xb[np.arange(n)[:, None, None], spots]]  # n x f x taps x e
            g_filters = np.einsum("nf,nfte->tef", g_pool, seen).reshape(mask.shape) * mask
            back = g_pool[:, :, None, None] * net.filters.reshape(taps, embed, f).transpose(2, 0, 1)[None]
            g_embed = np.zeros_like(net.embedding)
            np.add.at(g_embed, xb[np.arange(n)[:, None, None], spots], back)
            step += 1
            for p_, g, (m, v) in zip(params, [g_embed, g_filters, g_pool.sum(0), g_dense, g_dbias], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net._train = False
    return net


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, held_out: int, per_label: int, per_text: int | None = PER_TEXT) -> list:
    """label and windows of at most ``per_label`` rows of each label, those of the least hash.

    The labels' counts give a hash threshold that about twice as many rows of a label pass; only
    those are ranked, whatever the label's share of the corpus, and only windows of the picked
    texts leave the tasks.
    """
    rows = docs.select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), fold(F.col(id_col), 3).alias("k"),
    ).where(F.col("label").isNotNull() & (F.col("k") != held_out) & F.col("text").rlike(r"\p{L}"))
    counts = persisted(rows.groupBy("label").agg(F.count("*").alias("c")), "labels")
    share = (2 * per_label + 50) / F.col("c")
    near = rows.join(counts, "label").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= per_label)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "h": pdf["h"], "windows": [spread(t, many=per_text).tobytes() for t in pdf["text"]]})

    found = ranked.select("label", "h", "text").mapInPandas(windows, "label string, h long, windows binary")
    return found.orderBy("label", "h", "windows").collect()


def identify_languages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", held_out: int = 1,
    per_label: int = 500, per_text: int | None = PER_TEXT, net: ByteConvNet | None = None,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``, learned from ``label_col``.

    The network learns every label, each from at most ``per_label`` rows of it (the documented
    bound of the sample) and at most ``per_text`` windows of each, spread over the text (None: all of them);
    never from rows of fold
    ``held_out``, and a null label is not learned.  Every byte of every text is predicted on,
    whatever its length.  Equally likely languages go to the first by name.  A text that is null,
    empty or without a letter is ``und`` with score 0, and so is every text if there is nothing to
    learn from.  Repeated rows are predicted each on its own; other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    if net is None:
        sample = training_sample(docs, id_col=id_col, text_col=text_col, label_col=label_col, held_out=held_out, per_label=per_label, per_text=per_text)
        net = train([np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW) for r in sample], [r.label for r in sample]) if sample else None
    model = spark.sparkContext.broadcast(net)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = model.value
        for pdf in batches:
            usable = [net is not None and t is not None and any(map(str.isalpha, t)) for t in pdf["text"]]
            total = np.zeros((len(pdf), len(net.labels) if net else 1))
            count = np.zeros(len(pdf), np.int64)
            held: list[np.ndarray] = []
            owner: list[int] = []

            def flush(total=total, held=held, owner=owner) -> None:
                rows = np.repeat(owner, [len(w) for w in held])
                np.add.at(total, rows, net.log_probabilities(np.concatenate(held)))
                held.clear()
                owner.clear()

            size = 0
            for k, text in enumerate(pdf["text"]):
                if not usable[k]:
                    continue
                windows = cut(utf8(text), net.window, net.taps)
                count[k] = len(windows)
                for lo in range(0, len(windows), BATCH_WINDOWS):
                    held.append(windows[lo : lo + BATCH_WINDOWS])
                    owner.append(k)
                    size += len(held[-1])
                    if size >= BATCH_WINDOWS:
                        flush()
                        size = 0
            if held:
                flush()
            mean = total / np.maximum(count, 1)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            labels = [net.labels[k] if u else UNKNOWN for k, u in zip(p.argmax(1), usable, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": labels, "score": np.where(usable, p.max(1), 0.0)})

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), 3) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
