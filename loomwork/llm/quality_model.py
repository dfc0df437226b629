"""op8: a quality score from document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics.  Each task sums its
rows' part of the normal equations, the sums are added up, and the driver solves one small
ridge system.  Isotonic regression on a fold of its own then turns scores into probabilities,
between the centres of its blocks in proportion, so that scores of one block keep their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, persisted, space_table, utf8, word_hashes

STATISTICS = (
    "words", "symbols", "shouts", "upper", "digits", "word_length", "distinct_words", "repeated_neighbours", "distinct_lines", "beyond_ascii", "line_words", "stops",
)
#: Part of the score that is the raw score (squashed), not its calibration.
RAW_SHARE = 0.02
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def statistics(text: str | None) -> list[float]:
    """Numbers between about 0 and 1; all 0 for a text without words."""
    data = utf8(text)
    h = word_hashes(data, space_table()) if data else ()
    n = len(h)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    chars = int(count[33:].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        min(np.log1p(n) / 12, 1.0), min(int(count[_SYMBOL].sum()) / n, 2.0) / 2, min(int(count[33]) / n, 2.0) / 2, upper / max(upper + lower, 1),
        int(count[48:58].sum()) / chars, min(chars / n / 20, 1.0), len(np.unique(h)) / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        len(set(lines)) / len(lines), int(count[128:].sum()) / chars, min(np.log1p(n / len(lines)) / 8, 1.0), min(int(count[46] + count[44]) / n, 1.0),
    ]


@dataclass
class KernelRidge:
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, n_in: int, n_out: int, width: float, seed: int) -> KernelRidge:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 1 / width, (n_in, n_out)), rng.uniform(0, 2 * np.pi, n_out))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if not self.knots:
            return np.clip(raw, 0, 1)
        # Beyond the first and last centre, and along equal blocks, a little of the raw score decides.
        return (1 - RAW_SHARE) * np.interp(raw, *self.knots) + RAW_SHARE / (1 + np.exp(1 - 2 * raw))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the blocks of a non-decreasing fit of
    ``y``; ``x`` ascending."""
    blocks: list[list[float]] = []  # weight, weighted y, weighted x
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([w, w * b, w * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def summed(rows: DataFrame, model: KernelRidge, fan_in: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over ``rows`` (x, y): a sum for each task, then twice of ``fan_in`` sums at most."""
    d = len(model.phases) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros((d, d + 1))
        for pdf in batches:
            z = model.features(np.stack(pdf["x"]))
            total += z.T @ np.column_stack([z, pdf["y"]])
        yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "s": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, s in zip(pdf["g"], pdf["s"], strict=True):
                totals[g] = totals.get(g, 0) + np.frombuffer(s).reshape(d, d + 1)
        yield pd.DataFrame({"g": list(totals), "s": [t.tobytes() for t in totals.values()]}).astype({"g": "int32"})

    sums = rows.mapInPandas(part, "g int, s binary")
    for _ in range(2):
        sums = sums.select(F.floor(F.col("g") / fan_in).cast("int").alias("g"), "s").repartition("g").mapInPandas(add, "g int, s binary")
    total = sum((np.frombuffer(r.s).reshape(d, d + 1) for r in sums.collect()), np.zeros((d, d + 1)))
    return total[:, :-1], total[:, -1]


def fit(rows: DataFrame, *, dimensions: int, width: float, ridge: float, seed: int, bins: int) -> KernelRidge | None:
    """``rows``: x, y (0 or 1) and ``calibrate`` (true: for the isotonic step alone)."""
    model = KernelRidge.of(len(STATISTICS), dimensions, width, seed)
    a, b = summed(rows.where(~F.col("calibrate")), model)
    n = a[-1, -1]
    if not n:
        return None
    model.weights = np.linalg.solve(a + ridge * np.eye(len(a)), b)

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(x)))

    # Scores meet in a fixed number of bins, so the driver gets as many rows at most.
    low, high = -0.5, 1.5
    scored = rows.where("calibrate").select(raw("x").alias("r"), "y")
    binned = F.least(F.greatest(F.floor((F.col("r") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    groups = scored.groupBy(binned.alias("k")).agg(F.avg("r").alias("r"), F.avg("y").alias("y"), F.count("*").alias("w")).orderBy("k").collect()
    if groups:
        model.knots = isotonic(*(np.array([g[c] for g in groups], float) for c in ("r", "y", "w")))
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 0, threshold: float = 0.3,
    dimensions: int = 192, width: float = 0.6, ridge: float = 1e-3, seed: int = 11, bins: int = 2000,
) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Learns from all labels outside fold ``held_out`` (crc32 of the id modulo 5); fold 1 is for
    calibration.  Null labels and labels without a document are left out; of several labels of
    a document the mean is learned.  A text without words has all statistics 0 and is scored
    like any other; without labels every score is 0.5.  Texts of any length are read whole,
    repeated rows are scored each on its own, and equal statistics (ties) have equal scores.
    Other columns are ignored; an empty table gives no rows.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "k": pdf["k"], "x": [statistics(t) for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).alias("doc_id"), fold(F.col(id_col), 5).alias("k"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    described = persisted(rows.mapInPandas(describe, f"doc_id {kind}, k int, x array<float>"), "statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(fold(F.col("doc_id"), 5) != held_out).groupBy("doc_id").agg(F.avg("y").alias("y"))
    learned = described.where(F.col("k") != held_out).join(known, "doc_id").select("x", "y", (F.col("k") == (held_out + 1) % 5).alias("calibrate"))
    model = fit(learned, dimensions=dimensions, width=width, ridge=ridge, seed=seed, bins=bins)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.score(np.stack(x)), 0, 1) if model else np.full(len(x), 0.5))

    out = described.select("doc_id", (F.col("k") == held_out).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
