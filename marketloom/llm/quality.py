"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each document becomes a short vector of statistics of its whole text. Random
Fourier features of that vector approximate a Gaussian kernel; ridge scores are
fitted by normal equations whose parts every partition sums on its own. A
monotone (isotonic) map then turns scores into probabilities.

Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm._shared import durable, with_columns

#: Names of the statistics, in the order of the vectors.
STATISTICS = (
    "log_bytes", "upper", "digit", "punctuation", "symbol", "pipe", "exclamation", "white", "non_ascii", "byte_entropy", "log_words", "word_length",
    "long_words", "word_ends_symbol", "distinct_words", "word_repeats_last", "top_word", "word_entropy", "repeated_trigrams", "log_lines",
    "words_per_line", "repeated_lines", "short_lines", "lines_end_stop", "words_capital", "words_all_upper",
)
#: Number of random Fourier features.
FEATURES = 192
#: Width of the Gaussian kernel, in standard deviations of a statistic times their number's root.
WIDTH = 1.0
RIDGE = 1e-3
#: Scores are summed in so many steps of equal width before calibration.
STEPS = 400
#: Partitions that sum normal equations; each gives one row for each row of the matrix.
SUMS = 32

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in b".,;:'\"()-?":
    _CLASS[_c] = 3
for _c in b"#$%&*@^~<>{}[]\\/=+_`":
    _CLASS[_c] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 6
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = 7
_CLASS[128:] = 8
_SYMBOLS = tuple("#$%&*!|@^~=+<>")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; the empty text has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    share = np.bincount(_CLASS, weights=counts, minlength=9) / n
    p = counts[counts > 0] / n
    m = len(words)
    seen = Counter(words)
    tops = np.fromiter(seen.values(), np.float64, len(seen)) / m
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n), *share[1:9].tolist(), float(-(p * np.log(p)).sum()), math.log1p(m), sum(map(len, words)) / m,
        sum(len(w) > 14 for w in words) / m, sum(w.endswith(_SYMBOLS) for w in words) / m, len(seen) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, float(tops.max()), float(-(tops * np.log(tops)).sum()),
        1 - trigrams / max(1, m - 2), math.log1p(len(lines)), math.log1p(m / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(len(x) < 40 for x in lines) / len(lines), sum(x.rstrip().endswith((".", "?", "!")) for x in lines) / len(lines),
        sum(w[0].isupper() for w in words) / m, sum(w.isupper() for w in words) / m,
    ]


def _statistics_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))


def statistics_column(text_col: str = "text") -> Column:
    """Statistics of a text column as an array of doubles."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(_statistics_of(batch)), dtype=object)

    return of(F.col(text_col))


@dataclass(frozen=True)
class Model:
    """A fitted classifier; small, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier_features(x, self.mean, self.scale, self.frequencies, self.phases)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores in [0, 1]; a small share of the raw score keeps their order where the map is flat."""
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.values)
        return np.clip(0.998 * level + 0.002 * np.clip(raw, 0, 1), 0.0, 1.0)


def fourier_features(x: np.ndarray, mean, scale, frequencies, phases) -> np.ndarray:
    """cos(w x + b) features with a constant in front; statistics are standardised and clipped first."""
    z = np.clip((x - mean) / scale, -6, 6)
    out = np.cos(z @ frequencies + phases) * np.sqrt(2 / frequencies.shape[1])
    return np.hstack([np.ones((len(x), 1)), out])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares nondecreasing fit (pool adjacent violators) over ordered x: block centres and levels."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    held = np.array(blocks).reshape(-1, 3)
    return held[:, 0] / held[:, 2], held[:, 1] / held[:, 2]


def fit(labelled: DataFrame, *, stats_col: str = "stats", label_col: str = "label", features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = 5, partitions: int = SUMS) -> Model:
    """Fit on rows of statistics (array of doubles) and labels (0 to 1). Every row counts; none is sampled.

    Three passes over the narrow table: moments, normal equations, calibration.
    Each reads back sums whose size depends on the number of features only. With
    no labelled row every score is one half.
    """
    k = len(STATISTICS)
    stats = F.col(stats_col)
    sums = [F.count(F.lit(1))] + [f(F.get(stats, i)) for i in range(k) for f in (F.avg, F.stddev_pop)]
    row = labelled.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    n = row[0]
    mean = np.array([row[1 + 2 * i] or 0.0 for i in range(k)])
    scale = np.maximum(np.array([row[2 + 2 * i] or 0.0 for i in range(k)]), 1e-6)
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0.0, width / np.sqrt(k), (k, features))
    phases = rng.uniform(0.0, 2 * np.pi, features)
    if not n:
        return Model(mean, scale, frequencies, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per row of the matrix [Z'Z | Z'y], summed over the partition."""
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            if len(batch):
                z = fourier_features(np.vstack(batch["x"].to_numpy()), mean, scale, frequencies, phases)
                total += z.T @ np.hstack([z, batch["y"].to_numpy(np.float64)[:, None]])
        yield pd.DataFrame({"i": np.arange(features + 1), "v": list(total)})

    rows = labelled.select(stats.alias("x"), F.col(label_col).cast("double").alias("y"))
    parts = rows.coalesce(partitions).mapInPandas(partial, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    table = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("v")).collect()
    total = np.array([r["v"] for r in sorted(table, key=lambda r: r["i"])])
    weights = np.linalg.solve(total[:, :-1] / n + ridge * np.eye(features + 1) / features, total[:, -1] / n)
    plain = Model(mean, scale, frequencies, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(plain.raw(np.vstack(x.to_numpy())))

    step = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("r"))) * STEPS)
    steps = rows.select(raw("x").alias("r"), "y").groupBy(step.alias("step")).agg(F.avg("r").alias("r"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("w")).collect()
    held = np.array([(r["r"], r["y"], r["w"]) for r in sorted(steps, key=lambda r: r["step"])], float)
    knots, values = isotonic(held[:, 0], held[:, 1], held[:, 2])
    return Model(mean, scale, frequencies, phases, weights, knots, values)


def score_column(model: Model, text_col: str = "text") -> Column:
    """Scores of a text column, from its statistics, in Arrow batches."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(_statistics_of(batch)), dtype="float64")

    return of(F.col(text_col))


def in_held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: those whose CRC-32 of the id as text is divisible by five."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on all labelled rows that aren't held out.

    Rows of ``labels`` without an id or a label are left aside; several labels
    of an id are averaged.
    """
    clean = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("label"))
    stats = docs.filter(~in_held_out(id_col)).select(F.col(id_col).alias("__doc"), statistics_column(text_col).alias("stats"))
    return fit(durable(stats.join(clean, F.col("__doc") == F.col("__id")).select("stats", "label")))


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` plus ``held_out, score, predicted``.

    A null text is an empty one and gets a score like any other; a null id hashes
    as the empty string. Input columns named like an added one give way; empty
    tables stay empty; repeated rows get the same score. Nothing is shuffled.
    """
    scored = with_columns(docs, held_out=in_held_out(id_col), score=score_column(model, text_col))
    return with_columns(scored, predicted=(F.col("score") >= threshold).cast("int"))
