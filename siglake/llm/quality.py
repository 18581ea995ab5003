"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

A document fails a base rule (fewer than `MIN_WORDS` words, or over `MAX_REPEAT` % of its words in repeated 8-word
windows) or is anomalous: its mean path length over random splits of the statistics is short. The forest is fitted on a
bounded sample, the `FIT_ROWS` rows of smallest hash of doc_id; its threshold comes from the scores of all labelled rows
that pass the base rules, as it decides on no others.

Null text: as empty, hence zero words, base_failed. Ties and repeated rows: each row is judged on its own. Empty tables
give no rows; without labelled rows of quality 1 the forest rejects nothing. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import small_batches, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
SYMBOLS = b"#*$%&|<>"
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: Rows that the forest is fitted on, trees, rows of a tree.
FIT_ROWS, TREES, TREE_ROWS, SEED = 4096, 100, 256, 42
#: The threshold is the least score at which no more than this share of labelled good rows that pass the base rules would go.
GOOD_LOSS = 0.002
SCORE_BINS = 1000

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of `WINDOW` words found twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        keys += h[k : k + n] * _POWERS[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(n, dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(found)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(raw.count, SPACES)),
        sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_stats(t) for t in b.column(1).to_pylist()]
        cols = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *COUNTS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row of counts for each document row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stats, STATS)


def features(counts: np.ndarray) -> np.ndarray:
    """Rule statistics as the forest sees them, from columns in the order of COUNTS."""
    n, chars, symbols, lines, repeats = counts.astype(float).T
    least = np.maximum(n, 1)
    return np.column_stack([np.log1p(n), chars / least, symbols / least, lines / least, repeats / least])


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows, which normalises path lengths."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Random axis-parallel splits; each tree as flat arrays (feature, threshold, left child, path length)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.norm = mean_path(min(tree_rows, len(rows)))
        self.trees = [self._grow(rows[random.permutation(len(rows))[:tree_rows]], random) for _ in range(trees)] if len(rows) > 1 else []

    @staticmethod
    def _grow(rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = math.ceil(math.log2(max(2, len(rows))))
        feature, cut, left, depth = [-1], [0.0], [-1], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            at, own, level = todo.pop()
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
            if level >= limit or not len(spread):
                depth[at] = level + mean_path(len(own))
                continue
            k = int(random.choice(spread))
            x = random.uniform(own[:, k].min(), own[:, k].max())
            feature[at], cut[at], left[at] = k, x, len(feature)
            for part in (own[own[:, k] <= x], own[own[:, k] > x]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1), cut.append(0.0), left.append(-1), depth.append(0.0)
        return np.array(feature), np.array(cut), np.array(left), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; anomalies are high. Without trees: 0."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, depth in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                i, own = every[inner], at[inner]
                at[i] = left[own] + (rows[i, feature[own]] > cut[own])
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def fit_forest(stats: DataFrame, fit_rows: int = FIT_ROWS) -> IsolationForest:
    """Fits on the fit_rows rows of least hash of doc_id, which is all that reaches the driver."""
    sample = stats.orderBy(F.xxhash64("doc_id"), *COUNTS).limit(fit_rows).select(*COUNTS).toPandas()
    return IsolationForest(features(sample.to_numpy()))


def scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """The statistics with anomaly, the forest's score."""
    model = stats.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.score(features(counts)), pa.float64())], [*b.schema.names, "anomaly"])

    return stats.select("doc_id", *COUNTS).mapInArrow(score, f"{STATS}, anomaly double")


def calibrated(scores: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """Least threshold that keeps 1 - good_loss of all labelled good rows; infinite where bad rows are no more often above it.

    Only a histogram of at most 2 x SCORE_BINS counts reaches the driver.
    """
    binned = (
        scores.select("doc_id", F.least(F.floor(F.col("anomaly") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int").alias("bin"))
        .join(labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality in (0, 1)"), "doc_id")
        .groupBy("bin", "quality").count().collect()
    )
    counts = np.zeros((2, SCORE_BINS + 1))
    for r in binned:
        counts[r["quality"], r["bin"]] += r["count"]
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows of each label in this bin or a higher one
    if not above[1, 0]:
        return math.inf
    share = above / np.maximum(above[:, :1], 1)
    k = int(np.argmax(share[1] <= good_loss))
    return k / SCORE_BINS if share[0, k] > share[1, k] else math.inf


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, good_loss: float = GOOD_LOSS) -> DataFrame:
    """Rule statistics, base_failed, anomaly score and kept for each document row."""
    small_batches(docs.sparkSession)
    stats = written(rule_statistics(docs), "quality-stats")
    scores = scored(stats, fit_forest(stats, fit_rows))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    threshold = calibrated(scores.where(~failed), labels, good_loss)
    return scores.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))
