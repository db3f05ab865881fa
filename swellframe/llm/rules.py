"""Quality rules and an isolation forest over their statistics.

Each document gets rule statistics from its whole text. Documents that break a fixed rule
fail. The others get anomaly scores from isolation forests: random splits of random
subsamples, where rows that few splits set apart have short paths. One forest sees words and
symbols, another lines and length; the scores above which they reject a document are
calibrated on labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from swellframe.llm.batches import map_batches
from swellframe.sources.workspace import written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# The statistics, and what the forest needs to take shares of them.
MEASURES = (*STATISTICS, "n_lines")

# The forest is fitted on at most this many labelled documents, those whose ids have the
# smallest hashes, and each tree on a subsample of them.
FIT_ROWS = 8192
TREES = 100
SUBSAMPLE = 256
# Bad documents in the fit, as a share of the good ones: a forest sets rows apart only where
# they are few.
BAD_SHARE = 0.01
# Feature columns of each forest. A forest over all of them tells fewer bad documents apart:
# splits by length and by lines, in which most do not differ, hide the others.
VIEWS = ((0, 1, 2), (3, 4))
# At most this share of good labelled documents may be rejected, by all forests together.
GOOD_LOSS = 0.002
# Scores are counted in so many steps; a power of two, so that thresholds are exact.
SCORE_STEPS = 1 << 14
SEED = 20240131


def _words(text: str) -> list[bytes]:
    # bytes.split() cuts at space and \t to \r only.
    return text.encode().split()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the list holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    first = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    windows = first
    for size in range(1, window):
        # Each distinct longer window gets the next number, so equality stays exact.
        joined = windows[: len(words) - size] * (len(words) + 1) + first[size:]
        windows = np.unique(joined, return_inverse=True)[1]
    again = np.bincount(windows)[windows] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window:] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _words(text)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.encode().strip()]
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def rule_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    return measures(text)[:5]


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the rule statistics, ``n_lines``, and ``base_failed``.

    Null and empty texts have only zeros and fail. Repeated rows stay repeated.
    """

    def make():
        def work(texts):
            columns = zip(*map(measures, texts), strict=True)
            return [pa.array(column, pa.int64()) for column in columns]

        return work

    added = [StructField(name, LongType()) for name in MEASURES]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return map_batches(df, keep, [text], added, make).withColumn("base_failed", failed)


def features(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Shares and the log length, so that long documents are not anomalies by themselves."""
    words = np.maximum(rows["n_words"], 1).astype(float)
    chars = np.maximum(rows["word_chars"], 1).astype(float)
    lines = np.maximum(rows["n_lines"], 1).astype(float)
    return np.column_stack(
        [
            rows["word_chars"] / words,
            rows["n_symbols"] / chars,
            rows["n_repeat_words"] / words,
            rows["n_dup_lines"] / lines,
            np.log(words),
        ]
    )


def _mean_path(size) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``size`` rows."""
    size = np.maximum(np.asarray(size, float), 1)
    harmonic = np.log(np.maximum(size - 1, 1)) + np.euler_gamma
    return np.where(size > 2, 2 * harmonic - 2 * (size - 1) / size, np.where(size == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees as arrays: feature (-1 in a leaf), split value, leaf path length."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    depth: int
    normal: float
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that are set apart at once."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = feature[node]
                right = x[rows, np.maximum(at, 0)] >= split[node]
                node = np.where(at < 0, node, 2 * node + 1 + right)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.normal, 1e-9))


def fit_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """Random features and split values until each row is alone or the depth is reached."""
    size = min(subsample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    rng = np.random.default_rng(seed)
    feature = np.full((trees, nodes), -1, np.int64)
    split, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for tree in range(trees):
        open_nodes = [(0, 0, x[rng.choice(len(x), size, replace=False)])] if size else []
        while open_nodes:
            node, level, rows = open_nodes.pop()
            low, high = rows.min(0), rows.max(0)
            usable = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(usable):
                length[tree, node] = level + _mean_path(len(rows))
                continue
            at = rng.choice(usable)
            value = rng.uniform(low[at], high[at])
            right = rows[:, at] >= value
            if right.all() or not right.any():
                value = high[at]
                right = rows[:, at] >= value
            feature[tree, node], split[tree, node] = at, value
            open_nodes += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return Forest(feature, split, length, depth, float(_mean_path(size)))


def _threshold(values: np.ndarray, fine: np.ndarray, bad: np.ndarray, limit: float) -> float:
    """The best of ``values`` (ascending scores) by their counts of good and bad rows."""
    if not bad.sum():
        return np.inf
    lost, caught = fine[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    gain = caught / bad.sum() - lost / max(fine.sum(), 1)
    gain = np.where(lost <= limit, gain, 0.0)
    at = int(gain.argmax())
    return float(values[at]) if gain[at] > 0 else np.inf


def calibrated(scores: np.ndarray, good: np.ndarray, good_loss: float = GOOD_LOSS) -> float:
    """The score at which rejecting parts bad from good rows best.

    Among the thresholds that reject at most ``good_loss`` of the good rows, the one with
    the largest gain; without bad rows nothing is rejected.
    """
    values, at = np.unique(scores, return_inverse=True)
    fine, bad = (np.bincount(at[rows], minlength=len(values)) for rows in (good, ~good))
    return _threshold(values, fine, bad, good_loss * good.sum())


@dataclass
class Forests:
    """A forest per view, each with its threshold."""

    forests: list[Forest]

    def view_scores(self, x: np.ndarray) -> list[np.ndarray]:
        return [f.scores(x[:, list(view)]) for f, view in zip(self.forests, VIEWS, strict=True)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The largest score as a part of its forest's threshold: rejected from 1 on."""
        pairs = zip(self.view_scores(x), self.forests, strict=True)
        return np.max([scores / forest.threshold for scores, forest in pairs], axis=0)


def fit(statistics: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = FIT_ROWS) -> Forests:
    """Forests and thresholds from labelled documents that pass the fixed rules.

    ``labels`` has ``key`` and ``quality`` (1 good, 0 bad); null labels are left out. Trees
    are fitted on at most ``rows`` documents, chosen by the hash of their ids whatever the
    input size, few of them bad. Thresholds are calibrated on all.
    """
    known = labels.filter(F.col("quality").isNotNull()).select(
        F.col(key).alias("_key"), (F.col("quality") == 1).alias("_good")
    )
    rules = statistics.filter(~F.col("base_failed")).select(F.col(key).alias("_key"), *MEASURES)
    order = [F.xxhash64("_key"), F.col("_key"), *MEASURES, F.col("_good")]
    labelled = written(rules.join(known, "_key"), "rule-labelled")
    sample = labelled.orderBy(*order).limit(rows).toPandas()
    if sample.empty:
        return Forests([])
    x = features({name: sample[name].to_numpy() for name in MEASURES})
    good = sample["_good"].to_numpy(bool)
    fine, bad = np.flatnonzero(good), np.flatnonzero(~good)
    few = bad[: max(1, int(BAD_SHARE * len(fine)))] if len(fine) else bad
    chosen = x[np.concatenate([fine, few])]
    fitted = Forests([fit_forest(chosen[:, list(view)]) for view in VIEWS])
    _calibrate(fitted, labelled)
    return fitted


def _calibrate(fitted: Forests, labelled: DataFrame) -> None:
    """Sets the thresholds, from counts of all labelled rows per step of the scores.

    A forest is held against the rows that those before it leave, within the loss that they
    leave.
    """
    steps = [f"_step{i}" for i in range(len(fitted.forests))]

    def make():
        def work(*columns):
            rows = {n: np.asarray(c, float) for n, c in zip(MEASURES, columns, strict=True)}
            found = fitted.view_scores(features(rows))
            return [pa.array((scores * SCORE_STEPS).astype(np.int64)) for scores in found]

        return work

    added = [StructField(name, LongType()) for name in steps]
    scored = map_batches(labelled, ["_good"], MEASURES, added, make, rows=8192)
    left = written(scored.groupBy("_good", *steps).count(), "rule-scores")
    limit = None
    for forest, step in zip(fitted.forests, steps, strict=True):
        found = left.groupBy(step).agg(
            F.sum(F.when(F.col("_good"), F.col("count")).otherwise(0)).alias("fine"),
            F.sum(F.when(F.col("_good"), 0).otherwise(F.col("count"))).alias("bad"),
        ).orderBy(step).toPandas()
        fine, bad = (found[name].to_numpy(np.int64) for name in ("fine", "bad"))
        limit = GOOD_LOSS * fine.sum() if limit is None else limit
        values = found[step].to_numpy(float) / SCORE_STEPS
        forest.threshold = _threshold(values, fine, bad, limit)
        limit -= fine[values >= forest.threshold].sum()
        left = left.filter(F.col(step) / SCORE_STEPS < forest.threshold)


def judge(statistics: DataFrame, forest: Forests, keep: list[str]) -> DataFrame:
    """``keep`` columns, the statistics, ``base_failed``, ``score`` and ``kept``.

    Rows that fail a fixed rule are not kept; others are kept unless the score of a forest
    reaches its threshold. ``score`` is the largest part of a threshold that is reached.
    """

    def make():
        def work(*columns):
            if not forest.forests:
                return (pa.array(np.zeros(len(columns[0]))),)
            rows = {n: np.asarray(c, float) for n, c in zip(MEASURES, columns, strict=True)}
            return (pa.array(forest.scores(features(rows)), pa.float64()),)

        return work

    kept = ~F.col("base_failed") & (F.col("score") < 1.0)
    names = [*keep, *STATISTICS, "base_failed"]
    added = [StructField("score", DoubleType())]
    return map_batches(statistics, names, MEASURES, added, make, rows=8192).withColumn("kept", kept)
