"""Operator 8: quality rules and an isolation forest over their statistics.

Each document gets the rule statistics of the contract and a few ratios.  A forest of random splits of all ratios is grown on a bounded sample of rows labelled
good, with splits beyond their range too, so that a document odd in any ratio is set apart by few splits, whether or not a bad row is odd there.  The labelled
rows set only the threshold on the score: it lies in the gap that best divides them.  A document is kept if it passes the base rules and its score lies under it.

Null and empty texts: no words, so base_failed.  Very long texts: linear work; labelled rows of over SAMPLE_CHARS characters are not in the sample.  An empty table: no
rows.  Without rows labelled good the forest grows on all sampled rows and the threshold is the fixed one below.  Ties at the threshold are kept.  Repeated rows and
extra columns pass through; a column named as the result is replaced.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free_name, struct_udf, table

#: Rows for growing the forest and for setting the threshold, at most; taken in a seeded order.  Longer texts are not in the sample.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 50_000
TREES = 100
TREE_ROWS = 256
SEED = 8
DEFAULT_THRESHOLD = 0.62
#: Splits reach so many ranges of the good rows beyond them; a range counts as LEAST_RANGE at least, for ratios that are nearly the same in all good rows.
MARGIN = 1.0
LEAST_RANGE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WORDS = re.compile(WORD).findall
SYMBOLS = re.compile(r"[#*$%&|<>]")
HAS_WORD = re.compile(WORD).search

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbols_per_word", "upper_share", "exclaims_per_word", "word_length", "repeat_share", "dup_line_share"]


def statistics(text: str | None) -> tuple:
    """The five contract statistics, then the forest's ratios."""
    text = text or ""
    words = WORDS(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if HAS_WORD(line)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        upto = 0  # words up to here are counted
        for k, w in enumerate(windows):
            if seen[w] > 1:
                repeat += k + 3 - max(k, upto)
                upto = k + 3
    if text.isascii():
        upper = len(text) - len(text.translate(UPPER))
    else:
        upper = sum(map(str.isupper, text))
    d = max(n, 1)
    return n, chars, symbols, dup, repeat, symbols / d, upper / max(chars, 1), text.count("!") / d, chars / d, repeat / d, dup / max(len(lines), 1)


UPPER = {c: None for c in range(ord("A"), ord("Z") + 1)}


class Forest:
    """An isolation forest: trees of random splits as arrays; score 2^(-mean path / expected path), nearer 1 for rows that are easily set apart.
    With a margin, splits are drawn from a box that reaches beyond the rows, and deeper, so that rows outside their range are set apart."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = SEED, margin: float = 0.0):
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))) + (6 if margin else 2))
        self.norm = self.expected(size)
        reach = margin * np.maximum(np.ptp(rows, axis=0), LEAST_RANGE)
        self.box = (rows.min(0) - reach, rows.max(0) + reach) if margin else None
        self.trees = [self.grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def expected(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(self, rows, rng):
        feature, cut, left, right, path = [], [], [], [], []

        def node(part, depth, box):
            k = len(feature)
            feature.append(-1), cut.append(0.0), left.append(k), right.append(k), path.append(depth + self.expected(len(part)))
            if depth < self.depth and len(part) > 1:
                low, high = box or (part.min(0), part.max(0))
                able = np.flatnonzero(high > low)
                if len(able):
                    f = int(rng.choice(able))
                    at = float(rng.uniform(low[f], high[f]))
                    feature[k], cut[k] = f, at
                    edge = np.arange(len(low)) == f
                    left[k] = node(part[part[:, f] <= at], depth + 1, box and (low, np.where(edge, at, high)))
                    right[k] = node(part[part[:, f] > at], depth + 1, box and (np.where(edge, at, low), high))
            return k

        node(rows, 0, self.box)
        return [np.array(x) for x in (feature, cut, left, right, path)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(rows[every, f] <= cut[at], left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.norm, 1e-9)) if len(rows) else total


def divide(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold (keep at or under it) of the best balanced accuracy: half-way between the lowest such score and the next."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order].astype(float)
    kept = np.cumsum(g) / max(g.sum(), 1) + 1 - np.cumsum(1 - g) / max((1 - g).sum(), 1)
    last = np.append(s[1:] != s[:-1], True)
    k = int(np.argmax(np.where(last, kept, -1)))
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def spread(rows: np.ndarray) -> np.ndarray:
    """Ratios, on scales on which both small and large values can be split."""
    return np.sqrt(np.maximum(rows, 0))


class Model:
    def __init__(self, forest: Forest, threshold: float):
        self.forest, self.threshold = forest, threshold

    def score(self, stats: list[tuple]) -> np.ndarray:
        return self.forest.score(spread(np.array([s[5:] for s in stats], float).reshape(-1, len(RATIOS))))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The forest grows on sampled rows labelled good (all sampled rows where there are none); the threshold divides the sampled labelled rows."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    # Labels are sampled first: at most SAMPLE_ROWS ids go to all tasks, and no text is shuffled.
    lab = labels.groupBy(F.col("doc_id").alias("label_of")).agg(F.max("quality").alias("good")).orderBy(F.xxhash64("label_of"), "label_of").limit(SAMPLE_ROWS)
    sample = rows.join(F.broadcast(lab), F.col("id") == F.col("label_of")).groupBy("id").agg(F.min("text").alias("text"), F.max("good").alias("good")).collect()
    if not sample:
        share = SAMPLE_ROWS / max(1, docs.count())
        sample = rows.where(F.xxhash64("id").cast("double") / float(1 << 64) + 0.5 < share).groupBy("id").agg(F.min("text").alias("text"), F.lit(None).alias("good")).limit(SAMPLE_ROWS).collect()
    sample.sort(key=lambda r: r.id)
    stats = [statistics(r.text) for r in sample]
    passed = [k for k, s in enumerate(stats) if not base_failed(s)]
    x = spread(np.array([stats[k][5:] for k in passed], float).reshape(-1, len(RATIOS)))
    good = np.array([sample[k].good == 1 for k in passed], bool)
    known = np.array([sample[k].good is not None for k in passed], bool)
    if not len(x):
        return Model(Forest(np.zeros((2, len(RATIOS)))), DEFAULT_THRESHOLD)
    if not good.any():
        return Model(Forest(x), DEFAULT_THRESHOLD)
    forest = Forest(x[good], margin=MARGIN)
    return Model(forest, divide(forest.score(x[known]), good[known]))


def base_failed(s: tuple) -> bool:
    return s[0] < MIN_WORDS or 100 * s[4] > MAX_REPEAT_PERCENT * s[0]


FIELDS = [*((n, pa.int64()) for n in STATS), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]


def judge(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a struct of statistics, score and verdict."""

    def make():
        def work(texts: pa.Array):
            stats = [statistics(t) for t in texts.to_pylist()]
            score = model.score(stats)
            failed = [base_failed(s) for s in stats]
            return [*([s[k] for s in stats] for k in range(5)), failed, score, [not f and bool(v <= model.threshold) for f, v in zip(failed, score)]]

        return work

    return docs.withColumn(out, struct_udf(make, FIELDS)(F.col(text)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *(F.col("quality")[n].alias(n) for n, _ in FIELDS))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    out = free_name(docs, "quality")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model, out=out).where(F.col(out)["kept"]).select(*docs.columns)
