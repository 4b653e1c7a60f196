"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training reads a bounded sample of labelled documents (``max_train`` rows, a documented parameter) and fits on the
driver; trees are complete binary trees held in three arrays, and scoring walks all trees of a batch at once in numpy.
Scoring is one pass over the documents with no shuffle: only the text column goes to Python, only a score comes back.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, q

FEATURES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "longest_word", "upper", "digits", "spaces", "newlines", "high",
    "stops", "commas", "bangs", "marks", "pipes", "other_punctuation", "distinct_words", "top_word", "repeated_next",
    "upper_words", "distinct_lines", "words_a_line", "title_words",
)
_MARKS = [ord(c) for c in "#$%&*@^~=<>{}[]\\"]
_OTHER = [ord(c) for c in "\"'()-/:;?_`+"]


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole document, in the order of FEATURES; a null or empty text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h = np.bincount(data, minlength=256)
    n = len(data)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w, m = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    blanks = int(h[32] + h[9] + h[10] + h[13])
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), (n - blanks) / w, max(map(len, words), default=0),
        h[65:91].sum() / n, h[48:58].sum() / n, blanks / n, h[10] / n, h[128:].sum() / n,
        h[46] / w, h[44] / w, h[33] / w, h[_MARKS].sum() / w, h[124] / w, h[_OTHER].sum() / w,
        len(counts) / w, max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w,
        sum(map(str.isupper, words)) / w, len(set(lines)) / m, len(words) / m, sum(map(str.istitle, words)) / w,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(FEATURES))


@dataclass
class Forest:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2; leaves follow the inner nodes."""

    feature: np.ndarray  # [trees, 2**depth - 1] int32
    threshold: np.ndarray  # [trees, 2**depth - 1] float32; goes right where value > threshold
    value: np.ndarray  # [trees, 2**depth] float32, leaves
    base: float

    @property
    def depth(self) -> int:
        return self.value.shape[1].bit_length() - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row: every level is one gather over [rows, trees]."""
        trees = np.arange(len(self.value))
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int32)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        margin = self.base + self.value[trees, node - (self.value.shape[1] - 1)].sum(axis=1, dtype=np.float64)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Forest:
    """Second-order boosting of the logistic loss over quantile-binned features, grown level by level."""
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():  # one class or none: a constant
        return Forest(np.zeros((1, inner), np.int32), np.full((1, inner), np.inf, np.float32), np.zeros((1, leaves), np.float32), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(width)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1) + bins * np.arange(width)
    forest = Forest(np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves), np.float32), base)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (bins * width) + codes).ravel()
            size = count * bins * width
            sums = [np.bincount(at, np.repeat(v, width), size).reshape(count, width, bins) for v in (g, h, np.ones(len(y)))]
            left = [s.cumsum(axis=2)[:, :, :-1] for s in sums]
            total = [s[:, :1].sum(axis=2, keepdims=True) for s in sums]
            gain = left[0] ** 2 / (left[1] + l2) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(left[2] < least) | (total[2] - left[2] < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    forest.feature[t, first + k], forest.threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[t, node]] > forest.threshold[t, node])
        leaf = node - inner
        forest.value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += forest.value[t, leaf]
    return forest


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000, seed: int = 7) -> Forest:
    """Fit on at most ``max_train`` labelled documents, those of the smallest seeded hash of the id.

    Ids are of any type. Labels without an id or a value are left out; of several labels of one id the lowest counts; labels
    without a document are left out; of documents that share an id one is taken. With no label, or labels of one class alone, the model is a constant.
    """
    chosen = (
        labels.where(q(id_col).isNotNull() & q(label_col).isNotNull())
        .groupBy(q(id_col).alias("label_id")).agg(F.min(q(label_col).cast("double")).alias("label"))
        .orderBy(F.xxhash64(F.col("label_id"), F.lit(seed)), "label_id").limit(max_train)
    )
    # one row for each id, so no more than max_train: of several that share it the one whose text has the smallest hash
    found = docs.select(q(id_col).alias("label_id"), q(text_col).alias("text")).join(F.broadcast(chosen), "label_id")
    sample = found.groupBy("label_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    kind = dict(sample.dtypes)["label_id"]

    def featurise(parts):
        for pdf in parts:
            out = pd.DataFrame({"label_id": pdf["label_id"], "label": pdf["label"]})
            out["x"] = list(matrix(pdf["text"]).astype(np.float64)) if len(pdf) else []
            yield out

    rows = sample.select("label_id", "label", "text").mapInPandas(featurise, f"label_id {kind}, label double, x array<double>").toPandas()
    rows = rows.sort_values("label_id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, (rows["label"].to_numpy(float) > 0.5).astype(float))


def with_score(docs: DataFrame, forest: Forest, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of good quality in column ``name``, which must be a new one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.predict(matrix(texts)), index=texts.index)

    # nondeterministic for the optimizer only: a filter on the score is then not pushed below it, which would score twice
    return docs.withColumn(name, score.asNondeterministic()(q(text_col)))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **train_options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (probability of good quality >= threshold), columns unchanged.

    Every row is judged by its own text: copies get the same verdict, a null text is judged as an empty one. Empty tables
    give empty tables; with no usable labels the model is a constant above the threshold and every row stays. Extra
    columns of any name pass through.
    """
    forest = train(docs, labels, id_col, text_col, **train_options)
    name = fresh(docs.columns, "quality")
    return with_score(docs, forest, name, text_col).where(q(name) >= threshold).select(*[q(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """The accepted documents with their scores."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = train(docs, labels)
    return with_score(docs.select("doc_id", "text"), forest, "quality_score").where("quality_score >= 0.5").select("doc_id", "quality_score")
