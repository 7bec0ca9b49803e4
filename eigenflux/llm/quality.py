"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text in numpy, batch by batch. Trees are grown level by level on quantile bins with
logistic loss and are kept as flat arrays (feature, threshold, leaf value; children of node i are 2i+1 and 2i+2), which
score all rows of a batch at once, one step a level.

Training takes a bounded sample of at most ``max_rows`` labelled rows, by least hash of the id. Null texts count as empty;
empty texts get a score too (their statistics are zeros). Rows with a null label or id are not learned from; a document
with contradicting labels takes their mean. With no labels, or labels of one kind, all scores are the base rate (0.5
without labels). Very long texts are read in one piece of their own batch. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenflux.llm import common

#: Byte classes; the rest of ASCII is "control".
_CLASSES = ["control", "lower", "upper", "digit", "space", "newline", "high", ".", ",", "?!", "#$%&*", "|", "<>{}[]()=/\\", "'\":;-_", "other"]
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
_CLASS[:32] = 0
for _name, _bytes in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (32, 9)), ("newline", (10,)), ("high", range(128, 256)),
    (".", b"."), (",", b","), ("?!", b"?!"), ("#$%&*", b"#$%&*"), ("|", b"|"), ("<>{}[]()=/\\", b"<>{}[]()=/\\"), ("'\":;-_", b"'\":;-_"),
):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

FEATURES = [
    "log_bytes", *(f"share_{c}" for c in _CLASSES), "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "short_words",
    "log_lines", "mean_line", "distinct_lines", "top_line", "distinct_sentences", "words_a_sentence", "capital_words",
]


def statistics(texts: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    k = len(_CLASSES)
    flat = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    start = 0
    for i, n in enumerate(sizes):
        out[i, 1 : 1 + k] = np.bincount(flat[start : start + n], minlength=k) / max(n, 1)
        start += n
    out[:, 0] = np.log1p(sizes)
    at = 1 + k
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        n, counts = len(words), Counter(words)
        lengths = list(map(len, words))
        lines = [x for x in t.split("\n") if x.strip()]
        of_line = Counter(lines)
        sentences = [x for x in t.replace("!", ".").replace("\n", ".").split(".") if x.strip()]
        out[i, at:] = (
            np.log1p(n), sum(lengths) / n, max(lengths), len(counts) / n, max(counts.values()) / n, sum(x <= 3 for x in lengths) / n,
            np.log1p(len(lines)), len(t) / len(lines), len(of_line) / len(lines), max(of_line.values()) / len(lines),
            len(set(sentences)) / max(len(sentences), 1), n / max(len(sentences), 1), sum(map(str.istitle, words)) / n,
        )
    return out


class BoostedTrees:
    """Binary log-loss boosting on binned features; flat arrays after ``fit``."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.base = 0.0
        nodes = 2 ** (depth + 1) - 1
        self.feature = np.zeros((0, nodes), np.int32)
        self.threshold = np.zeros((0, nodes))
        self.value = np.zeros((0, nodes))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if len(y) == 0:
            return self
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        if y.min() == y.max():
            return self
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
        nodes = 2 ** (self.depth + 1) - 1
        first_leaf = 2**self.depth - 1
        feature, threshold, value = [], [], []
        margin = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            f, t, v = np.zeros(nodes, np.int32), np.full(nodes, np.inf), np.zeros(nodes)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                lo, width = 2**level - 1, 2**level
                own = node - lo
                best, gain = np.zeros((width, 2), np.int64), np.full(width, 1e-9)
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    key = own * self.bins + binned[:, j]
                    gs = np.cumsum(np.bincount(key, g, width * self.bins).reshape(width, -1), 1)
                    hs = np.cumsum(np.bincount(key, h, width * self.bins).reshape(width, -1), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    score = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    score[(hs < self.least / 4) | (ht - hs < self.least / 4)] = -1
                    score = score[:, : len(cuts[j])]
                    at = score.argmax(1)
                    top = score[np.arange(width), at]
                    better = top > gain
                    gain[better] = top[better]
                    best[better] = np.stack([np.full(width, j), at], 1)[better]
                for i in range(width):
                    if gain[i] > 1e-9:
                        f[lo + i], t[lo + i] = best[i, 0], cuts[best[i, 0]][best[i, 1]]
                node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
            leaf = node - first_leaf
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            v[first_leaf:] = -self.rate * gs / (hs + self.l2)
            margin += v[node]
            feature.append(f)
            threshold.append(t)
            value.append(v)
        self.feature, self.threshold, self.value = np.stack(feature), np.stack(threshold), np.stack(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all rows and trees go down a level at a time."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(1))))


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, *, where: Column | None = None, max_rows: int = 20_000, label_col: str = "quality", **options) -> BoostedTrees:
    """Boosted trees from at most ``max_rows`` labelled documents whose id fulfils ``where``."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    known = known if where is None else known.where(where)
    known = known.groupBy("doc_id").agg(F.avg(F.col(label_col)).alias("y"))
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    sample = known.orderBy(rank, "doc_id").limit(max_rows).collect()  # at most max_rows pairs of numbers
    if not sample:
        return BoostedTrees(**options)
    chosen = spark.createDataFrame([(r["doc_id"], float(r["y"])) for r in sample], "doc_id long, y double")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by max_rows
    names = ["doc_id", "y", "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(_texts(batch, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(stats), pa.list_(pa.float64()))], names=names)

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, stats array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    if got.empty:
        return BoostedTrees(**options)
    return BoostedTrees(**options).fit(np.stack(got["stats"].to_numpy()), got["y"].to_numpy())


def predict(docs: DataFrame, model: BoostedTrees, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``score double``, row by row; no shuffle.

    Null and empty texts, null ids and repeated rows are scored like any other. Other columns are not read; a column to keep
    that is named ``score`` raises.
    """
    common.free_names(keep, ("score",))
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(statistics(_texts(batch, len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)
