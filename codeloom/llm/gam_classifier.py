"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Cyclic boosting: features take turns; each turn fits a shallow tree to the gradient along one binned feature and adds it to
that feature's lookup table. Then the pairs whose joint cuts explain most of what is left get tables of their own, in the
same way. A score is the logistic of an intercept plus one table entry per feature and pair: vectorised additions.

The model is fitted on a bounded sample of labelled rows (max_rows, drawn by a hash of doc_id); everything else covers all
documents. Features come from the text alone: labels, lang, source and doc_id are never inputs.

Defined results: null texts are empty; an empty text has all features 0 and gets the score of that point; without labels of
both kinds every score is the smoothed share of label 1 (0.5 without any); rows that share a doc_id are scored each; labels
that contradict each other for one doc_id each count; of texts that share a labelled doc_id the smallest is learned from;
features are those of whole texts, however long; an empty table gives no rows; other columns, whatever their names, play no
part (with_score returns them as they are).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = [
    "log_words", "mean_word_chars", "upper_share", "symbol_share", "digit_share", "mark_share", "distinct_word_share", "top_word_share",
    "sentence_end_share", "words_per_line", "repeated_line_share", "same_as_before_share", "no_letter_share", "shout_share", "distinct_pair_share", "long_word_share",
]


def features(text: str | None) -> list[float]:
    """One value per FEATURES; all 0 for a text without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = max(1, int(raw.sum()))
    upper = sum(1 for w in words if w.isupper())
    small = [w.lower() for w in words]
    counts = Counter(small)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, float(raw[65:91].sum()) / chars, float(raw[SYMBOLS].sum()) / chars,
        float(raw[48:58].sum()) / chars, float(raw[MARKS].sum()) / chars, len(counts) / n, max(counts.values()) / n,
        sum(1 for w in words if w[-1] in ".!?") / n, n / max(1, len(lines)), 1 - len({*lines}) / max(1, len(lines)),
        sum(map(str.__eq__, small, small[1:])) / n, sum(1 for w in words if not any(map(str.isalpha, w))) / n, upper / n,
        len({*zip(small, small[1:], strict=False)}) / max(1, n - 1), sum(1 for w in words if len(w) > 14) / n,
    ]


SYMBOLS = list(b"#*$%&|<>@^~{}[]\\=+_")
MARKS = list(b".,;:!?\"'()-/")


class AdditiveModel:
    """Binned features, one table each, and tables of chosen pairs of features."""

    def __init__(self, bins: int = 24, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, smooth: float = 4.0):
        self.bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.smooth = bins, rounds, pairs, pair_rounds, rate, smooth
        self.start, self.edges, self.tables, self.pair_tables = 0.0, [], [], {}

    def places(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value; values on an edge belong above it."""
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(share / (1 - share)))
        if len({*y.tolist()}) < 2:
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        at, total = self.places(x), np.full(len(y), self.start)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                add = self._tree(*self._sums(total, y, at[:, j], len(table)))
                table += add
                total += add[at[:, j]]
        size = [len(t) for t in self.tables]
        cells = {(a, b): at[:, a] * size[b] + at[:, b] for a in range(len(size)) for b in range(a)}
        gains = {p: self._quadrants(*(s.reshape(size[p[0]], size[p[1]]) for s in self._sums(total, y, c, size[p[0]] * size[p[1]])))[0] for p, c in cells.items()}
        chosen = sorted(gains, key=lambda p: (-gains[p], p))[: self.n_pairs]
        self.pair_tables = {p: np.zeros((size[p[0]], size[p[1]])) for p in chosen}
        for _ in range(self.pair_rounds):
            for p, table in self.pair_tables.items():
                add = self._quadrants(*(s.reshape(table.shape) for s in self._sums(total, y, cells[p], table.size)))[1]
                table += add
                total += add.ravel()[cells[p]]
        return self

    @staticmethod
    def _sums(total: np.ndarray, y: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cell, y - p, n), np.bincount(cell, p * (1 - p), n)

    def _leaf(self, g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
        return self.rate * g / (h + self.smooth)

    def _cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best cut of ordered bins; 0 where none helps."""
        if len(g) < 2:
            return 0.0, 0
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + self.smooth) + gr**2 / (hr + self.smooth) - g.sum() ** 2 / (h.sum() + self.smooth)
        k = int(np.argmax(gain))
        return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Up to four leaves: the best cut, then the best of either side."""
        out = np.zeros(len(g))
        _, middle = self._cut(g, h)
        for a, b in ((0, middle), (middle, len(g))):
            if a < b:
                cut = a + self._cut(g[a:b], h[a:b])[1]
                for c, d in ((a, cut), (cut, b)):
                    out[c:d] = self._leaf(g[c:d].sum(), h[c:d].sum())
        return out

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain over no step, and the step, of the best pair of cuts, one along each feature."""
        a, b = self._cut(g.sum(1), h.sum(1))[1] or len(g) // 2, self._cut(g.sum(0), h.sum(0))[1] or g.shape[1] // 2
        best = (0.0, a, b)
        for _ in range(2):  # cuts take turns: each is best given the other
            tries = []
            for i in range(1, g.shape[0]):
                tries.append((self._gain(g, h, i, best[2]), i, best[2]))
            best = max([best, *tries])
            best = max([best, *((self._gain(g, h, best[1], j), best[1], j) for j in range(1, g.shape[1]))])
        out = np.zeros(g.shape)
        for rows in (slice(0, best[1]), slice(best[1], None)):
            for cols in (slice(0, best[2]), slice(best[2], None)):
                out[rows, cols] = self._leaf(g[rows, cols].sum(), h[rows, cols].sum())
        return best[0], out

    def _gain(self, g: np.ndarray, h: np.ndarray, i: int, j: int) -> float:
        parts = ((g[:i, :j], h[:i, :j]), (g[:i, j:], h[:i, j:]), (g[i:, :j], h[i:, :j]), (g[i:, j:], h[i:, j:]))
        return float(sum(a.sum() ** 2 / (b.sum() + self.smooth) for a, b in parts))

    def score(self, x: np.ndarray) -> np.ndarray:
        at, total = self.places(x), np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for (a, b), table in self.pair_tables.items():
            total += table[at[:, a], at[:, b]]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of doc_id as text (null: empty) leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most max_rows labelled documents that are not held out. Only the ids and labels of the
    sample, bounded by max_rows, are broadcast; features are computed where the texts lie."""
    labelled = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    labelled = labelled.withColumn("_h", F.xxhash64(F.lit(5), "_id"))
    n = labelled.count()
    if n > max_rows:  # the lowest hashes; ids without a document cost some of the sample
        labelled = labelled.where(F.col("_h") < int(-(2**63) + 2**64 * min(1.0, 1.2 * max_rows / n)))
    chosen = labelled.orderBy("_h", "_y").limit(max_rows).drop("_h")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id", "_y").agg(F.min("text").alias("text"))
    got = feature_rows(rows.select(F.col("_y").cast("long").alias("doc_id"), "text")).collect()
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    return x, np.array([r.doc_id for r in got], float)


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([features(t) for t in rows.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> AdditiveModel:
    x, y = training_rows(docs, labels, max_rows)
    # the order of collected rows is not fixed; sums of floats must be
    order = np.lexsort([*x.T, y])
    return AdditiveModel(**options).fit(x[order], y[order])


def with_score(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """docs with the score of each text; all columns stay. One pass, no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(known.value.score(x))

    return docs.withColumn(column, score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5)."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
