"""Quality scores by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, grown by cyclic boosting of
shallow trees on that feature alone; then the pairs with the largest gains on
the residuals get tables of their own. A score is the sum of one entry from
each table, so a batch of rows is scored by adding looked-up columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import labelled_fold, settled_labels, stage_table

#: Labelled rows that the tables are learned from, at most.
TRAIN_ROWS = 40_000
BINS = 32
ROUNDS = 120
PAIRS = 8
PAIR_ROUNDS = 40
RATE = 0.1
RIDGE = 2.0
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "odd_marks", "distinct_words", "top_word", "top_ten_words",
    "same_as_last", "distinct_bigrams", "log_lines", "line_length", "distinct_lines", "capitalised", "long_words", "short_words", "commas", "stops", "beyond_ascii",
)


def text_features(text: str | None) -> list[float]:
    """FEATURES of a whole text; null reads as empty."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [float(np.log1p(len(text))), *[0.0] * (len(FEATURES) - 1)]
    size = len(text)
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters = octets[65:91].sum() + octets[97:123].sum() + octets[192:].sum()
    blank = octets[9:14].sum() + octets[32]
    digits = octets[48:58].sum()
    marks = octets[33:128].sum() - octets[48:58].sum() - octets[65:91].sum() - octets[97:123].sum()
    counts = Counter(words)
    common = counts.most_common(10)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    bigrams = set(zip(words, words[1:]))
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        float(lengths.mean()),
        float(octets[65:91].sum() / max(1, letters)),
        float(digits / size),
        float(marks / size),
        float(octets[124] / n),
        float(octets[33] / n),
        float((octets[35] + octets[36] + octets[37] + octets[38] + octets[42]) / n),
        len(counts) / n,
        common[0][1] / n,
        sum(k for _, k in common) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(bigrams) / max(1, n - 1),
        float(np.log1p(len(lines))),
        float(np.log1p(size / len(lines))),
        len(set(lines)) / len(lines),
        sum(w[0].isupper() for w in words) / n,
        float((lengths > 12).mean()),
        float((lengths < 4).mean()),
        float(octets[44] / n),
        float(octets[46] / n),
        float(octets[192:].sum() / max(1, size - blank)),
    ]


@dataclass
class Additive:
    """Bin edges and tables; scores are probabilities."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        at = self.bins(x)
        z = np.full(len(x), self.base)
        for table, b in zip(self.tables, at):
            z += table[b]
        for i, j, table in self.pairs:
            z += table[at[i], at[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values by bin of a tree of a few leaves over one feature."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in runs]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a pair's grid into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    gain = sum(x * x / (y + RIDGE) for x, y in zip(*parts)) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [x[i, j] / (y[i, j] + RIDGE) for x, y in zip(*parts)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Learn the tables. Without rows of both classes every score is one half."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(edges, 0.0, tables, [])
    if not len(y) or y.min() == y.max():
        return model
    at = model.bins(x)
    mean = y.mean()
    model.base = float(np.log(mean / (1 - mean)))
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            p = 1 / (1 + np.exp(-z))
            g = np.bincount(at[j], y - p, len(table))
            h = np.bincount(at[j], p * (1 - p), len(table))
            step = RATE * _tree(g, h)
            table += step
            z += step[at[j]]
    p = 1 / (1 + np.exp(-z))
    found = []
    for i, j in combinations(range(len(edges)), 2):
        shape = (len(tables[i]), len(tables[j]))
        if min(shape) > 1:
            cell = at[i] * shape[1] + at[j]
            g = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape)
            h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
            found.append((_quadrants(g, h)[0], i, j))
    model.pairs = [(i, j, np.zeros((len(tables[i]), len(tables[j])))) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-z))
            cell = at[i] * table.shape[1] + at[j]
            g = np.bincount(cell, y - p, table.size).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            step = RATE * _quadrants(g, h)[1]
            table += step
            z += step[at[i], at[j]]
    return model


def featured(docs: DataFrame) -> DataFrame:
    """(row, x): the columns of ``docs`` but its text, and the text's features."""

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_features(t) for t in texts])

    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), measure("text").alias("x"))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without its text, plus held_out, score and predicted.

    Features are measured once for every row. The tables are learned from at
    most ``train_rows`` labelled rows outside the held-out fold, in hash order
    of their ids; null and conflicting labels are skipped, and rows that repeat
    an id count once, by their least features. Null texts read as empty;
    repeated rows get equal scores; an empty table gives an empty result, and
    without labels of both classes all scores are one half. Other columns pass
    through, but columns named held_out, score or predicted, which give way.
    """
    rows = stage_table(featured(docs), "features")
    known = settled_labels(labels, "quality")
    found = rows.select(F.col("row.doc_id").alias("doc_id"), "x").join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    x = np.array(sample["x"].tolist()).reshape(-1, len(FEATURES))
    shared = docs.sparkSession.sparkContext.broadcast(fit(x, sample["quality"].to_numpy(float)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(shared.value.predict(np.array(xs.tolist()).reshape(-1, len(FEATURES))))

    held = F.coalesce(labelled_fold(F.col("row.doc_id")) == 1, F.lit(False))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "held_out", "score", "predicted")]
    out = rows.select("row", held.alias("held_out"), score("x").alias("score"))
    return out.select(*own, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
