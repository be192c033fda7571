"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting goes from feature to feature, each time fitting a shallow tree to the gradient of the log-loss
and adding a small step of it to that feature's lookup table; then the pairs of features that explain most of
what is left are boosted the same way on coarse grids. A text's score is the logistic of a sum of table entries,
looked up for whole batches at once. The sample is bounded: at most ``per_class`` labelled rows of each class,
chosen by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, row_of, sliced, text_buffer, tidy, word_hashes, word_spans

BINS, GRID, PAIRS, ROUNDS, RATE, RIDGE = 48, 8, 8, 120, 0.15, 1.0
FEATURES = (
    "bytes",
    "words",
    "word_bytes",
    "upper",
    "digit",
    "mark",
    "odd_mark",
    "end_mark",
    "bar",
    "non_ascii",
    "line",
    "distinct",
    "repeated",
    "top_word",
    "caps_word",
    "marked_word",
    "longest",
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_ODD, _ENDS, _BAR, _LINE = _mask("%$#*&@^~<>{}[]\\_=+`"), _mask("!?"), _mask("|"), _mask("\n")
_HIGH = np.arange(256) >= 128
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_UPPER | _DIGIT | _mask("abcdefghijklmnopqrstuvwxyz"))


def features(arr: pa.Array) -> np.ndarray:
    """One row of FEATURES a text, all finite; a text without words has zeros but for its length."""
    buf, offs = text_buffer(arr)
    n, size = len(offs) - 1, np.diff(offs)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[buf], dtype=np.int64)])
        return (total[offs[1:]] - total[offs[:-1]]) / np.maximum(size, 1)

    starts, ends, first = word_spans(buf, offs)
    words = np.diff(first)
    row, some = row_of(first), np.maximum(words, 1)
    length = ends - starts
    names, _ = word_hashes(buf, offs)
    keys, times = np.unique((names >> np.uint64(20)) | (row.astype(np.uint64) << np.uint64(44)), return_counts=True)
    own = (keys >> np.uint64(44)).astype(np.int64)
    most, longest = np.zeros(n), np.zeros(n)
    np.maximum.at(most, own, times)
    np.maximum.at(longest, row, length)
    again = np.flatnonzero((names[1:] == names[:-1]) & (row[1:] == row[:-1]))
    if len(starts):
        upper = np.concatenate([[0], np.cumsum(_UPPER[buf] | _MARK[buf], dtype=np.int64)])
        caps = ((upper[ends] - upper[starts]) == length) & _UPPER[buf[starts]] & (length > 1)
        marked = _MARK[buf[ends - 1]] & _MARK[buf[np.maximum(ends - 2, starts)]]
    else:
        caps = marked = np.zeros(0, bool)
    per = lambda mask: np.bincount(row[mask], minlength=n) / some
    return np.stack(
        [
            np.log1p(size), np.log1p(words), np.bincount(
                row, length, n
            ) / some, share(_UPPER), share(_DIGIT), share(_MARK), share(_ODD), share(_ENDS), share(_BAR), share(_HIGH), share(_LINE),
            np.bincount(own, minlength=n) / some, np.bincount(row[again], minlength=n) / some, most / some, per(caps), per(marked), np.log1p(longest),
        ],
        axis=1,
    )


# ---------------------------------------------------------------- boosting


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, a bin each, of a tree over ordered bins that maximises gradient ** 2 / weight."""
    total_g, total_w = gradient.sum(), weight.sum()
    out = np.full(len(gradient), total_g / (total_w + RIDGE))
    if depth == 0 or len(gradient) < 2:
        return out
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    gain = g**2 / (w + RIDGE) + (total_g - g) ** 2 / (total_w - w + RIDGE)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= total_g**2 / (total_w + RIDGE) + 1e-9:
        return out
    return np.concatenate([_tree(gradient[:k], weight[:k], depth - 1), _tree(gradient[k:], weight[k:], depth - 1)])


def _grid_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Leaf values of a tree over a grid: one cut across either axis, then one in each half across the other."""
    best, found = -1.0, None
    for axis in (0, 1):
        g, w = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        for k in range(1, len(g)):
            parts = [_tree(x.sum(axis=0), y.sum(axis=0), 1) for x, y in ((g[:k], w[:k]), (g[k:], w[k:]))]
            gain = sum(float((p * x.sum(axis=0)).sum()) for p, x in zip(parts, (g[:k], g[k:]), strict=True))
            if gain > best:
                out = np.concatenate([np.tile(parts[0], (k, 1)), np.tile(parts[1], (len(g) - k, 1))])
                best, found = gain, out if axis == 0 else out.T
    return found if found is not None else np.zeros_like(gradient)


class Model:
    """Lookup tables of features and of pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        k = len(FEATURES)
        cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(y) else np.zeros(0) for j in range(k)]
        self.cuts = cuts
        self.coarse = [c[:: max(1, -(-len(c) // (GRID - 1)))][: GRID - 1] for c in cuts]
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if len(y) == 0 or y.min() == y.max():
            return
        bins, f = self._bins(x, cuts), np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j in range(k):
                p = 1 / (1 + np.exp(-f))
                step = RATE * _tree(np.bincount(bins[j], y - p, len(self.tables[j])), np.bincount(bins[j], p * (1 - p), len(self.tables[j])))
                self.tables[j] += step
                f += step[bins[j]]
        grid, p = self._bins(x, self.coarse), 1 / (1 + np.exp(-f))
        gains = []
        for a in range(k):
            for b in range(a + 1, k):
                at = grid[a] * GRID + grid[b]
                gains.append((-float((np.bincount(at, y - p, GRID**2) ** 2 / (np.bincount(at, p * (1 - p), GRID**2) + RIDGE)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gains)[:PAIRS]]
        self.grids = [np.zeros((GRID, GRID)) for _ in self.pairs]
        for _ in range(ROUNDS // 6):
            for table, (a, b) in zip(self.grids, self.pairs, strict=True):
                p, at = 1 / (1 + np.exp(-f)), grid[a] * GRID + grid[b]
                step = RATE * _grid_tree(np.bincount(at, y - p, GRID**2).reshape(GRID, GRID), np.bincount(at, p * (1 - p), GRID**2).reshape(GRID, GRID))
                table += step
                f += step.ravel()[at]

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]

    def score(self, arr: pa.Array) -> np.ndarray:
        x = features(arr)
        f = np.full(len(x), self.base)
        for table, at in zip(self.tables, self._bins(x, self.cuts), strict=True):
            f += table[at]
        grid = self._bins(x, self.coarse) if self.pairs else []
        for table, (a, b) in zip(self.grids, self.pairs, strict=True):
            f += table[grid[a], grid[b]]
        return 1 / (1 + np.exp(-f))


# ---------------------------------------------------------------- Spark


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_if: Column | None = None, per_class: int = 8000) -> Model:
    """A model of the labelled rows that train_if (a condition on labels) admits.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest counts; an id
    with several rows counts with each, within the bound.
    Without rows of both classes every score is the share of label 1 (one half without any row).
    """
    admitted = F.lit(True) if train_if is None else train_if
    one = labels.where(admitted & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    one = one.withColumn("order", F.xxhash64("doc_id", F.lit(13)))
    ids = [one.where(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    known = F.broadcast(ids[0].unionByName(ids[1]).select("doc_id", "order", F.col("label").cast("double").alias("label")))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in sliced(batch, 0)):
            x = features(part.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(x.shape[1])), part.column(1), part.column(2)], [*FEATURES, "label", "order"])

    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "label", "order")
    columns = [*FEATURES, "label"]
    described = rows.mapInArrow(tidy(describe), ", ".join(f"{c} double" for c in columns) + ", order long")
    # an id may have several rows: they count within the bound, too
    parts = [described.where(F.col("label") == k).orderBy("order", *FEATURES).limit(per_class) for k in (0, 1)]
    found = parts[0].unionByName(parts[1]).toArrow()
    x = np.stack([found[c].to_numpy() for c in columns], axis=1) if found.num_rows else np.zeros((0, len(columns)))
    x = x[np.lexsort(x.T)]
    return Model(x[:, :-1], x[:, -1])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from threshold on) of all rows.

    Null texts count as empty and get the score of a text without words; repeated rows get equal scores;
    a score equal to the threshold is predicted 1; an empty table gives no rows; other columns of docs are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                s = sent.value.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at or above threshold."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, at):
                yield part.filter(pa.array(sent.value.score(part.column(at)) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def score_held_out(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Scores of all rows by a model of the labels whose crc32(doc_id as text) mod parts is not held."""
    model = fit(docs, labels, "quality", crc_mod("doc_id", parts) != held)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", parts) == held).alias("held_out"), "score", "predicted")
