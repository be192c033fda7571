"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a bigram model of words. Counts are of texts that hold a word or a pair, so one
long text does not speak for its class. Counts of a class are discounted by OWN (pairs by OWN_PAIR), and what that frees goes
from pairs to words, from words to the number of classes that use the word, and from there to a Kneser-Ney model of
its spelling: its highest order (ORDER bytes) is the class's own, counted over word types, its lower orders are
continuation counts that both classes share. So an expression that was rare or unseen is judged by the parts it shares
with others. A word's vote, the difference of its two log-likelihoods, is bounded by VOTE.

A text is described by its votes: their mean a word over the whole text and over its most toxic window of WINDOW
words, and the largest of its distinct words. A logistic curve over these turns them into a score. It is fitted by
cross-fitting: each labelled text is described by models that have not seen its fold, then the models are made
of all folds. The sample is bounded: at most ``per_class`` labelled rows of each class, chosen by a hash of their ids,
and of these as many as hold ``class_bytes`` of text. Within it all words and pairs count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PUNCTUATED, crc_mod, kept, mix, row_of, sliced, text_buffer, tidy, word_spans, work_dir

#: In windows only words count whose likelihoods differ by a factor of exp(DECISIVE) at least.
WINDOW, DECISIVE, VOTE, TOP = 50, 3.0, 12.0, 6
#: Counts of a class up to OWN (of pairs, OWN_PAIR) say nothing by themselves: they go to what is less specific.
DISCOUNT, OWN, OWN_PAIR, ORDER, FOLDS = 0.75, 1.5, 8.0, 6, 3
#: Grams that are looked up at once.
STEP = 250_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_START, _STOP = 2, 3
#: The context of a text's first word.
_BEGIN = np.uint64(0x9216D5D98979FB1B)


# ---------------------------------------------------------------- words and spellings


def _words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and each row's first word."""
    buf, offs = text_buffer(arr)
    starts, ends, first = word_spans(buf, offs, PUNCTUATED)
    return _LOWER[buf], starts, ends, first


def _names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, a byte position at a time, shorter words dropping out."""
    out = mix((ends - starts).astype(np.uint64))
    left, k = np.arange(len(starts)), 0
    while len(left):
        out[left] = mix(out[left] * np.uint64(0x9E3779B97F4A7C13) + buf[starts[left] + k])
        k += 1
        left = left[starts[left] + k < ends[left]]
    return out


def _grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of each word and its end, packed behind the ORDER - 1 bytes before it, and the word's index."""
    n = ends - starts + 1
    word = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    gram = np.zeros(len(word), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        place = at - back
        inside = (place >= 0) & (place < n[word] - 1)
        byte = np.where(place < 0, _START, _STOP)
        byte[inside] = buf[(starts[word] + place)[inside]]
        gram = (gram << np.uint64(8)) | byte.astype(np.uint64)
    return gram, word


class _Table:
    """Rows of values of 64-bit keys; 0 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[..., order].astype(np.float32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((*self.values.shape[:-1], len(keys)))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[..., at].astype(np.float64), 0.0)


def _discounted(grams: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT) -> tuple[_Table, _Table]:
    """max(n - D, 0) / n(context) of each gram, and of each context the share that goes to lower orders."""
    context, at = np.unique(grams >> np.uint64(8), return_inverse=True)
    total = np.bincount(at, counts, len(context))
    taken = np.minimum(counts, discount)
    own = counts > discount
    return _Table(grams[own], ((counts - taken) / total[at])[own]), _Table(context, np.bincount(at, taken, len(context)) / total)


class Spelling:
    """Kneser-Ney over bytes: the highest order of a class, lower ones of continuation counts shared by both."""

    def __init__(self, by_class: list[np.ndarray]):
        own = [np.unique(g, return_counts=True) for g in by_class]
        self.top = [_discounted(g, c, OWN) for g, c in own]
        grams, self.lower = np.unique(np.concatenate([g for g, _ in own])), []
        for order in range(ORDER - 1, 0, -1):
            grams, counts = np.unique(grams & np.uint64(256**order - 1), return_counts=True)  # distinct bytes before it
            self.lower.append(_discounted(grams, counts))

    def logs(self, grams: np.ndarray) -> list[np.ndarray]:
        """Log-probability of each gram's last byte in class 0 and in class 1."""
        shared = np.full(len(grams), 1 / 256)
        for order, (seen, share) in zip(range(1, ORDER), reversed(self.lower), strict=True):
            key = grams & np.uint64(256**order - 1)
            rest = share.get(key >> np.uint64(8))
            shared = seen.get(key) + np.where(rest > 0, rest, 1) * shared
        out = []
        for seen, share in self.top:
            rest = share.get(grams >> np.uint64(8))
            out.append(np.log(seen.get(grams) + np.where(rest > 0, rest, 1) * shared))
        return out


    def of_words(self, grams: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """Log-probability of each word in class 0 and in class 1, from the grams of words in order; STEP grams at a time."""
        out = np.zeros((2, words))
        for i in range(0, len(grams), STEP):
            own = word[i : i + STEP]
            for k, x in enumerate(self.logs(grams[i : i + STEP])):
                out[k] += np.bincount(own, x, words)
        return out


def pair_keys(before: np.ndarray, names: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + names)


def contexts(names: np.ndarray, first: np.ndarray, begin: int | np.uint64 = _BEGIN) -> np.ndarray:
    """The word before each word, ``begin`` at the start of a row; first: each row's first word."""
    out = np.empty_like(names)
    out[1:] = names[:-1]
    out[first[:-1][np.diff(first) > 0]] = begin
    return out


class Model:
    """The two models and the curve over what they say; score() needs no label."""

    def __init__(self, words: list[str], counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], before: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """words: distinct, and counts of texts, a row a word, a column a class (ordinary, toxic).

        pairs: keys and counts of those of which a class has more than OWN_PAIR. before: context words, and in each class the
        sum of the counts of their pairs and of what these give away, min(count, OWN_PAIR).
        """
        buf, starts, ends, _ = _words(pa.array(words, pa.large_string()))
        if len(starts) != len(words):
            raise ValueError("a word has parts")
        grams, word = _grams(buf, starts, ends)
        self.spelling = Spelling([grams[counts[word, k] > 0] for k in (0, 1)])
        spelled = np.exp(self.spelling.of_words(grams, word, len(words)))
        total, kinds = np.maximum(counts.sum(axis=0), 1), (counts > 0).sum(axis=1)  # in how many classes a word occurs
        rest = np.where(counts.any(axis=0), np.minimum(counts, OWN).sum(axis=0) / total, 1.0)
        free = DISCOUNT * (kinds > 0).sum() / max(kinds.sum(), 1)
        shared = np.maximum(kinds - DISCOUNT, 0) / max(kinds.sum(), 1) + free * spelled
        logs = np.log(1e-300 + np.maximum(counts.T - OWN, 0) / total[:, None] + rest[:, None] * shared)
        self.unseen = np.log(rest * (free or 1.0))[:, None]
        self.words = _Table(_names(buf, starts, ends), logs)
        self.pairs = _Table(pairs[0], np.maximum(pairs[1].T - OWN_PAIR, 0))
        self.before = _Table(before[0], np.concatenate([before[1], before[2]], axis=1).T)
        self.curve = (np.zeros(TOP + 4), np.zeros(TOP + 4), np.ones(TOP + 4))

    def votes(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of each row the difference of its log-likelihoods, its kind, and each row's first word."""
        buf, starts, ends, first = _words(arr)
        if not len(starts):
            return np.zeros(0), np.zeros(0, np.int64), first
        names = _names(buf, starts, ends)
        kinds, at, back = np.unique(names, return_index=True, return_inverse=True)
        logs = self.words.get(kinds)
        new = logs[0] == 0
        grams, word = _grams(buf, starts[at[new]], ends[at[new]])
        logs[:, new] = self.unseen + self.spelling.of_words(grams, word, int(new.sum()))
        total, given = np.split(self.before.get(np.append(kinds, _BEGIN)), 2)
        with np.errstate(divide="ignore"):
            back_off = np.where(total > 0, np.log(given / np.maximum(total, 1)), 0.0)
        before = contexts(back, first, len(kinds))
        both = back_off[:, before] + logs[:, back]
        own = self.pairs.get(pair_keys(contexts(names, first), names))
        some = np.flatnonzero(own.any(axis=0))  # few pairs have counts of their own
        with np.errstate(divide="ignore"):
            both[:, some] = np.logaddexp(np.log(own[:, some] / np.maximum(total[:, before[some]], 1)), both[:, some])
        return np.clip(both[1] - both[0], -VOTE, VOTE), back, first

    def features(self, arr: pa.Array) -> np.ndarray:
        """Length-normalised votes of the whole text and of its most toxic window, the largest of its words, and its
        length; 0 without words."""
        value, kind, first = self.votes(arr)
        n = np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(value)])
        whole = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        total = np.concatenate([[0.0], np.cumsum(np.where(np.abs(value) >= DECISIVE, value, 0.0))])
        most = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        long = np.flatnonzero(n > WINDOW)
        if len(long):
            span = n[long] - WINDOW + 1
            row = np.repeat(np.arange(len(long)), span)
            begins = np.cumsum(span) - span
            start = first[long][row] + np.arange(len(row)) - begins[row]
            most[long] = np.maximum.reduceat((total[start + WINDOW] - total[start]) / WINDOW, begins)
        return np.concatenate([np.stack([np.ones(len(n)), whole, most], axis=1), _largest(value, kind, row_of(first), len(n)), np.log1p(n)[:, None]], axis=1)

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on standardised features by Newton steps with a small ridge; without both classes, the rows' mean."""
        w, mean, scale = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.ones(x.shape[1])
        if len(y) == 0 or y.min() == y.max():
            p = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
            w[0] = np.log(p / (1 - p))
        else:
            mean[1:], scale[1:] = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
            z, ridge = (x - mean) / scale, np.diag([1e-9] + [5e-4 * len(y)] * (x.shape[1] - 1))
            for _ in range(80):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + ridge, z.T @ (y - p) - ridge @ w)
                w += step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        self.curve = (w, mean, scale)

    def score(self, arr: pa.Array) -> np.ndarray:
        w, mean, scale = self.curve
        return 1 / (1 + np.exp(-np.clip((self.features(arr) - mean) / scale @ w, -30, 30)))


def _largest(value: np.ndarray, kind: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The TOP largest votes of each row that are positive, a word counting once, by its largest; 0 for want of more."""
    out = np.zeros((rows, TOP))
    some = value > 0
    value, kind, row = value[some], kind[some], row[some]
    order = np.lexsort((-value, kind, row))
    row, kind, value = row[order], kind[order], value[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])
    row, value = row[once], value[once]
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    first = rank < TOP
    out[row[first], rank[first]] = value[first]
    return out


# ---------------------------------------------------------------- Spark


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, train_if: Column, per_class: int, class_bytes: int) -> DataFrame:
    """(text, label, fold) of at most per_class rows of each class, and at most class_bytes of text, in the order of a hash of the ids."""
    one = labels.where(train_if & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    one = one.withColumn("order", F.xxhash64("doc_id", F.lit(11)))
    ids = [one.where(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    rows = rows.withColumn("tie", F.xxhash64("text"))  # an id may have several rows
    rows = [rows.where(F.col("label") == k).orderBy("order", "doc_id", "tie").limit(per_class) for k in (0, 1)]
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0))
    bounded = rows[0].unionByName(rows[1]).withColumn("bytes", so_far).where(F.col("bytes") <= class_bytes)
    return bounded.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"))


_COUNTS = [f"n{label}{fold}" for label in (0, 1) for fold in range(FOLDS)]
_OF = ", ".join(f"{c} long" for c in _COUNTS)


def _tally(rows: DataFrame, of_pairs: bool) -> DataFrame:
    """Texts of each class and fold that hold a word, or a pair (with its context): a text counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 0):
                buf, starts, ends, first = _words(part.column(0))
                names, row = _names(buf, starts, ends), row_of(first)
                before = contexts(names, first)
                keys, at, back = np.unique(pair_keys(before, names) if of_pairs else names, return_index=True, return_inverse=True)
                place = np.unique(back * part.num_rows + row)  # once a text
                kind, row = place // max(part.num_rows, 1), place % max(part.num_rows, 1)
                own = part.column(1).to_numpy()[row] * FOLDS + part.column(2).to_numpy()[row]
                counts = [pa.array(np.bincount(kind[own == k], minlength=len(keys))) for k in range(len(_COUNTS))]
                if of_pairs:
                    named = [pa.array(keys.view(np.int64)), pa.array(before[at].view(np.int64))]
                else:
                    text = buf.tobytes()
                    named = [pa.array([text[starts[k] : ends[k]].decode("utf-8", "replace") for k in at], pa.string())]
                yield pa.RecordBatch.from_arrays([*named, *counts], [*(["pair", "before"] if of_pairs else ["word"]), *_COUNTS])

    named = ["pair", "before"] if of_pairs else ["word"]
    counted = rows.select("text", "label", "fold").mapInArrow(tidy(run), ("pair long, before long, " if of_pairs else "word string, ") + _OF)
    return counted.groupBy(*named).agg(*(F.sum(c).alias(c) for c in _COUNTS))


def _left(label: int, fold: int) -> Column:
    """The count of a class without a fold (without none, if fold is FOLDS)."""
    return sum((F.col(f"n{label}{k}") for k in range(FOLDS) if k != fold), F.lit(0))


def _models(rows: DataFrame, path: str) -> Iterator[Model]:
    """A model without each fold, and one of all, one at a time."""
    words = _tally(rows, False).where("word <> ''").orderBy("word").toArrow()
    pairs = kept(_tally(rows, True), f"{path}/pairs")
    whole = [F.sum(_left(label, fold)).cast("float").alias(f"s{label}{fold}") for label in (0, 1) for fold in range(FOLDS + 1)]
    given = [F.sum(F.least(_left(label, fold), F.lit(OWN_PAIR))).cast("float").alias(f"g{label}{fold}") for label in (0, 1) for fold in range(FOLDS + 1)]
    before = pairs.groupBy("before").agg(*whole, *given).orderBy("before").toArrow()
    often = pairs.where(F.greatest(_left(0, FOLDS), _left(1, FOLDS)) > OWN_PAIR).orderBy("pair").toArrow()

    def counts(table: pa.Table, fold: int) -> np.ndarray:
        return np.stack([sum(table[f"n{label}{k}"].to_numpy() for k in range(FOLDS) if k != fold) for label in (0, 1)], axis=1).astype(np.float64)

    for fold in range(FOLDS + 1):
        n = counts(words, fold)
        some = n.any(axis=1)
        sums = [np.stack([before[f"{c}{label}{fold}"].to_numpy() for label in (0, 1)], axis=1).astype(np.float64) for c in "sg"]
        of_pairs = (often["pair"].to_numpy().view(np.uint64), counts(often, fold))
        yield Model(words["word"].filter(pa.array(some)).to_pylist(), n[some], of_pairs, (before["before"].to_numpy().view(np.uint64), *sums))


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train_if: Column | None = None, per_class: int = 3000, class_bytes: int = 32 << 20
) -> Model:
    """A model from the labelled rows that train_if (a condition on labels) admits.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest counts; an id with
    several rows counts with each, within the bounds. Without labels, every score is close to 0; with labels of one
    class only, all scores are close to it.
    """
    path = work_dir(docs.sparkSession)
    rows = kept(_sample(docs, labels, label_col, F.lit(True) if train_if is None else train_if, per_class, class_bytes), f"{path}/sample")
    names, described, model = [f"x{k}" for k in range(TOP + 4)], [], None
    for fold, model in enumerate(_models(rows, path)):
        if fold < FOLDS:
            described.append(_described(rows.where(F.col("fold") == fold), model, names))
    x = pa.concat_tables(described)
    columns = [x[c].to_numpy() for c in (*names, "label")]
    columns = [c[np.lexsort(columns)] for c in columns]  # rows in an order of their own, so that sums agree from run to run
    model.fit_curve(np.stack(columns[:-1], axis=1), columns[-1].astype(np.float64))
    return model


def _described(rows: DataFrame, model: Model, names: list[str]) -> pa.Table:
    """Features and labels of rows, by a model that goes when they are done."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in sliced(batch, 0)):
            x = sent.value.features(part.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(len(names))), part.column(1)], [*names, "label"])

    schema = ", ".join(f"{c} double" for c in names) + ", label int"
    out = rows.select("text", "label").repartition(16).mapInArrow(tidy(describe), schema).toArrow()
    sent.destroy()
    return out


def _scored(model: Model, docs: DataFrame) -> Callable[[pa.RecordBatch, int], np.ndarray]:
    """A function of a batch and the place of its text column that gives scores in tasks, in slices of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch, text: int) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(sent.value.score(part.column(text)) for part in sliced(batch, text))])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from threshold on) of all rows.

    Null texts count as empty and get the score of a text without words; repeated rows get equal scores;
    a score equal to the threshold is predicted 1; an empty table gives no rows; other columns of docs are left out.
    """
    scores = _scored(model, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold; odd rows as in ``score``."""
    scores, at = _scored(model, docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch, at) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def score_held_out(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """Scores of all rows by a model of the labels whose crc32(doc_id as text) mod parts is not held."""
    model = fit(docs, labels, "toxic", crc_mod("doc_id", parts) != held)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", parts) == held).alias("held_out"), "score", "predicted")
