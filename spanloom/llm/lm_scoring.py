"""Bigram scoring from a log-frequency Bloom filter.

Counting: every training token and pair of adjacent tokens is hashed; tasks pre-aggregate, deal sorted runs to
buckets of the hash range, and each bucket sums its runs. The number of buckets follows the bytes of training text,
never a setting of the session, so scores are the same on any cluster. From its sums a bucket builds its part of
the filter: a pair of quantised count q enters as q items (pair, 1) ... (pair, q), and a reader probes
level after level until one is missing. Pairs seen once are stored too. The filter knows a pair by its bucket
and the next 32 bits of its hash; as a bucket's share of the corpus is bounded, so is the chance to take one for
another (at most 1 of 2,000). Tokens are counted exactly, by whole hashes: a false level of a frequent one would move
whole texts, and the base score needs these counts in any case.

Scoring: tasks pack texts in batches and ask the buckets for the counts of a batch's distinct rarer tokens; where text
and answers meet again, the batch is scored. A filter of at most FILTER_BYTES is broadcast there. A larger one stays in
its buckets, as a broadcast must not grow with the corpus: they are asked for the levels of the distinct pairs,
too, in the same exchange. Both give the same scores.

Probability of w after v: (1 - l) c(v w) / c(v) + l p(w), l being the share of pairs seen once, p(w) =
(1 - u) c(w) / N, and u = max(n1, 1) / (N + 1) for the class of unseen words. A pair counts with the lower bound of its
quantised count, so the probabilities of all words add up to 1 at most but for false positives of the filter
(about 1 of 700 unseen pairs).
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, kept, mix, partitions, sliced, text_buffer, tidy, word_hashes, work_dir

#: The token that ends a text and, as context, begins one.
END = np.uint64(0x5DEECE66D1CE4E5B)
#: Bits an item, probes an item, and the ratio of successive quantised counts.
BITS, PROBES, RATIO = 14, 7, 2**0.5
#: A filter of at most so many bytes is broadcast.
FILTER_BYTES = 16 << 20
#: Bytes of training text a bucket of the hash range, and buckets at least, as a power of two.
BUCKET_BYTES, LEAST_BITS = 8 << 20, 4
#: Tokens of at least 1 / HOT of all, of which there are at most HOT, are counted from a broadcast table.
HOT = 1 << 19
#: Tokens that a task gathers before it deals them out, and bytes of text in a batch that is scored.
GATHER, BATCH = 1_000_000, 2_000_000


# ---------------------------------------------------------------- packing


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers or floats as bytes; 64-bit unsigned ones must ascend and are stored as differences."""
    out = io.BytesIO()
    for a in arrays:
        if a.dtype == np.uint64:
            a = np.diff(a, prepend=np.uint64(0))
        if a.dtype.kind in "ui":
            width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
            planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            out.write(bytes([width]) + len(a).to_bytes(4, "little") + np.ascontiguousarray(planes.T).tobytes())
        else:
            out.write(b"\xff" + len(a).to_bytes(4, "little") + a.astype("<f8").tobytes())
    return out.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    """The arrays in order, integers as uint64; the first is summed up again."""
    out, i = [], 0
    while i < len(data):
        width, n = data[i], int.from_bytes(data[i + 1 : i + 5], "little")
        i += 5
        if width == 255:
            out.append(np.frombuffer(data, "<f8", n, i))
            i += 8 * n
            continue
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, n * width, i).reshape(width, n).T
        out.append(planes.view("<u8").ravel())
        i += n * width
    if out and out[0].dtype.kind == "u":
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _grams(keys: np.ndarray, bits: int) -> np.ndarray:
    """What the filter knows hashes by: the bucket and 32 bits more."""
    return keys >> np.uint64(32 - bits)


def _runs(keys: np.ndarray, bits: int, width: int = 64) -> Iterator[tuple[int, slice]]:
    """The stretches of ascending keys, of so many bits, that belong to each of the 2 ** bits buckets."""
    ends = np.searchsorted(keys, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)))
    edges = [0, *ends.tolist(), len(keys)]
    for k in range(1 << bits):
        if edges[k] < edges[k + 1]:
            yield k, slice(edges[k], edges[k + 1])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order].astype(np.int64), at)


# ---------------------------------------------------------------- tokens


def _tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's END included, the END as context before each text's first, and lengths."""
    words, first = word_hashes(*text_buffer(arr))
    n = np.diff(first) + 1
    tokens = np.insert(words, first[1:], END)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[:1] = END
    return tokens, before, n


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + tokens)


def _level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log of count); 0 of none."""
    return np.where(counts >= 1, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(RATIO) + 1e-9), 0).astype(np.int64)


def _lower(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, RATIO ** (level - 1.0), 0.0)


# ---------------------------------------------------------------- filter


_LOW = np.uint64(2**32 - 1)


def _positions(grams: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    keys = grams & _LOW
    return mix(keys + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.asarray(size, np.uint64)


def build_filter(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Bytes of the filter of one bucket; its bits are BITS times its items."""
    size = max(64, (BITS * int(levels.sum()) + 7) // 8 * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = grams[levels >= level]
        for probe in range(PROBES):
            bits[_positions(own, level, probe, size)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Parts of some buckets, one behind the other in data; ``levels`` gives quantised counts, 0 for pairs of other buckets."""

    def __init__(self, data: bytes, lengths: dict[int, int], bits: int):
        """lengths: the bytes of each bucket's part, in the order of data."""
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)
        self.at, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        place = 0
        for k, length in lengths.items():
            self.at[k], self.size[k] = place * 8, length * 8
            place += length

    def levels(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.uint8)
        own = (grams >> np.uint64(32)).astype(np.int64)
        left = np.flatnonzero(self.size[own])
        level = 1
        while len(left) and level < 255:
            for probe in range(PROBES):
                size = self.size[own[left]]
                bit = _positions(grams[left], level, probe, size) + self.at[own[left]]
                left = left[(self.data[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            out[left] = level
            level += 1
        return out


# ---------------------------------------------------------------- counting


def _count(train: DataFrame, bits: int) -> DataFrame:
    """One row a bucket: exact token counts, its part of the filter, and what it adds to the model's totals."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, width in ((0, 64), (1, 32 + bits)):  # tokens by their hashes, pairs as the filter knows them
                keys, counts = np.unique(np.concatenate([x[kind] for x in held]), return_counts=True)
                at = list(_runs(keys, bits, width))
                if kind:
                    keys &= _LOW
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in at], pa.int32()),
                        pa.array([kind] * len(at), pa.int32()),
                        pa.array([_pack(keys[s], counts[s]) for _, s in at], pa.binary()),
                    ],
                    ["bucket", "kind", "data"],
                )
            held.clear()

        for batch in batches:
            for part in sliced(batch, 0, BATCH):
                tokens, before, _ = _tokens(part.column(0))
                held.append((tokens, _grams(_pairs(before, tokens), bits)))
                if sum(len(x[0]) for x in held) >= GATHER:
                    yield from rows()
        if held:
            yield from rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, runs in _by_key(batches, "bucket"):
            sums = {}
            for kind in (0, 1):
                own = [_unpack(x) for k, x in zip(runs["kind"], runs["data"], strict=True) if k == kind]
                sums[kind] = _summed(*(np.concatenate([x[i] for x in own]) if own else np.zeros(0, np.uint64) for i in (0, 1)))
            (uni, c1), (pairs, c2) = sums[0], sums[1]
            part = build_filter(pairs, _level(c2))
            row = [bucket, _pack(uni, c1), part.tobytes(), int(c1.sum()), len(c1), int((c1 == 1).sum()), int(c2.sum()), int((c2 == 1).sum())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5), strict=True)],
                ["bucket", "counts", "filter", "tokens", "types", "once", "pairs", "pairs_once"],
            )

    dealt = train.select("text").mapInArrow(tidy(deal), "bucket int, kind int, data binary")
    dealt = dealt.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(add), "bucket int, counts binary, filter binary, tokens long, types long, once long, pairs long, pairs_once long")


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows of each key of batches sorted by it."""
    now, rows = None, defaultdict(list)
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield now, rows
                rows = defaultdict(list)
            now = row[key]
            for k, v in row.items():
                rows[k].append(v)
    if rows:
        yield now, rows


# ---------------------------------------------------------------- scoring


class _Totals:
    """What the formula needs of the whole corpus."""

    def __init__(self, row: dict[str, int]):
        self.tokens, self.types = row["tokens"], row["types"]
        self.unseen = max(row["once"], 1) / (self.tokens + 1)
        self.back_off = min(max(row["pairs_once"] / max(row["pairs"], 1), 0.05), 0.99)

    def scores(self, n: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log10 probability of each text from the counts of its tokens and the levels of its pairs; n: tokens a text."""
        if not self.tokens:
            return np.zeros(len(n))
        row, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        context = np.empty(len(one), np.int64)
        context[1:] = one[:-1]
        context[starts] = one[starts + n - 1]  # every text ends with END, whose count is that of its beginning
        alone = np.where(one > 0, (1 - self.unseen) * one / self.tokens, self.unseen)
        seen = np.minimum(_lower(two) / np.maximum(context, 1), 1.0)
        p = np.where(context > 0, (1 - self.back_off) * seen + self.back_off * alone, alone)
        return np.bincount(row, np.log10(p), len(n))


def score(docs: DataFrame, train_if=None, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per row of docs: id, n_tokens, n_known, train_tokens, base_score and score.

    train_if is a condition on docs that picks the rows to learn from (default: all). Null texts count as
    empty, that is one end; repeated rows are scored each; with nothing to learn from, N = V = 0, every
    token is unknown and both scores are 0; an empty table gives no rows; other columns are ignored. base_score
    uses exact counts: frequent tokens (at most HOT of them) from a broadcast table, the others by meeting their
    counts in the bucket of their hash.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    train = docs.where(F.lit(True) if train_if is None else train_if).select(docs[text_col].alias("text"))
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (-(-size // BUCKET_BYTES) - 1).bit_length())
    lm = kept(_count(train, bits), f"{path}/lm")
    totals = _Totals(lm.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "pairs", "pairs_once"))).first().asDict())

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                keys, counts = _unpack(data)
                hot = counts * HOT >= totals.tokens
                yield pa.RecordBatch.from_arrays([pa.array(keys[hot].view(np.int64)), pa.array(counts[hot].astype(np.int64))], ["key", "count"])

    found = lm.select("counts").mapInArrow(tidy(frequent), "key long, count long").toArrow() if totals.tokens else None
    hot = _summed(found["key"].to_numpy().view(np.uint64), found["count"].to_numpy()) if found is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    parts = None
    if (lm.agg(F.sum(F.length("filter"))).first()[0] or 0) <= filter_bytes:
        got = lm.select("bucket", "filter").collect()
        parts = b"".join(r["filter"] for r in got), {r["bucket"]: len(r["filter"]) for r in got}
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return _joined(rows, lm, parts, hot, totals, bits).withColumnRenamed("id", id_col)


def _asked(before: np.ndarray, tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a batch, as the filter knows them, ascending, and which of them each one is."""
    return np.unique(_grams(_pairs(before, tokens), bits), return_inverse=True)


def _counts_of(own: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of tokens by a table of ascending keys; 0 for others."""
    if not len(keys):
        return np.zeros(len(own), np.int64)
    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[place] == own, counts[place], 0).astype(np.int64)


# what a message holds: a batch itself, its rarer tokens or their counts, its pairs or their levels; -1: what a bucket knows
_TEXTS, _TOKENS, _PAIRS = 0, 1, 2


def _joined(
    rows: DataFrame, lm: DataFrame, parts: tuple[bytes, dict[int, int]] | None, hot: tuple[np.ndarray, np.ndarray], totals: _Totals, bits: int
) -> DataFrame:
    """Scores of all rows: batches go out with their questions to the buckets, and meet the answers by name."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    id_type = rows.select("id").limit(0).toArrow().schema.field(0).type
    hot_sent, parts_sent = spark.sparkContext.broadcast(hot), spark.sparkContext.broadcast(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in sliced(batch, 1, BATCH):
                serial += 1
                yield questions(part, (task << 24) + serial)

    def questions(part: pa.RecordBatch, name: int) -> pa.RecordBatch:
        tokens, before, _ = _tokens(part.column(1))
        unique = np.unique(tokens)
        whole = io.BytesIO()
        with pa.ipc.new_stream(whole, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
            sink.write_batch(part)
        anywhere = name * 0x9E3779B97F4A7C15 % 2**64 >> (64 - bits)  # texts pass through some bucket, each through another
        out = [(anywhere, name, _TEXTS, whole.getvalue())]
        rare = unique[_counts_of(unique, *hot_sent.value) == 0]
        out += [(bucket, name, _TOKENS, _pack(rare[s])) for bucket, s in _runs(rare, bits)]
        if parts_sent.value is None:
            grams, _ = _asked(before, tokens, bits)
            out += [(bucket, name, _PAIRS, _pack(grams[s] & _LOW)) for bucket, s in _runs(grams, bits, 32 + bits)]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "name", "kind", "data"]
        )

    def answered(held: list[tuple[int, int, bytes]], bucket: int, knows: tuple) -> pa.RecordBatch:
        """Messages (name, kind, data) to a bucket with their answers; those of a kind are looked up at once."""
        keys, counts, lookup = knows
        out = [x for x in held if x[1] == _TEXTS]
        for what in (_TOKENS, _PAIRS):
            asked = [(name, _unpack(data)[0]) for name, k, data in held if k == what]
            if asked:
                every = np.concatenate([x for _, x in asked])
                got = _counts_of(every, keys, counts) if what == _TOKENS else lookup.levels(every + (np.uint64(bucket) << np.uint64(32)))
                pieces = np.split(got, np.cumsum([len(x) for _, x in asked])[:-1])
                out += [(name, what, _pack(keys[:0], x) if what == _TOKENS else x.tobytes()) for (name, _), x in zip(asked, pieces, strict=True)]
        names, kinds, data = (pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary())))
        return pa.RecordBatch.from_arrays([names, kinds, pa.array([bucket] * len(out), pa.int32()), data], ["name", "kind", "bucket", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint64), Filter(b"", {}, bits)
        now, knows, held, size = None, nothing, [], 0
        for batch in batches:
            for bucket, name, what, data in zip(*batch.columns, strict=True):
                bucket, what, data = bucket.as_py(), what.as_py(), data.as_py()
                if held and (bucket != now or size > BATCH):
                    yield answered(held, now, knows)
                    held, size = [], 0
                if bucket != now:
                    now, knows = bucket, nothing
                if what < 0:
                    n = int.from_bytes(data[:8], "little")
                    knows = *_unpack(data[8 : 8 + n]), Filter(data[8 + n :], {bucket: len(data) - 8 - n}, bits)
                else:
                    held.append((name.as_py(), what, data))
                    size += len(data)
        if held:
            yield answered(held, now, knows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Filter(*parts_sent.value, bits) if parts_sent.value is not None else None
        for _, got in _by_key(batches, "name"):
            # answers come in the order of buckets, which is that of hashes
            answers = {what: [d for k, d in zip(got["kind"], got["data"], strict=True) if k == what] for what in (_TOKENS, _PAIRS)}
            texts = pa.ipc.open_stream(got["data"][0]).read_all().combine_chunks()
            tokens, before, n = _tokens(texts.column(1).combine_chunks())
            row = np.repeat(np.arange(len(n)), n)
            unique, at = np.unique(tokens, return_inverse=True)
            exact = _counts_of(unique, *hot_sent.value)
            exact[exact == 0] = np.concatenate([*(_unpack(d)[1] for d in answers[_TOKENS]), np.zeros(0, np.uint64)]).astype(np.int64)
            c = exact[at]
            known = np.bincount(row, c > 0, len(n)).astype(np.int64)
            logs = np.bincount(row, np.log10(c + 1.0), len(n)) - n * np.log10(totals.tokens + totals.types + 1.0)
            grams, at_pair = _asked(before, tokens, bits)
            levels = lookup.levels(grams) if lookup else np.frombuffer(b"".join(answers[_PAIRS]), np.uint8)
            scores = totals.scores(n, c, levels[at_pair])
            columns = [texts.column(0).combine_chunks().cast(id_type), *map(pa.array, (n, known, np.full(len(n), totals.tokens), logs, scores))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    data = F.col("counts") if parts is not None else F.concat("counts", "filter")
    size = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(F.length("counts").cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(8))))
    knows = lm.select("bucket", F.lit(0).cast("long").alias("name"), F.lit(-1).alias("kind"), F.concat(size, data).alias("data"))
    sent = rows.mapInArrow(tidy(deal), "bucket int, name long, kind int, data binary").unionByName(knows)
    answers = sent.repartition(1 << bits, "bucket").sortWithinPartitions("bucket", "kind", "name").mapInArrow(
        tidy(meet), "name long, kind int, bucket int, data binary"
    )
    answers = answers.repartition(max(partitions(spark), 1 << bits), "name").sortWithinPartitions("name", "kind", "bucket")
    return answers.mapInArrow(tidy(finish), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """Scores of all rows by the model of those whose crc32(doc_id as text) mod parts is not held."""
    train = crc_mod("doc_id", parts) != held
    return score(docs, train).select(
        "doc_id", (crc_mod("doc_id", parts) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
