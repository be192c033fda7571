"""Document fingerprints by consistent weighted sampling.

The weighted set of a text holds its words and its pairs of adjacent words (A-Z as a-z), each weighted by
how often it occurs. For each of SAMPLES positions every term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1); with
t = floor(ln w / r + b) its value is ln c - r (t - b) - r, and the term of the least value, with its t, is
the sample. Two texts agree at a position with probability sum(min) / sum(max) of their weights.

The draws of a term come from the row of a fixed table that 16 bits of its hash name; terms of one row are
ordered by 32 other bits, so the order of any two terms stays random and the same in every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions, row_of, text_buffer, tidy, word_hashes

SAMPLES, ROWS, SEED = 64, 1 << 16, 20240307
_LOW32 = np.uint64(0xFFFFFFFF)
_NO_ID = -(2**63)
_tables: dict[str, np.ndarray] = {}


def _draws() -> dict[str, np.ndarray]:
    if not _tables:
        rng = np.random.default_rng(SEED)
        r = rng.gamma(2.0, 1.0, (ROWS, SAMPLES)).astype(np.float32)
        c = np.log(rng.gamma(2.0, 1.0, (ROWS, SAMPLES))).astype(np.float32)
        b = rng.random((ROWS, SAMPLES), np.float32)
        _tables.update(r=r, c=c, b=b, one=_ordered(c - r * (0 - b) - r))
    return _tables


def _ordered(value: np.ndarray) -> np.ndarray:
    """Values as the upper 32 bits of an integer of the same order."""
    return np.clip((value.astype(np.float64) + 64) * 2.0**25, 0, 2**32 - 1).astype(np.uint64) << np.uint64(32)


def weighted_terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of the terms of each row, in order, their weights, and where each row begins."""
    words, first = word_hashes(buf, offs)
    row = row_of(first).astype(np.uint64)
    together = np.flatnonzero(row[:-1] == row[1:]) if len(row) else np.zeros(0, np.int64)
    pairs = mix(words[together] * np.uint64(0x9FB21C651E98DF25) + words[together + 1])
    keys = np.concatenate([words, pairs]) >> np.uint64(16)
    keys |= np.concatenate([row, row[together]]) << np.uint64(48)
    keys, weight = np.unique(keys, return_counts=True)
    starts = np.searchsorted(keys >> np.uint64(48), np.arange(len(offs), dtype=np.uint64))
    return keys & np.uint64(2**48 - 1), weight, starts


def signatures(buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """SAMPLES 16-bit samples of each row; empty where a row has no words. At most 60,000 rows a call."""
    table = _draws()
    terms, weight, starts = weighted_terms(buf, offs)
    name, at = terms >> np.uint64(16), (terms & np.uint64(ROWS - 1)).astype(np.int64)
    each, out = np.arange(SAMPLES), []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if a == b:
            out.append(b"")
            continue
        best = np.full(SAMPLES, 2**64 - 1, np.uint64)
        for i in range(a, b, 4096):
            part = slice(i, min(i + 4096, b))
            values = table["one"][at[part]]
            heavy = np.flatnonzero(weight[part] > 1)
            if len(heavy):
                own, w = at[part][heavy], np.log(weight[part][heavy])[:, None]
                r, shift = table["r"][own], table["b"][own]
                values[heavy] = _ordered(table["c"][own] - r * (np.floor(w / r + shift) - shift) - r)
            values |= name[part][:, None]
            np.minimum(best, values.min(axis=0), out=best)
        won = a + np.searchsorted(name[a:b], best & _LOW32)
        row = at[won]
        t = np.floor(np.log(weight[won]) / table["r"][row, each] + table["b"][row, each]).astype(np.int64).astype(np.uint64)
        out.append((mix(terms[won] + (t << np.uint64(48))) & np.uint64(0xFFFF)).astype("<u2").tobytes())
    return out


def likeness(a: bytes | None, b: bytes | None) -> float:
    """Share of equal samples; 1 for two texts without words, 0 if only one has none."""
    if not a or not b:
        return float(not a and not b)
    return float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and fingerprint (hex; '' without words) of each row, computed where the row is read.

    Null and empty texts have the fingerprint ''; repeated rows repeat; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1).to_pylist()
                prints = [x.hex() for x in signatures(*text_buffer(part.column(1)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x or "") for x in texts], pa.int64()), pa.array(prints, pa.string())], ["id", "n_chars", "fingerprint"]
                )

    ids = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return ids.mapInArrow(tidy(run), f"id {ids.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in buckets of adjacent ids, with the first row of the bucket that follows as a guest.

    Bounds are quantiles of the ids; in each bucket the row of the largest id comes first in descending
    order, so it also goes as a guest to the bucket above it (that of the lowest bucket to the top one's
    end, in turn). Of the buckets only their number of largest ids reach the driver.
    """
    spark, n = docs.sparkSession, 4 * partitions(docs.sparkSession)
    key = F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID))
    keyed = docs.select(key.alias("id"), docs[id_col].alias("own"), docs[text_col].alias("text"))
    asked = [i / n for i in range(1, n)]
    bounds = np.unique(np.asarray(keyed.approxQuantile("id", asked, 1 / (8 * n)) or [0.0]).astype(np.int64))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(bounds, ids, "right")
            for k in np.unique(at):
                most[int(k)] = max(most.get(int(k), _NO_ID), int(ids[at == k].max()))
        yield pa.RecordBatch.from_arrays([pa.array(most.keys(), pa.int32()), pa.array(most.values(), pa.int64())], ["bucket", "top"])

    found = keyed.select("id").mapInArrow(tidy(tops), "bucket int, top long").groupBy("bucket").agg(F.max("top").alias("top")).orderBy("bucket").collect()
    above = {r["top"]: found[(i + 1) % len(found)]["bucket"] for i, r in enumerate(found)}
    firsts = np.asarray(sorted(above), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(bounds, ids, "right").astype(np.int32)
            yield _with(batch, at, np.zeros(len(ids), bool))
            guests = np.flatnonzero(np.isin(ids, firsts))
            if len(guests):
                yield _with(batch.take(pa.array(guests)), np.asarray([above[int(i)] for i in ids[guests]], np.int32), np.ones(len(guests), bool))

    def _with(batch: pa.RecordBatch, at: np.ndarray, guest: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(guest), *batch.columns], ["bucket", "guest", "id", "own", "text"])

    kind = keyed.schema["own"].dataType.simpleString()
    dealt = keyed.mapInArrow(tidy(deal), f"bucket int, guest boolean, id long, own {kind}, text string")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), "text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next row.

    Rows follow one another by descending id (equal ids by text, null ids last; after the last the first).
    The edited text replaces the last floor(n_chars / 3) code points by the first as many (or all) of the
    next text. Null texts count as empty; a single row follows itself; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in _slices(batch, 1000):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                yield described(part)
                held = part.slice(part.num_rows - 1)

    def described(part: pa.RecordBatch) -> pa.RecordBatch:
        bucket, guest = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
        texts = [x or "" for x in part.column(4).to_pylist()]
        use = np.flatnonzero((bucket[:-1] == bucket[1:]) & ~guest[:-1])
        edited = []
        for i in use:
            n = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - n] + texts[i + 1][:n])
        prints = signatures(*text_buffer(part.column(4)))
        new = signatures(*text_buffer(pa.array(edited, pa.large_string())))
        return pa.RecordBatch.from_arrays(
            [
                part.column(3).take(pa.array(use)),
                pa.array([len(texts[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
                pa.array([prints[i].hex() for i in use], pa.string()),
                pa.array([x.hex() for x in new], pa.string()),
                pa.array([likeness(prints[i], x) for i, x in zip(use, new, strict=True)], pa.float64()),
                pa.array([likeness(prints[i], prints[i + 1]) for i in use], pa.float64()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    out = _bucketed(docs, id_col, text_col).mapInArrow(
        tidy(run), f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("id", id_col)
