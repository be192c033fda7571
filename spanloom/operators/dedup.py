"""Entity resolution: matchers by name, vector and meaning, their cascade, and the ingest pipeline around them.

New entities meet stored ones of their class by equi-joins on keys that matching ones share; each matcher scores pairs
and keeps the best of each new entity. A cascade hands on only what the matchers before it left.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answer_json, jaccard_sets, tokens
from ..sources.shared import small, work_dir, written

#: Tokens of more stored names (of match(): different ones) of a class come last among a name's keys.
HOT_TOKEN = 1000
#: Vectors and bytes of them in a block, at most about, and stored vectors below which a block is not parted for more tasks.
FEW_VECTORS, BLOCK_BYTES, FEW_ROWS = 50_000, 32_000_000, 1_000
#: Vectors in a block where all pairs are asked for, which may be all of the block's.
PAIRED = 4_000
#: Vectors of a tile of a block's matrix product.
TILE = 2_048


class Matcher(Protocol):
    """A layer: pairs (id, cand, cand_seq, score) that reach its threshold, and the best of each new entity."""

    threshold: float
    layer: str

    def pairs(self, new: DataFrame, pool: DataFrame) -> DataFrame: ...

    def match(self, new: DataFrame, pool: DataFrame) -> DataFrame: ...


def candidates(pool: DataFrame) -> DataFrame:
    """Stored entities once for each class that names them, so that either class column meets an equi-join."""
    one, other = F.col("entityType"), F.col("ontologyClass")
    kinds = F.when(other.isNull() | (one == other), F.array(one)).when(one.isNull(), F.array(other)).otherwise(F.array(one, other))
    return pool.where(one.isNotNull() | other.isNotNull()).withColumn("_class", F.explode(kinds))


def class_of() -> Column:
    return F.coalesce("ontologyClass", "entityType")


class _Best:
    """match() of matchers that have pairs(), or fewer that hold the best of each new entity."""

    def best(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        return self.pairs(new, pool)

    def match(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        """(id, layer, match, confidence): the best candidate of each new entity, the first stored one of several."""
        top = self.best(new, pool).groupBy("id").agg(F.max_by(F.struct("cand", "score"), F.struct("score", -F.col("cand_seq"))).alias("t"))
        return top.select("id", F.lit(self.layer).alias("layer"), F.col("t.cand").alias("match"), F.col("t.score").alias("confidence"))


@dataclass
class NameMatcher(_Best):
    """Jaccard similarity of the names' tokens. Two sets of this similarity share one of the first few tokens of
    either, in any order that both follow; those of many stored names come last in it, so keys are rare. match() splits
    different names only and compares different sets only, so copies of a name cost nothing."""

    threshold: float = 0.85
    layer: str = "name"

    def pairs(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        return self._met(*self._sides(new, pool), ["id", "cand"]).select("id", "cand", "cand_seq", "score")

    def best(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        """Of new entities with one set of tokens in a class one is compared, and of stored ones the first."""
        name, words = F.coalesce("name", F.lit("")).alias("_name"), F.array_sort(tokens("_name"))
        a, at = new.select("id", class_of().alias("_class"), name), work_dir(new.sparkSession)
        # written, as one distinct() over another would split the names of all rows
        names = written(a.select("_class", "_name").distinct().withColumn("ta", words), f"{at}/names")
        first = F.min(F.struct(F.col("seq").isNull().alias("none"), F.col("seq").alias("cand_seq"), F.col("id").alias("cand"))).alias("first")
        b = candidates(pool).groupBy("_class", name).agg(first).groupBy("_class", words.alias("tb")).agg(F.min("first").alias("first"))
        b = written(b.select("_class", "tb", "first.cand", "first.cand_seq"), f"{at}/sets")
        met = self._met(names.select("_class", "ta").distinct(), b, [])
        top = F.max_by(F.struct("cand", "cand_seq", "score"), F.struct("score", -F.col("cand_seq"))).alias("t")
        found = names.join(met.groupBy("_class", "ta").agg(top), ["_class", "ta"]).select("_class", "_name", "t")
        return a.join(found, ["_class", "_name"]).select("id", "t.cand", "t.cand_seq", "t.score")

    def _sides(self, new: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
        a = new.select("id", class_of().alias("_class"), tokens("name").alias("ta"))
        return a, candidates(pool).select(F.col("id").alias("cand"), F.col("seq").alias("cand_seq"), "_class", tokens("name").alias("tb"))

    def _met(self, a: DataFrame, b: DataFrame, unique: list[str]) -> DataFrame:
        """Pairs of sets that reach the threshold, with their score and what else the two sides have, once for each of the columns ``unique``, if any."""
        if self.threshold > 0:
            often = b.select("_class", F.explode("tb").alias("token")).groupBy("_class", "token").agg(F.count(F.lit(1)).alias("n"))
            often = often.where(F.col("n") > HOT_TOKEN).groupBy("_class").agg(F.sort_array(F.collect_list("token")).alias("often"))
            often = small(written(often, f"{work_dir(b.sparkSession)}/often"))

            def keyed(rows: DataFrame, of: str) -> DataFrame:
                rows = rows.join(often, "_class", "left").withColumn("often", F.coalesce("often", F.array().cast("array<string>")))
                # by hash, so that no letter is favoured
                mixed = lambda t: F.transform(F.array_sort(F.transform(t, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: s["x"])
                order = F.concat(mixed(F.array_except(of, "often")), mixed(F.array_intersect(of, "often")))
                needed = F.ceil(F.size(of) * F.lit(self.threshold) - 1e-9).cast("int")  # of this set's tokens, shared at least
                return rows.withColumn("key", F.explode(F.slice(order, F.lit(1), F.size(of) - needed + 1))).drop("often")

            pairs = keyed(a, "ta").join(keyed(b, "tb"), ["_class", "key"])
            size_a, size_b = F.size("ta"), F.size("tb")
            pairs = pairs.where(F.least(size_a, size_b) >= F.greatest(size_a, size_b) * self.threshold - 1e-9)
        else:
            pairs = a.join(b, "_class")
        pairs = pairs.withColumn("score", jaccard_sets(F.col("ta"), F.col("tb"))).where(F.col("score") >= self.threshold)
        return pairs.dropDuplicates(unique) if unique else pairs


@dataclass
class EmbeddingMatcher(_Best):
    """Cosine similarity of vectors. embed gives a text's vector as a Column; by default the stored vector is used.

    Every new vector of a class meets every stored one, so no pair is missed: both sides are dealt into blocks of at most about
    ``few`` vectors and BLOCK_BYTES, and each pair of blocks is one matrix product. What comes near the threshold (of
    match(), near a block's best) is scored again as ``cosine`` does.
    """

    threshold: float = 0.90
    embed: Callable[[Column], Column] | None = None
    layer: str = "embedding"
    text: Column | None = None
    few: int = FEW_VECTORS

    def vector(self) -> Column:
        text = F.trim(F.concat_ws("\n\n", "name", "description")) if self.text is None else self.text
        return self.embed(text) if self.embed else F.col("embedding")

    def pairs(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        return self._scored(new, pool, False).dropDuplicates(["id", "cand"])

    def best(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        return self._scored(new, pool, True)

    def _scored(self, new: DataFrame, pool: DataFrame, best: bool) -> DataFrame:
        a = new.select("id", class_of().alias("_class"), self.vector().alias("v"))
        b = candidates(pool.withColumn("v", self.vector())).select("id", "seq", "_class", "v")
        size = lambda rows, n: rows.groupBy("_class").agg(F.count(F.lit(1)).alias(n), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias(f"{n}_v"))
        few = self.few if best else min(self.few, PAIRED)
        least = lambda n: F.greatest(F.ceil(F.col(n) / few), F.ceil(F.col(f"{n}_v") * 8 / BLOCK_BYTES))
        # more blocks of stored vectors, for more tasks, as long as new ones are repeated by less than half of all rows
        more = F.least(F.floor((F.col("na") + F.col("nb")) / (2 * F.col("na"))), F.ceil(F.col("nb") / FEW_ROWS))
        sizes = small(size(a, "na").join(size(b, "nb"), "_class").select("_class", least("na").alias("rows"), F.greatest(least("nb"), more).alias("cols")))
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        a = a.join(sizes, "_class").select("_class", part("rows").alias("i"), every("cols").alias("j"), F.col("id").alias("new"), "v")
        b = b.join(sizes, "_class").select("_class", every("rows").alias("i"), part("cols").alias("j"), F.col("id").alias("cand"), F.col("seq").alias("cand_seq"), "v")
        met = a.groupBy("_class", "i", "j").cogroup(b.groupBy("_class", "i", "j"))
        return met.applyInArrow(_met(self.threshold, best), "id string, cand string, cand_seq long, score double")


def _met(threshold: float, best: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(id, cand, cand_seq, score) of two blocks: all that reach the threshold, or the best of each new vector."""

    def run(new: pa.Table, stored: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(new) and len(stored):
            seqs = stored["cand_seq"].fill_null(0).to_numpy()
            for (at, x, hole_x), (to, y, hole_y) in product(_by_length(new), _by_length(stored)):
                k = min(x.shape[1], y.shape[1])  # a missing element of the common prefix makes a score of 0
                x_k, y_k = (np.where(hole[:, :k].any(1)[:, None], 0.0, z[:, :k]) for z, hole in ((x, hole_x), (y, hole_y)))
                found += [(at[r], to[c], s) for r, c, s in _near(x_k, y_k, seqs[to], threshold, best)]
        r, c, s = map(np.concatenate, zip(*found, strict=True))
        if best and len(r):
            order = np.lexsort((c, seqs[c], -np.where(np.isnan(s), np.inf, s), r))
            first = order[np.concatenate(([True], np.diff(r[order]) > 0))]
            r, c, s = r[first], c[first], s[first]
        cols = [new["new"].take(pa.array(r)), stored["cand"].take(pa.array(c)), stored["cand_seq"].take(pa.array(c)), pa.array(s)]
        return pa.table(cols, names=["id", "cand", "cand_seq", "score"])

    return run


def _by_length(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, matrix and missing elements of the vectors of each length; a missing vector has none."""
    lengths = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in t["v"].chunks])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = pc.list_flatten(t["v"].take(pa.array(at))).combine_chunks().cast(pa.float64()) if n else pa.array([], pa.float64())
        hole = flat.is_null().to_numpy(zero_copy_only=False)
        yield at, flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(at), n), hole.reshape(len(at), n)


def _near(x: np.ndarray, y: np.ndarray, seq: np.ndarray, threshold: float, best: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x and of y, and scores, of what reaches the threshold; with best, of the best of each row of x at least."""
    size_x, size_y = (np.abs(z).max(1, initial=0.0) for z in (x, y))
    rows = np.flatnonzero((size_x != 0) | (threshold <= 0))  # a vector of zeros scores 0
    cols = np.flatnonzero((size_y != 0) | (threshold <= 0))
    if best and x.shape[1] and len(cols):  # of equal vectors the first stored one stands for all
        cols = cols[np.lexsort((cols, seq[cols]))]
        same = np.ascontiguousarray(y[cols] + 0.0).view(np.dtype((np.void, y.shape[1] * 8))).ravel()
        cols = cols[np.unique(same, return_index=True)[1]]
    plain = lambda size: (size > 1e-70) & (size < 1e70)  # noqa: E731  squares neither vanish nor overflow
    odd_rows, odd_cols = rows[~plain(size_x[rows])], cols[~plain(size_y[cols])]
    for some, others in ((odd_rows, cols), (np.setdiff1d(rows, odd_rows), odd_cols)):
        for i in range(0, len(some) if len(others) else 0, step := max(1, 1_000_000 // max(len(others), 1))):
            part = some[i : i + step]
            yield from _exact(x, y, np.repeat(part, len(others)), np.tile(others, len(part)), threshold)
    rows, cols = np.setdiff1d(rows, odd_rows), np.setdiff1d(cols, odd_cols)
    u, w = (_unit(z[k] / size[k, None]) for z, k, size in ((x, rows, size_x), (y, cols, size_y)))
    slack = np.float32(4e-6 + 2e-7 * x.shape[1])  # rounding of a product of single precision is below
    for i in range(0, len(rows), TILE):
        least = np.full(len(u[i : i + TILE]), threshold - slack, np.float32)
        for j in range(0, len(cols), TILE):
            s = u[i : i + TILE] @ w[j : j + TILE].T
            if best:
                least = np.maximum(least, (top := s.max(1)) - 2 * slack)
                some = np.flatnonzero(top >= least)
                r, c = np.nonzero(s[some] >= least[some, None])
                r = some[r]
            else:
                r, c = np.nonzero(s >= least[:, None])
            yield from _exact(x, y, rows[i + r], cols[j + c], threshold)


def _unit(z: np.ndarray) -> np.ndarray:
    return (z / np.linalg.norm(z, axis=1)[:, None]).astype(np.float32)


def _exact(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of pairs, summed from the first element to the last as ``cosine`` does; not a number counts as the largest."""
    for i in range(0, len(r), step := max(1, 1_000_000 // max(x.shape[1], 1))):
        ri, ci = r[i : i + step], c[i : i + step]
        a, b, s = x[ri], y[ci], np.zeros(len(ri))
        if x.shape[1]:
            with np.errstate(all="ignore"):
                dot, na, nb = (np.cumsum(p, 1)[:, -1] for p in (a * b, a * a, b * b))
                s = np.where((na == 0) | (nb == 0), 0.0, dot / np.sqrt(na * nb))
        ok = (s >= threshold) | np.isnan(s)
        yield ri[ok], ci[ok], s[ok]


class UnreadableAnswer(ValueError):
    """An answer that holds JSON which cannot be read."""


@dataclass
class SemanticMatcher(_Best):
    """Asks a client which candidate is the same; the confidence of a match is the threshold itself.

    ask(prompt) returns the model's answer: {"matches": [{"newName": ..., "existingName": ...}]}, or {"match": name}. An
    answer that cannot be read, an error, or no answer within ``timeout`` seconds is no match, or an error if on_error is
    'raise'. The names of a class come ``per_prompt`` at a time, so a class of any size is asked about whole.
    """

    ask: Callable[[str], str]
    threshold: float = 0.70
    on_error: str = "skip"
    layer: str = "semantic"
    timeout: float = 60.0
    per_prompt: int = 500

    def prompt(self, kind: str, name: str, description: str | None, known: list[str]) -> str:
        told = f" ({description})" if description else ""
        return (
            f"All names below are of the class {json.dumps(kind, ensure_ascii=False)}. New: {json.dumps([name], ensure_ascii=False)}{told}\n"
            f"Known: {json.dumps(known, ensure_ascii=False)}\nWhich known one means the same thing as the new one, if any? Name it only if you are sure. "
            'Answer with JSON: {"matches": [{"newName": "...", "existingName": "..."}]}, the list empty if there is none.'
        )

    def named(self, answer: str, name: str) -> str | None:
        """The candidate that an answer names."""
        if "{" not in answer:
            return None
        said = answer_json(answer)
        if not isinstance(said, dict):
            raise UnreadableAnswer(f"no JSON in {answer[:200]!r}")
        listed = said.get("matches")
        found = [m.get("existingName") for m in listed if isinstance(m, dict) and m.get("newName") == name] if isinstance(listed, list) else []
        return found[0] if found else said.get("match")

    def pairs(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        me = self
        # per_prompt names each, dealt by a hash: chunks are of about that size
        stored = candidates(pool).select("_class", "seq", "id", "name")
        sizes = small(stored.groupBy("_class").agg(F.ceil(F.count(F.lit(1)) / self.per_prompt).alias("chunks")))
        dealt = stored.join(sizes, "_class").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
        names = dealt.groupBy("_class", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "name"))).alias("cands"))
        rows = new.select("id", "name", "description", class_of().alias("_class")).join(names, "_class").select("id", "name", "description", "_class", "cands")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(1) as asking:
                for batch in batches:
                    found = []
                    for r in batch.itertuples(index=False):
                        cands = [c for c in r.cands if c["id"] != r.id]
                        if not cands:
                            continue
                        try:
                            answer = asking.submit(me.ask, me.prompt(r[3], r.name, r.description, [c["name"] for c in cands])).result(me.timeout)
                            wanted = me.named(answer, r.name)
                        except Exception:
                            if me.on_error == "raise":
                                raise
                            continue
                        hit = next((c for c in cands if c["name"] == wanted), None)
                        if hit is not None:
                            found.append((r.id, hit["id"], hit["seq"], me.threshold))
                    yield pd.DataFrame(found, columns=["id", "cand", "cand_seq", "score"])

        return rows.mapInPandas(run, "id string, cand string, cand_seq long, score double")


@dataclass
class LayeredDeduplicator:
    """Matchers in order. With short_circuit what one resolves is not seen by the next, and is written to the shared
    folder, so that no layer runs again for those after it; without, all are asked and the first that matched decides."""

    layers: list = field(default_factory=list)
    short_circuit: bool = True

    def results(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        """(id, layer, match, confidence, layer_ord) of every layer that was asked and matched."""
        out, rest = None, new
        for k, layer in enumerate(self.layers):
            found = layer.match(rest, pool).withColumn("layer_ord", F.lit(k))
            if self.short_circuit and k + 1 < len(self.layers):
                found = written(found, f"{work_dir(new.sparkSession)}/{k}")
            out = found if out is None else out.unionByName(found)
            if self.short_circuit:
                rest = rest.join(found.select("id"), "id", "left_anti")
        return out

    def dedup(self, new: DataFrame, pool: DataFrame) -> DataFrame:
        """One row a new entity: its decision, or nulls; an entity without a class is never matched."""
        first = self.results(new.where(class_of().isNotNull()), pool).groupBy("id").agg(
            F.min_by(F.struct("layer", "match", "confidence"), "layer_ord").alias("d")
        )
        return new.select("id", "seq", class_of().isNull().alias("unclassified")).join(first, "id", "left").select(
            "id", "seq", "unclassified", F.col("d.layer").alias("layer"), F.col("d.match").alias("match"), F.col("d.confidence").alias("confidence")
        )


@dataclass
class Ingested:
    """The tables after an ingest, its decisions, the new entities that were refused and why, counts, and seconds by stage."""

    entities: DataFrame
    relations: DataFrame
    decisions: DataFrame
    errors: DataFrame
    counts: DataFrame
    seconds: dict[str, float]
    skipped: tuple[str, ...]


STAGES = ("extract", "dedup", "store", "synthesize")


@dataclass
class IngestPipeline:
    """extract -> dedup -> store -> synthesize; any of the stages may be skipped, or run alone by run_stage.

    store(new, entities, provenance) puts entities, with supersedes set where one matched. on_phase hears of each stage at its start
    and end. Provenance is the caller's; the pipeline makes none up.
    """

    extract: Callable[[DataFrame], DataFrame]
    deduplicator: LayeredDeduplicator
    store: Callable[[DataFrame, DataFrame, Column], tuple[DataFrame, DataFrame]]
    synthesize: Callable[[DataFrame], None] | None = None
    on_phase: Callable[[str, str], None] | None = None

    def _timed(self, stage: str, seconds: dict[str, float], work: Callable[[], object]) -> object:
        if self.on_phase:
            self.on_phase(stage, "start")
        began = time.perf_counter()
        out = work()
        seconds[stage] = time.perf_counter() - began
        if self.on_phase:
            self.on_phase(stage, "done")
        return out

    def ingest(self, texts: DataFrame, entities: DataFrame, relations: DataFrame, provenance: Column, skip: tuple[str, ...] = ()) -> Ingested:
        """All of a batch is compared with what was stored before it; of several new entities that match one stored
        entity the first, by seq, supersedes it, and the others are refused: an entity has one successor."""
        if provenance is None:
            raise ValueError("an ingest needs provenance")
        if set(skip) - set(STAGES):
            raise ValueError(f"no such stage: {', '.join(sorted(set(skip) - set(STAGES)))}")
        if "extract" in skip and not texts.isEmpty():
            raise ValueError("texts that are not to be extracted: use run_stage for a stage by itself")
        seconds: dict[str, float] = {}
        new = entities.limit(0) if "extract" in skip else self._timed("extract", seconds, lambda: self.extract(texts))
        if "dedup" in skip:
            nothing = (F.lit(None).cast(t).alias(c) for c, t in (("layer", "string"), ("match", "string"), ("confidence", "double")))
            decided = new.select("id", "seq", F.lit(False).alias("unclassified"), *nothing)
        else:
            decided = self._timed("dedup", seconds, lambda: self.deduplicator.dedup(new, entities))
        first = decided.where("match is not null").groupBy("match").agg(F.min_by("id", "seq").alias("id")).select("id", F.col("match").alias("_old"))
        late = decided.where("match is not null").join(first.select("id"), "id", "left_anti")
        errors = late.select("id", F.concat(F.col("match"), F.lit(" has a successor in this batch")).alias("error"))
        if "store" not in skip:
            stamped = new.join(late.select("id"), "id", "left_anti").join(first, "id", "left").withColumn(
                "supersedes", F.coalesce("_old", "supersedes")
            ).drop("_old")
            entities, relations = self._timed("store", seconds, lambda: self.store(stamped, entities, provenance))
        if self.synthesize and "synthesize" not in skip:
            survivors = decided.where("match is not null").select(F.col("match").alias("id")).distinct()
            self._timed("synthesize", seconds, lambda: self.synthesize(survivors))
        counts = decided.agg(F.count(F.lit(1)).alias("extracted"), F.count("match").alias("merged"))
        stored = F.lit(0) if "store" in skip else F.col("extracted") - F.col("refused")
        counts = counts.crossJoin(errors.agg(F.count(F.lit(1)).alias("refused"))).withColumn("stored", stored)
        return Ingested(entities, relations, decided, errors, counts, seconds, tuple(skip))

    def run_stage(self, name: str, rows: DataFrame, entities: DataFrame | None = None, provenance: Column | None = None, supersedes: DataFrame | None = None):
        """One stage by itself: extract of texts, dedup of entities against a pool, store of entities (with pairs (id,
        supersedes), if given), synthesize of ids. No phase is told."""
        if name == "extract":
            return self.extract(rows)
        if name == "dedup":
            if entities is None:
                raise ValueError("dedup needs the stored entities to compare with")
            return self.deduplicator.dedup(rows, entities)
        if name not in STAGES:
            raise ValueError(f"no such stage: {name}")
        if provenance is None:
            raise ValueError(f"{name} needs provenance")
        if name == "store":
            if supersedes is not None:
                rows = rows.drop("supersedes").join(supersedes.select("id", "supersedes"), "id", "left")
            return self.store(rows, entities, provenance)
        return self.synthesize(rows) if self.synthesize else None
