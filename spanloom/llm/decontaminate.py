"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A text's fingerprints are the least hashes of each WINDOW successive K-grams of words, so two texts that share
SPAN = WINDOW + K - 1 words share a fingerprint. Documents whose fingerprints meet the benchmark's are
candidates; in these every hit is extended: all their spans are compared with the benchmark's, word for word.
Items of fewer than SPAN words are one window of their own length, and meet the documents' runs of that length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small, work_dir

K, WINDOW = 5, 9
SPAN = K + WINDOW - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where an inner lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z as a-z; none of a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _less(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _pairwise(values: Column, by: int, body: Callable[[Column, Column], Column]) -> Column:
    """body of each element and the one ``by`` places after it; the last ones meet null."""
    return _let(values, lambda v: F.zip_with(v, F.slice(v, by + 1, F.size(v)), body))


def fingerprints(words: Column) -> Column:
    """Distinct least hashes of the windows of a text of at least SPAN words; none of a shorter one.

    Hashes of K = 5 words and minima of WINDOW = 9 hashes are put together from shifted arrays of 2, 4 (and 8) and one more, so
    the work a word does not follow K or WINDOW, and no slice is made a word.
    """

    def grams(names: Column) -> Column:
        four = _pairwise(_pairwise(names, 1, _hash), 2, _hash)
        return F.slice(F.zip_with(four, F.slice(names, 5, F.size(names)), _hash), 1, F.size(names) - K + 1)

    def least(hashed: Column) -> Column:
        eight = _pairwise(_pairwise(_pairwise(hashed, 1, _less), 2, _less), 4, _less)
        return F.slice(F.zip_with(eight, F.slice(hashed, 9, F.size(hashed)), _less), 1, F.size(hashed) - WINDOW + 1)

    found = _let(_let(F.transform(words, lambda w: F.xxhash64(w)), grams), least)
    return F.when(F.size(words) >= SPAN, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))


def _runs(rows: DataFrame) -> DataFrame:
    """k1, k2, and the runs of ``size`` words: at, run, name (a hash of the run) and size. Rows have words and size."""
    ws = F.col("words")
    run = lambda i: F.struct(i.alias("at"), F.array_join(F.slice(ws, i, F.col("size")), " ").alias("run"))
    every = F.when(F.size(ws) >= F.col("size"), F.transform(F.sequence(F.lit(1), F.size(ws) - F.col("size") + 1), run))
    others = [c for c in rows.columns if c != "words"]
    return rows.select(*others, F.explode(every).alias("w")).select(*others, "w.at", "w.run", F.xxhash64("w.run").alias("name"))


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by its id and text; rows that agree in both have equal results."""
    return [F.xxhash64(docs[id_col]).alias("k1"), F.xxhash64(docs[text_col], docs[id_col]).alias("k2")]


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    bad = hits(docs, bench, id_col, text_col, keys=True).where("contaminated").select("k1", "k2").distinct()
    bad = small(kept(bad, f"{work_dir(docs.sparkSession)}/bad"))
    one, two = _key(docs, id_col, text_col)
    return docs.join(bad, (one == bad["k1"]) & (two == bad["k2"]), "left_anti")


def hits(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keys: bool = False
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256 and contaminated (and k1, k2 of _key if keys).

    A null text has no words; items without words and null items meet nothing; repeated rows of docs get
    equal results; an item id that repeats counts once; null item ids are left out of the list of items, as
    their windows hit but name no item; an empty table gives no rows; other columns are ignored. Tables of ids and hashes of few rows, which
    are counted, are broadcast; larger ones are joined by shuffling, where Spark splits a run that very many documents hold.
    """
    path = work_dir(docs.sparkSession)
    items = bench.select(bench[item_col].alias("item"), words_of(bench[item_text]).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(SPAN)))
    of_items = kept(_runs(items).select("item", "size", "run", "name").distinct(), f"{path}/items")
    windows = small(kept(of_items.select("size", "run", "name").distinct(), f"{path}/windows"))
    marks = small(kept(items.where(F.size("words") >= SPAN).select(F.explode(fingerprints(F.col("words"))).alias("mark")).distinct(), f"{path}/marks"))
    short = sorted(r["size"] for r in of_items.where(F.col("size") < SPAN).select("size").distinct().collect())  # SPAN - 1 at most

    text = docs[text_col]
    split = docs.select(docs[id_col].alias("id"), *_key(docs, id_col, text_col), words_of(text).alias("words"))
    base = kept(split.select("id", "k1", "k2", F.size("words").cast("long").alias("n_words"), fingerprints(F.col("words")).alias("marks")), f"{path}/base")
    found = base.select("k1", "k2", F.explode("marks").alias("mark")).join(marks, "mark", "left_semi").select("k1", "k2")
    found = kept(found.distinct(), f"{path}/found")
    split = split.select("k1", "k2", "words")
    parts = []
    if found.head(1):
        parts.append(split.join(small(found), ["k1", "k2"], "left_semi").withColumn("size", F.lit(SPAN)))
    if short:  # all sizes of short items in one pass over the documents
        parts.append(split.withColumn("size", F.explode(F.array(*map(F.lit, short)))))
    of_docs = None
    for rows in parts:
        met = _runs(rows).join(windows, ["name", "size", "run"]).select("k1", "k2", "at", "size", "run").distinct()
        of_docs = met if of_docs is None else of_docs.unionByName(met)
    if of_docs is None:
        out = base.select("id", "k1", "k2", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"))
    else:
        met = kept(of_docs, f"{path}/met")
        spans = met.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("past")))).alias("spans"))
        hit = F.aggregate(
            "spans",
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("past")),
            lambda a, s: F.struct((a.n + F.greatest(s.past - F.greatest(s["at"], a.past), F.lit(0))).alias("n"), F.greatest(s.past, a.past).alias("past")),
            lambda a: a.n,
        )
        named = met.select("k1", "k2", "size", "run").distinct().join(of_items, ["size", "run"]).select(
            "k1", "k2", F.col("item").cast("string").alias("item")
        ).distinct()
        named = named.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
        each = spans.select("k1", "k2", hit.cast("long").alias("n_hit")).join(named, ["k1", "k2"])
        out = base.select("id", "k1", "k2", "n_words").join(each, ["k1", "k2"], "left")
        out = out.select(
            "id",
            "k1",
            "k2",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
        )
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *(["k1", "k2"] if keys else []),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(words[a:a + m - 1], ' ') AS run FROM (SELECT item_id, words, least(len(words), 13) AS m, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS a FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, a, m, array_to_string(words[a:a + m - 1], ' ') AS run FROM (SELECT r, words, m, unnest(range(1, len(words) - m + 2)) AS a FROM w, sizes WHERE len(words) >= m)),
hit AS (SELECT r, a, m, run FROM dw WHERE (m, run) IN (SELECT (m, run) FROM iw)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + m)) AS p FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN iw USING (m, run)) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
