"""Models, near-duplicates, mixing and the pipeline against brute force and held-out accuracy."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from spanloom.llm import decontaminate, mixing, near_dup, quality, toxicity
from spanloom.llm.common import WORD, kept, table, work_dir
from spanloom.operators import graph

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = quality.score_held_out(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = toxicity.score_held_out(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    found = Counter((labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels)
    assert found[1, 1] >= 0.85 * (found[1, 1] + found[1, 0]) and found[1, 1] >= 0.95 * (found[1, 1] + found[0, 1])


def kneser_ney(texts, labels):
    """P(word | word before) of both classes, from dictionaries."""
    own, own_pair, free, order = toxicity.OWN, toxicity.OWN_PAIR, toxicity.DISCOUNT, toxicity.ORDER
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOW))
    words, pairs = (Counter(), Counter()), (Counter(), Counter())
    for t, y in zip(texts, labels, strict=True):
        words[y].update(set(split(t)))
        pairs[y].update(set(zip([None, *split(t)], split(t))))

    def grams(word):
        b = [2] * (order - 1) + list(word.encode()) + [3]
        return [tuple(b[i : i + order]) for i in range(len(b) - order + 1)]

    top = [Counter(g for w in words[c] for g in grams(w)) for c in (0, 1)]
    lower, seen = {}, set(top[0]) | set(top[1])
    for k in range(order - 1, 0, -1):
        lower[k] = Counter(g[-k:] for g in seen)
        seen = set(lower[k])

    def smoothed(counts, gram, discount, below):
        around = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not around:
            return below
        return (max(counts[gram] - discount, 0) + sum(min(n, discount) for n in around) * below) / sum(around)

    def spelled(c, word):
        p = 1.0
        for g in grams(word):
            q = 1 / 256
            for k in range(1, order):
                q = smoothed(lower[k], g[-k:], free, q)
            p *= smoothed(top[c], g, own, q)
        return p

    every = set(words[0]) | set(words[1])
    used = sum((w in words[0]) + (w in words[1]) for w in every)

    def p(c, before, word):
        n = (word in words[0]) + (word in words[1])
        shared = (max(n - free, 0) + free * len(every) * spelled(c, word)) / used
        total = sum(words[c].values())
        q = (max(words[c][word] - own, 0) + sum(min(x, own) for x in words[c].values()) * shared) / total
        around = [x for (v, _), x in pairs[c].items() if v == before]
        return (max(pairs[c][before, word] - own_pair, 0) + sum(min(x, own_pair) for x in around) * q) / sum(around) if around else q

    return split, p


def test_toxicity_votes_are_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "OWN_PAIR", 1.5)
    rng = random.Random(8)
    make = lambda y: " ".join(rng.choice(["the", "man", "Manly", "é", "a1"] + ["mad", "madly", "bad"] * y) for _ in range(rng.randint(1, 12)))
    texts = [(make(k % 2), k % 2) for k in range(40)]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    split, p = kneser_ney([t for t, _ in texts], [y for _, y in texts])
    for t in ["the mad man", "Bad MADMAN, the the manly!", "zebra", "", "mad mad mad é"]:
        w = split(t)
        want = [np.log(p(1, v, x)) - np.log(p(0, v, x)) for v, x in zip([None, *w], w)]
        got = model.votes(pa.array([t]))[0]
        assert got == pytest.approx(np.clip(want, -toxicity.VOTE, toxicity.VOTE), abs=1e-4)
        x = model.features(pa.array([t]))[0]
        assert x[1] == pytest.approx(got.mean() if len(w) else 0)
        assert x[3 : 3 + toxicity.TOP] == pytest.approx(
            (sorted({y: g for g, y in sorted(zip(got, w)) if g > 0}.values(), reverse=True) + [0] * toxicity.TOP)[: toxicity.TOP]
        )


def test_quality_scores_are_sums_of_bins():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "a", "fox", "Runs", "%%%", "1"], rng.integers(0, 60))) + "." * (k % 3) for k in range(300)]
    x = quality.features(pa.array(texts))
    model = quality.Model(x, (x[:, 0] > np.median(x[:, 0])).astype(float))
    by_hand = []
    for row in x:
        total = model.base + sum(model.tables[j][sum(c <= row[j] for c in model.cuts[j])] for j in range(len(row)))
        for (i, j), t in zip(model.pairs, model.grids, strict=True):
            total += t[sum(c <= row[i] for c in model.coarse[i]), sum(c <= row[j] for c in model.coarse[j])]
        by_hand.append(1 / (1 + np.exp(-total)))
    assert model.score(pa.array(texts)) == pytest.approx(np.array(by_hand), abs=1e-9)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_ties_at_the_threshold_and_ids_that_repeat(spark, module, label):
    d = spark.createDataFrame([(1, "a b c"), (1, "other words here"), (1, "a b c"), (2, "mad mad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], f"doc_id long, {label} int")
    model = module.fit(d, labels, label)
    scores = sorted((r.doc_id, r.score) for r in module.score(d, model).collect())
    assert len(scores) == 4 and len({s for _, s in scores}) >= 1
    at = scores[0][1]
    assert all(r.predicted == int(r.score >= at) for r in module.score(d, model, at).collect())
    assert [r.predicted for r in module.score(d, model, at).collect() if r.score == at]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_models_of_odd_rows(spark, module, label):
    d = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "x"), (3, ""), (4, "w " * 5000)], "doc_id long, text string").selectExpr(
        "*", "1 AS score", "2 AS predicted"
    )
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.fit(d, none, label)
    assert module.score(d, model).count() == 6 and module.accepted(d, model).columns == d.columns
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, 1), (3, None)], f"doc_id long, {label} int")
    got = module.score(d, module.fit(d, some, label)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert module.score(d.limit(0), model).count() == 0


def test_tables_of_the_additive_model_add_up():
    rng = np.random.default_rng(3)
    x = rng.random((800, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality.Model(x, y)
    assert (0, 1) in model.pairs
    texts = pa.array(["", None, "a", "Some words here.", "%%% $$$"])
    assert np.isfinite(quality.features(texts)).all() and model.score(texts).shape == (5,)


# ---------------------------------------------------------------- near-duplicates


def components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    inverted, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    for v in inverted.values():
        for a in range(len(v)):
            for b in range(a + 1, len(v)):
                shared[v[a], v[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)}


def check(spark, d, width=4):
    want = components([tuple(r) for r in d.select("doc_id", "text").collect()], width, 80)
    got = near_dup.near_duplicates(d, width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_documents(spark):
    check(spark, table(spark, "/root/testdata/sf0.001", "documents"))


def edited(rng, base, most, own):
    """base with up to most words replaced by words of its own."""
    w = list(base)
    for at in rng.sample(range(len(base)), most):
        w[at] = own
    return w


@pytest.mark.parametrize("rare", [256, 8])
def test_near_duplicates_of_crowded_regions(spark, monkeypatch, rare):
    monkeypatch.setattr(near_dup, "REGION", 64)
    monkeypatch.setattr(near_dup, "RARE", rare)
    monkeypatch.setattr(near_dup, "BLOCK", 60_000)
    monkeypatch.setattr(graph, "FEW_LINKS", 0)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base, passage, texts = [rng.choice(vocabulary) for _ in range(120)], [rng.choice(vocabulary) for _ in range(60)], []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(w))
        texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(10, 40))]))
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_near_copies_of_one_text_that_are_alike_to_it_only(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "REGION", 64)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(604)]
    texts = [" ".join(edited(rng, base, 10 if k else 0, f"x{k}")) for k in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.component_id for r in near_dup.near_duplicates(d).collect()} == {0}


def test_copies_among_texts_of_one_template(spark, monkeypatch):
    """Each text shares most of its shingles with all others, but is a near copy of one only."""
    monkeypatch.setattr(near_dup, "REGION", 16)
    monkeypatch.setattr(near_dup, "NEAREST", 1)
    rng, texts = random.Random(6), []
    template = [f"t{k}" for k in range(150)]
    for k in range(400):
        w = template + [f"o{k}_{rng.randint(0, 9)}" for _ in range(50)]
        texts += [" ".join(w), " ".join(edited(rng, w, 2, f"x{k}"))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(d).collect()} == {k: k - k % 2 for k in range(800)}


def test_blocks_are_compared_exactly():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(1, 60, 80)]
    got = [r.tolist() for r in near_dup._alike_rows(sets[:30], sets[30:], 60)]
    assert got == [[j for j, y in enumerate(sets[30:]) if near_dup._alike(x, y, 60)] for x in sets[:30]]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, None, 1), (None, "a b", 2), (5, "A  b", 3), (5, "A  b", 3), (6, "", 4), (7, " a b c d e", 4), (7, " a b c d e", 4), (8, "z " * 9000, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = near_dup.near_duplicates(d).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        [
            ("None", 0, "None", True),
            ("None", 1, "5", False),
            ("5", 1, "5", True),
            ("5", 1, "5", True),
            ("6", 0, "6", True),
            ("7", 1, "7", True),
            ("7", 1, "7", True),
            ("8", 1, "8", True),
        ]
    )
    left = near_dup.one_of_each(d)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == ["5", "6", "7", "8", "None"]
    assert near_dup.near_duplicates(d.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if unit * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: unit * weight[s] for s in rest}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {f"s{k}" if k else None: rng.choice([0, 1, 5, 40, 900]) for k in range(rng.randint(2, 9))} | {"t": 7}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == pytest.approx(targets(sizes))


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"s{rng.random()}": rng.choice([1, 3, 50, 7000]) for _ in range(700)} | {"é": 4, "Z": 9, None: 2, "🙂": 5, "\uffee": 5}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(7)
    assert {r.source: r.target for r in mixing.targets(rows).collect()} == pytest.approx(targets(sizes))
    assert mixing.targets(rows.limit(0)).count() == 0


def test_flight_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    size = np.exp(rng.normal(5, 1, 300)).round()
    p = _p = np.full(300, 0.27)
    open_ = mixing._flight(p, size, rng, False)
    assert ((open_ > 0) & (open_ < 1)).sum() <= 2 and open_.sum() == pytest.approx(p.sum()) and (open_ * size).sum() == pytest.approx((p * size).sum())
    mean = np.mean([mixing._flight(_p[:40], size[:40], rng, True) for _ in range(2000)], axis=0)
    assert np.abs(mean - 0.27).max() < 0.05
    assert mixing._flight(np.zeros(0), np.zeros(0), rng, True).size == 0


def test_mixing(spark):
    d = table(spark, SF, "documents")
    sizes = {r.doc_id: (r.source, len(re.findall(WORD, r.text))) for r in d.collect()}
    total = Counter()
    for s, n in sizes.values():
        total[s] += n
    want, got = targets(total), mixing.mix(d).collect()
    taken = Counter()
    for r in got:
        s, n = sizes[r.doc_id]
        assert r.size == n and r.source_size == total[s] and r.target == pytest.approx(want[s]) and r.taken % max(n, 1) == 0 and r.taken <= 3 * n
        taken[s] += r.taken
    assert len(got) == 1000 and all(abs(taken[s] - want[s]) < 0.05 * want[s] + 5 for s in want)
    again = {r.doc_id: r.taken for r in mixing.mix(d.repartition(5), block=mixing.BLOCK).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    odd = spark.createDataFrame(
        [(None, None, None, 1), (None, None, "a b", 1), (1, "x", "a b c", 1), (1, "x", "a b c", 1), (2, "y", "", 1), (2**60 + 1, "z", "q", 1)],
        "doc_id long, source string, text string, size int",
    )
    assert mixing.mix(odd).count() == 6 and mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd).where(f"doc_id = {2**60 + 1}").count() == 1


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    path, docs = work_dir(spark), table(spark, SF, "documents")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, kept(stage(spark, docs, SF), f"{path}/{k}")
        if name != "mixing":
            assert docs.columns == columns and 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            want = components([tuple(r) for r in before.select("doc_id", "text").collect()], 5, 80)
            empty = {i for i, (n, _) in want.items() if n == 0}
            assert {r.doc_id for r in docs.collect()} == {c for _, c in want.values()} | empty
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.hits(before, table(spark, SF, "benchmark")).where("contaminated").collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns and an empty table."""
    long = " ".join(f"w{k % 977} the {k}" for k in range(60_000))
    rows = [
        (1, "The cat sat on the mat and it was good."),
        (1, "The cat sat on the mat and it was good."),
        (2, None),
        (3, ""),
        (None, "A text without an id is a text."),
        (None, None),
        (4, long),
        (5, long + " end"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, key long, node int, words string, fold int"
    made = [(i, t, None, "s" if k % 2 else None, None, "x", 1, 2, "y", 3) for k, (i, t) in enumerate(rows)]
    docs, labels = spark.createDataFrame(made, schema), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, None), (2, "")], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        left = kept(stage(spark, left, str(tmp_path)), f"{work_dir(spark)}/{name}")
        if name != "mixing":
            assert left.columns == docs.columns
        if name in ("toxicity", "quality"):
            assert left.count() == len(rows)
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "None", "None"]
    assert left.count() == 6 and corpus_pipeline.run(spark, str(tmp_path)).count() == 6
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
