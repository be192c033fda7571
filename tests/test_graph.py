"""Operators on small literal graphs, by the semantics of each."""

import datetime
import json
import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom import example
from spanloom import functions as fn
from spanloom.engine import GraphStore, NotFound
from spanloom.operators import dedup, graph, merge, ontology, projections, reads, writes
from spanloom.plans import ENTITIES, RELATIONS, SEGMENT, TOMBSTONES
from spanloom.queries import _shaped
from spanloom.sources import graphs, ontologies, shared
from spanloom.streaming import DebouncedExport, apply_changes, current, latest_changes

NOW = "2024-06-01T00:00:00.000Z"


def stamp():
    return F.struct(*(F.lit(v).alias(k) for k, v in (("provider", "p"), ("model", "m"), ("runId", "r1"), ("timestamp", NOW))))


def uid(k):
    return f"018f0000-0000-7000-8000-{k:012d}"


def entities(spark, *rows):
    """rows: dicts of flat columns."""
    names = sorted({k for r in rows for k in r})
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], ENTITIES).schema}
    df = spark.createDataFrame(
        [tuple(r.get(c) for c in names) for r in rows], ", ".join(f"`{c}` {kinds[c]}" for c in names)
    ) if rows else spark.createDataFrame([], "id string")
    return _shaped(df, ENTITIES)


def relations(spark, *triples):
    rows = [(k, f"k{k}", *t[:3], t[3] if len(t) > 3 else None) for k, t in enumerate(triples)]
    return _shaped(spark.createDataFrame(rows, "seq long, key string, `from` string, type string, `to` string, metadata map<string,string>"), RELATIONS)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_active_is_strict_and_unreadable_ends_are_inactive(spark):
    e = entities(spark, {"id": "a"}, {"id": "b", "validUntil": NOW}, {"id": "c", "validUntil": "2024-06-01T00:00:00.001Z"}, {"id": "d", "validUntil": "soon"})
    assert ids(e.where(fn.is_active(NOW))) == ["a", "c"]


def test_class_is_either_column_but_filter_object_is_both(spark):
    e = entities(spark, {"id": "a", "seq": 1, "entityType": "X"}, {"id": "b", "seq": 2, "entityType": "Y", "ontologyClass": "X"})
    assert ids(reads.find_by_class(e, "X", NOW)) == ["a", "b"]
    assert ids(e.where(reads.matches("Y", "X"))) == ["b"]


def test_query_compares_value_and_kind(spark):
    e = entities(spark, {"id": "a", "seq": 1, "name": "1"}, {"id": "b", "seq": 2, "name": "x"})
    assert ids(reads.query(e, NOW, {"name": "1"})) == ["a"]
    assert ids(reads.query(e, NOW, {"name": 1})) == []
    assert ids(reads.query(e, NOW, {"metadata": "x"})) == []


def test_search_scores_and_limits(spark):
    e = entities(
        spark,
        {"id": "a", "seq": 1, "name": "Foo", "description": "foo", "layer": "evidence", "metadata": {"k": "foo"}},
        {"id": "b", "seq": 2, "name": "x", "description": "a.*b", "layer": "pattern"},
    )
    assert [(r.nodeId, r.score) for r in reads.search(e, "FOO", NOW).collect()] == [("evidence:a", 6)]
    assert [r.score for r in reads.search(e, ".*", NOW).collect()] == [2]
    assert reads.search(e, "", NOW).count() == 0


def test_recent_is_exclusive_and_zero_is_all(spark):
    rows = [{"id": str(k), "seq": k, "entityType": "Observation", "metadata": {"agent": "a", "createdAt": f"2024-01-0{k}"}} for k in (1, 2, 3)]
    e = entities(spark, *rows)
    assert [r.id for r in reads.recent_by_agent(e, "a", "2024-01-01", 0, NOW).collect()] == ["3", "2"]
    assert [r.id for r in reads.recent_by_agent(e, "a", "", 1, NOW).collect()] == ["3"]


def test_wire_packs_stamps_into_metadata(spark):
    s = ("p", "m", "r", "t")
    rows = [
        {"id": "a", "createdBy": s, "metadata": {"k": "v"}},
        {"id": "b", "createdBy": s, "lastConfirmedBy": ("q", "m", "r", "t")},
        {"id": "c"},
        {"id": "d", "createdBy": s, "confirmationCount": 7},
        {"id": "e", "createdBy": s, "metadata": {"provenance": "own"}},
    ]
    got = {r.id: r.metadata for r in projections.entity_to_wire(entities(spark, *rows)).collect()}
    packed = {k: json.loads(v["provenance"]) for k, v in got.items() if k in "abd"}
    assert [packed[k]["confirmationCount"] for k in "abd"] == [1, 0, 7] and packed["b"]["lastConfirmedBy"]["provider"] == "q"
    assert got["a"]["k"] == "v" and got["c"] == {} and got["e"] == {"provenance": "own"}


def test_legacy_rows_win_over_their_metadata(spark):
    meta = '{"summary": "old", "agent": "old", "confidence": "1", "extra": "x", "project": "mine", "session_id": "old"}'
    o = spark.createDataFrame(
        [("1", "new", "bot", None, "f", "h", "high", "2024", '["m"]', "t", meta), ("2", "", None, None, None, None, None, None, None, "t", "nope")],
        "id string, summary string, agent string, session_id string, source_file string, content_hash string, quality string, digested_at string, messages string, created_at string, metadata string",
    )
    got = {r.legacyId.id: r for r in projections.legacy_to_entity(o, "Observation", stamp()).collect()}
    assert got["1"].metadata == {
        "extra": "x",
        "project": "mine",
        "summary": "new",
        "agent": "bot",
        "source_file": "f",
        "content_hash": "h",
        "quality": "high",
        "digested_at": "2024",
        "messages": '["m"]',
        "createdAt": "t",
        "confidence": "1",
    }
    assert got["2"].name == "(no summary)" and got["2"].metadata == {"summary": "", "createdAt": "t"} and got["1"].layer == "evidence"
    found = entities(spark).unionByName(_shaped(projections.legacy_to_entity(o, "Observation", stamp()), ENTITIES))
    assert reads.find_by_content_hash(found, "bot", "h", NOW).count() == 1
    i = spark.createDataFrame(
        [("1", "", "s" * 99, None, '["a", 1]', "later", "t", meta, None)],
        "id string, topic string, summary string, confidence double, digest_ids string, last_updated string, created_at string, metadata string, project string",
    )
    r = projections.legacy_to_entity(i, "Insight", stamp()).first()
    assert (r.name, r.updatedAt, r.layer) == ("s" * 80, "later", "pattern")
    assert (r.metadata["confidence"], r.metadata["digest_ids"], r.metadata["project"], r.metadata["agent"]) == ("0.8", '["a"]', "mine", "old")
    d = spark.createDataFrame(
        [("1", "2024-01-01", "th", "s", '["o"]', ["a"], "bad", "q", "t")],
        "id string, date string, theme string, summary string, observation_ids string, agents array<string>, files_touched string, quality string, created_at string",
    )
    r = projections.legacy_to_entity(d, "Digest", stamp()).first()
    assert (r.name, r.layer) == ("th", "pattern") and (
        r.metadata["observation_ids"], r.metadata["agents"], r.metadata["files_touched"]
    ) == ('["o"]', '["a"]', "[]")


def test_online_rows_keep_their_fields(spark):
    o = spark.createDataFrame(
        [("1", "\n first \nx", "a", "p", "q", "t", None, "gpt", ["f"]), ("2", "", "a", "p", "q", None, "d", None, None)],
        "id string, summary string, agent string, project string, quality string, createdAt string, digestedAt string, llm string, modifiedFiles array<string>",
    )
    got = {r.legacyId.id: r for r in projections.map_observations(o, stamp()).collect()}
    assert got["1"].name == "first" and got["1"].metadata == {
        "subsystem": "online", "project": "p", "agent": "a", "quality": "q", "llm": "gpt", "modifiedFiles": '["f"]'
    }
    assert got["2"].name == "(empty)" and got["2"].metadata == {
        "subsystem": "online", "project": "p", "agent": "a", "quality": "q", "digestedAt": "d", "modifiedFiles": "[]"
    } and got["2"].createdAt is None


@pytest.mark.parametrize("text,want", [("  a 　b﻿ ", "a b"), ("", ""), ("a\n\tb", "a b")])
def test_normalize_knows_unicode_space(spark, text, want):
    assert spark.range(1).select(fn.normalize_text(F.lit(text))).first()[0] == want


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(fn.jaccard(F.lit("a b"), F.lit("B c"))) == pytest.approx(1 / 3)
    assert get(fn.jaccard(F.lit(""), F.lit(""))) == 1.0
    assert get(fn.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 1.0
    assert get(fn.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert get(fn.derive_name(F.lit("\n  \n  hello  \nx"))) == "hello" and get(fn.derive_name(F.lit(" "))) == "(empty)"
    assert get(fn.first_stamp(F.lit("no"), F.lit("1970-01-01T00:00:01Z"))) == 1000
    assert get(fn.lenient_strings(F.lit('["a", 1, "b"]'))) == ["a", "b"] and get(fn.lenient_strings(F.lit("nope"))) == []
    assert get(fn.lenient_object(F.lit("nope"))) == {}
    minted = get(fn.mint_uuid7(F.lit(datetime.datetime(2024, 1, 1)), F.lit("k")))
    assert get(fn.is_uuid7(F.lit(minted))) and not get(fn.is_uuid7(F.lit("x")))
    assert get(fn.truncate(F.lit("x" * 300))) == "x" * 200 and get(fn.truncate(F.lit(None).cast("string"))) == ""
    assert [fn.parse_int(x) for x in ("12", " 7up", "-3", "x", "", None, 4)] == [12, 7, -3, None, None, None, 4]
    assert get(fn.is_hierarchy_root(F.lit("Timeline"))) and not get(fn.is_hierarchy_root(F.lit("timeline"))) and get(
        fn.root_class(F.lit("Coding"))
    ) == "Project"
    assert fn.answer_json('```json\n{"match": "x"}\n```') == {"match": "x"} and fn.answer_json("so {\"a\": 1} yes") == {"a": 1} and fn.answer_json("no") is None


def test_put_stamps_confirms_and_supersedes(spark):
    store = GraphStore(spark, as_of=NOW)
    store.put(
        entities(spark, {"id": uid(1), "seq": 1, "name": "one"}).select(
            "id", "seq", "name", "metadata", "createdAt", "validFrom", "layer", "description", "supersedes"
        ),
        NOW,
        stamp(),
    )
    store.put(entities(spark, {"id": uid(1), "name": "uno"}).select("id", "name"), NOW, stamp())
    row = store.graph.entities.first()
    assert row.name == "uno" and row.provenance.confirmationCount == 2 and row.layer == "evidence" and row.seq == 1
    new = entities(spark, {"id": uid(2), "seq": 2, "name": "two", "supersedes": uid(1)}).select("id", "seq", "name", "supersedes")
    later = "2024-06-02T00:00:00.000Z"
    store.put(new, later, stamp())
    assert {r.id: r.validUntil for r in store.graph.entities.collect()} == {uid(1): later, uid(2): None}
    assert [(r["from"], r["to"]) for r in store.graph.relations.collect()] == [(uid(1), uid(2))]
    with pytest.raises(writes.Rejected):
        store.put(new.withColumn("id", F.lit(uid(3))), later, stamp())
    with pytest.raises(writes.Rejected):
        store.put(new.withColumn("id", F.lit("x")), later, stamp())
    assert [r.id for r in store.chain(uid(2)).orderBy("position").collect()] == [uid(1), uid(2)]
    assert store.graph.entities._jdf.queryExecution().toString().count("Join") == 0  # each write is a version of its own


def test_chains_of_any_length_and_cycles(spark):
    rows = [{"id": f"{k:03}", "seq": k, "supersedes": f"{k - 1:03}" if k else None} for k in range(90)] + [
        {"id": "x", "seq": 100, "supersedes": "y"}, {"id": "y", "seq": 101, "supersedes": "x"}, {"id": "z", "seq": 102}
    ]
    e, r = entities(spark, *rows), relations(spark, ("089", "SUPERSEDED_BY", "z"))
    got = {x.id: x.position for x in graph.supersession_chain(e, r, "040").collect()}
    assert got == {f"{k:03}": k for k in range(90)} | {"z": 90}
    assert [tuple(x) for x in graph.supersession_chain(e, r, "x").collect()] == [("x", 0)] and graph.supersession_chain(e, r, "nope").count() == 0


def test_strict_puts_ask_the_catalogue(spark):
    c = ontology.Catalog()
    c.register("upper", {"Base": {"description": "b"}, "Other": {"description": "o"}})
    c.register("own", {"Kid": {"extends": "Base", "description": "k"}})
    store = GraphStore(spark, as_of=NOW, catalog=c)
    new = lambda kind, cls=None: entities(spark, {"id": uid(5), "seq": 1, "name": "n", "entityType": kind, "ontologyClass": cls}).select("id", "seq", "name", "entityType", "ontologyClass")
    store.put(new("Kid", "Base"), NOW, stamp())
    for bad in (new("Nope"), new("Kid", "Other")):
        with pytest.raises(writes.Rejected):
            store.put(bad, NOW, stamp())
    store.put(new("Nope"), NOW, strict=False)
    with pytest.raises(writes.Rejected):
        store.put(new("Kid", "Other"), NOW, strict=False)
    assert store.schema("Kid")["extends"] == "Base" and [r.name for r in store.entity_types().collect()] == ["Base", "Other", "Kid"]
    with pytest.raises(NotFound):
        store.schema("Nope")
    minted = writes.put_entities(entities(spark), entities(spark, {"name": "n", "seq": 3}).select("name", "seq"), NOW, stamp())
    assert minted.select(fn.is_uuid7("id")).first()[0]


def test_store_tells_changes_and_misses(spark, tmp_path):
    path = f"file://{tmp_path}/changes"
    store = GraphStore(spark, as_of=NOW, changes=path)
    store.create(entities(spark, {"id": "a", "seq": 1, "name": "A", "entityType": "X"}, {"id": "b", "seq": 2, "name": "B", "entityType": "X"}), NOW)
    store.relate(relations(spark, ("a", "t", "b")).drop("key"), NOW)
    assert [r.key for r in store.graph.relations.collect()] == ["a|b|t"]
    store.patch("a", {"name": F.lit("AA")}, "2024-06-02T00:00:00.000Z")
    store.unrelate(spark.createDataFrame([("a|b|t",)], "key string"), NOW)
    store.delete(spark.createDataFrame([("b",)], "id string"), NOW)
    told = [(r.op, r.key) for r in spark.read.parquet(path).collect()]
    assert sorted(told) == [("delete", "b"), ("put", "a"), ("put", "a"), ("put", "b"), ("relate", "a|b|t"), ("unrelate", "a|b|t")]
    for miss in (lambda: store.patch("zz", {}), lambda: store.unrelate(spark.createDataFrame([("zz",)], "key string"), NOW)):
        with pytest.raises(NotFound):
            miss()
    with pytest.raises(writes.Rejected):
        store.create(entities(spark, {"id": "c", "seq": 3, "entityType": "X"}), NOW)
    assert [r.id for r in store.entities(limit="1x").collect()] == ["a"] and ids(store.tombstones(), "key") == ["b"]
    store.save(f"file://{tmp_path}/snap")
    assert ids(GraphStore.load(spark, f"file://{tmp_path}/snap", NOW).graph.entities) == ["a"]


def test_relations_upsert_overlay_and_refusals(spark):
    e, none = entities(spark, {"id": "a"}, {"id": "b"}), spark.createDataFrame([], TOMBSTONES)
    old = relations(spark, ("a", "t", "b", {"x": "1", "createdAt": "c0"}))
    new = relations(spark, ("a", "t", "b", {"x": "2", "y": "3", "createdAt": "c1"}))
    got, _ = writes.add_relations(e, old, none, new, NOW)
    assert [(r.key, r.metadata) for r in got.collect()] == [("k0", {"x": "2", "y": "3", "createdAt": "c0"})]
    for bad in (("a", "t", "a"), ("a", "t", "z")):
        with pytest.raises(writes.Rejected):
            writes.add_relations(e, old, none, relations(spark, bad), NOW)


def test_delete_leaves_tombstone_and_drops_edges(spark):
    e, none = entities(spark, {"id": "a", "metadata": {"domain": "d"}}, {"id": "b"}), spark.createDataFrame([], TOMBSTONES)
    e2, r2, t2 = writes.delete_entities(e, relations(spark, ("a", "t", "b")), none, spark.createDataFrame([("a",), ("zz",)], "id string"), NOW)
    assert ids(e2) == ["b"] and r2.count() == 0 and [(t.key, t.meta.domain) for t in t2.collect()] == [("a", "d")]


def test_merge_duplicates(spark):
    seg = ("hello", "r", "p", "m", "fast", "t", [])
    e = entities(spark, {"id": "s", "seq": 1}, {"id": "d", "seq": 2, "descriptionSegments": [seg]}, {"id": "x", "seq": 3})
    r = relations(spark, ("d", "t", "x"), ("s", "t", "x"), ("d", "t", "s"))
    e2, r2 = writes.merge_entities(e, r, spark.createDataFrame([("d", "s")], "dup string, survivor string"), NOW)
    row = e2.where("id = 's'").first()
    assert row.provenance.confirmationCount == 2 and len(row.descriptionSegments) == 1 and row.resolutionHistory[0].mergedId == "d"
    assert sorted((x["from"], x.type, x.to) for x in r2.collect()) == [("d", "SUPERSEDED_BY", "s"), ("s", "t", "x")]
    assert e2.where("id = 'd'").first().validUntil == NOW


def test_segments_fold(spark):
    rows = [("a  b", "1", "p", "m", "fast", "t", []), ("a b", "2", "p", "m", "fast", "t", [("x", "x", "x", "x")]), ("A b", "3", "p", "m", "fast", "t", [])]
    got = spark.createDataFrame([(rows,)], f"s array<{SEGMENT}>").select(writes.fold_segments(F.col("s"))).first()[0]
    assert [(s.text, len(s.confirmations)) for s in got] == [("a  b", 1), ("A b", 0)]


def test_segments_fold_as_rows(spark):
    """As the fold of an array; missing texts fold, too, and 20,000 different texts of one entity are no array."""
    rows = [("e", 3, "a  b"), ("e", 1, "a b "), ("e", 2, "A b"), ("f", 4, "a b"), (None, 5, "x"), (None, 6, " x"), ("f", 7, None), ("f", 8, None), ("f", 9, "")]
    kept, rest = writes.fold_rows(spark.createDataFrame(rows, "e string, n int, text string"), "e", "n")
    assert sorted((r.e or "", r.n, r.confirmations) for r in kept.collect()) == [
        ("", 5, 1), ("e", 1, 1), ("e", 2, 0), ("f", 4, 0), ("f", 7, 1), ("f", 9, 0)
    ]
    assert sorted((r.first, r.n, r.text or "") for r in rest.collect()) == [(1, 3, "a  b"), (5, 6, " x"), (7, 8, "")]
    many = spark.range(40_000).selectExpr("'e' AS e", "id AS n", "concat('t ', id % 20000) AS text")
    assert writes.fold_rows(many, "e", "n")[0].agg(F.count("n"), F.sum("confirmations"), F.max("n")).first()[:] == (20_000, 20_000, 19_999)


def copy(spark, nodes, edges=(), tombs=()):
    e = entities(spark, *({"seq": k, "id": i, "name": n, "updatedAt": t} for k, (i, n, t) in enumerate(nodes)))
    t = spark.createDataFrame([(k, key, at, None) for k, key, at in tombs], TOMBSTONES)
    return merge.Graph(e, relations(spark, *edges), t)


def test_merge_last_writer_ties_and_tombstones(spark):
    t1, t2 = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"
    a = copy(spark, [("x", "a", t1), ("y", "a", t2), ("z", "a", t1)], [("x", "t", "y"), ("x", "t", "q"), ("x", "t", "z")])
    b = copy(spark, [("x", "b", t1), ("y", "b", t1), ("z", "b", t1)], [("y", "t", "x")], [("entities", "z", t1)])
    m = merge.merge_graphs([None, a, b])
    assert {r.id: r.name for r in m.graph.entities.collect()} == {"x": "a", "y": "a"}
    assert sorted((r["from"], r["to"], r.key) for r in m.graph.relations.collect()) == [("x", "y", "k0"), ("y", "x", "k0~1")]
    assert [(r["to"], r.origin) for r in m.dangling.collect()] == [("q", 1)]
    s = m.stats.first()
    assert (s.entitiesTombstoned, s.relationsTombstoned, s.dangling) == (1, 1, 1)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 9)), max_size=4, unique_by=lambda x: x[0]), min_size=2, max_size=3))
def test_merge_picks_the_latest(spark, copies):
    want = {}
    for k, nodes in enumerate(copies):
        for i, day in nodes:
            if i not in want or day > want[i][0]:
                want[i] = (day, f"c{k}")
    made = [copy(spark, [(i, f"c{k}", f"2024-01-0{d}T00:00:00Z") for i, d in nodes]) for k, nodes in enumerate(copies)]
    assert {r.id: r.name for r in merge.merge_graphs(made).graph.entities.collect()} == {i: n for i, (_, n) in want.items()}


def test_components_chain_and_stats(spark):
    e = entities(spark, *({"id": f"{k:03}", "seq": k, "layer": "evidence"} for k in range(40)))
    r = relations(spark, *((f"{k:03}", "t", f"{k + 1:03}") for k in range(30)), ("035", "t", "036"), ("000", "t", "nowhere"))
    c = {x.id: x.component for x in graph.components(e, r).collect()}
    assert {c[f"{k:03}"] for k in range(31)} == {"000"} and c["036"] == "035" and c["039"] == "039"
    s = graph.stats(e, r).first()
    assert (s.components, s.largest, s.islands) == (9, 31, 1)
    sizes, members = graph.connectivity(e, r)
    assert [(x.component, x["size"]) for x in sizes.where("isMain").collect()] == [("000", 31)] and members.where("isMain").count() == 31


def test_degree_counts_loops_twice(spark):
    d = {
        r.id: r.degree for r in graph.degree(
            entities(spark, {"id": "a"}, {"id": "b"}, {"id": "c"}), relations(spark, ("a", "t", "a"), ("a", "t", "b"))
        ).collect()
    }
    assert d == {"a": 3, "b": 1, "c": 0}


def test_communities_of_two_cliques(spark):
    nodes = [f"{s}{k}" for s in "ab" for k in range(4)]
    edges = [(f"{s}{i}", "t", f"{s}{j}") for s in "ab" for i, j in product(range(4), range(4)) if i < j] + [("a0", "t", "b0")]
    found, members, q = graph.communities(entities(spark, *({"id": n, "seq": k} for k, n in enumerate(nodes))), relations(spark, *edges))
    own = {}
    for r in members.collect():
        own.setdefault(r.community, []).append(r.id)
    assert sorted(map(sorted, own.values())) == [[f"{s}{k}" for k in range(4)] for s in "ab"] and [r["size"] for r in found.collect()] == [4, 4]
    assert q.first()[0] == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)
    with pytest.raises(ValueError):
        graph.communities(None, None, "other")


@pytest.mark.parametrize("few", [0, 1000])
def test_communities_of_planted_cliques(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(2)
    nodes = [(c, k) for c in range(12) for k in range(6)]
    edges = [(a, b) for a in nodes for b in nodes if a < b and a[0] == b[0]] + [tuple(rng.sample(nodes, 2)) for _ in range(30)]
    name = lambda n: f"{n[0]:02}-{n[1]}"
    e, r = entities(spark, *({"id": name(n), "seq": k} for k, n in enumerate(nodes))), relations(spark, *((name(a), "t", name(b)) for a, b in edges))
    planted = spark.createDataFrame([(name(n), str(n[0])) for n in nodes], "id string, community string")
    assert graph.communities(e, r)[2].first()[0] >= graph.modularity(r, planted).first()[0] - 0.02


def test_communities_by_components(spark, monkeypatch):
    """A graph of more edges than one task takes needs no rounds if none of its components does; the one that does goes in rounds."""
    cliques = {c: range(9 if c == "k" else 4) for c in "abcdefghk"}
    edges = [(f"{c}{i}", "t", f"{c}{j}") for c, own in cliques.items() for i in own for j in own if i < j] + [("l", "t", "l"), ("a0", "t", "a0")]
    nodes = [f"{c}{i}" for c, own in cliques.items() for i in own] + ["l", "m"]
    e, r = entities(spark, *({"id": n, "seq": k} for k, n in enumerate(nodes))), relations(spark, *edges)
    rounds, whole = [], graph._by_rounds
    monkeypatch.setattr(graph, "_by_rounds", lambda edges, *rest: rounds.append(edges.count()) or whole(edges, *rest))
    for few, shared, want in ((40, 20, []), (40, 1, []), (20, 20, [72])):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        monkeypatch.setattr(graph, "SHARED_EDGES", shared)
        rounds.clear()
        got = {x.id: x.community for x in graph.communities(e, r)[1].collect()}
        assert got == {n: f"{n[0]}0" if n[0] in cliques else n for n in nodes} and rounds == want


def test_communities_do_not_write_their_edges_one_by_one(spark, monkeypatch):
    """Edges of a large component are exchanged in packs, whichever partitions hold them; dangling ones and repeated ones count as they should."""
    edges = [(f"{c}{i:02}", "t", f"{c}{j:02}") for c in "abc" for i in range(80) for j in range(i)]
    edges += [("a01", "t", "a00"), ("b00", "t", "b00"), ("x", "t", "a00"), ("a00", "t", "y")] + [(f"d{i:03}", "t", f"d{i // 10:03}") for i in range(1, 100)]
    nodes = [f"{c}{i:02}" for c in "abc" for i in range(80)] + [f"d{i:03}" for i in range(100)] + ["alone"]
    rows, written = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, path: rows.setdefault(path, written(df, path)))
    monkeypatch.setattr(graph, "FEW_EDGES", 4_000)
    monkeypatch.setattr(graph, "SHARED_EDGES", 500)
    e, r = entities(spark, *({"id": n, "seq": k} for k, n in enumerate(nodes))), relations(spark, *edges).repartition(2)
    _, members, q = graph.communities(e, r)
    got = {x.id: x.community for x in members.collect()}
    assert set(got) == set(nodes) and {n: got[n] for n in nodes if n[0] in "abc"} == {n: f"{n[0]}00" if n != "alone" else n for n in nodes if n[0] in "abc"}
    assert {got[n] for n in nodes if n[0] == "d"} == {"d000"} and q.first()[0] > 0.6  # as large as the others, it would be split
    assert max(t.count() for t in rows.values()) < len(edges) // 4


@pytest.mark.parametrize("n, edges", [(400, 60_000), (3_000, 40_000), (300, 4_000)])
def test_no_node_gains_when_settled(n, edges):
    """By the matrix, by batches and node after node."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, n, edges), rng.integers(0, n, edges)
    b = np.where(rng.random(edges) < 0.3, a // 20 * 20 + b % 20, b) % n
    u, v, w = graph._summed(np.concatenate((a, b)), np.concatenate((b, a)), np.ones(2 * edges), n)
    label = np.asarray(graph._settled(u, v, w, n, 2.0 * edges, random.Random(3)))
    into, k = np.zeros((n, n)), np.bincount(u, w, n)
    np.add.at(into, (u[u != v], label[v[u != v]]), w[u != v])
    gain = into - k[:, None] * (np.bincount(label, k, n)[None, :] - k[:, None] * (label[:, None] == np.arange(n))) / (2.0 * edges)
    assert 1 < len(set(label.tolist())) < n and (np.where(into > 0, gain, -np.inf).max(1) <= gain[np.arange(n), label] + 1e-6).all()


def test_leaves_follow():
    """A node of one neighbour goes with it before any level; of two that have no other, one does."""
    table = pa.table({"u": ["h", "h", "h", "p", "l"], "v": ["a", "b", "c", "q", "l"], "w": [1.0, 2.0, 1.0, 1.0, 1.0]})
    found = graph._louvain(table, 12.0, 1)
    assert dict(zip(*(found[c].to_pylist() for c in ("id", "found")))) == {"h": "a", "a": "a", "b": "a", "c": "a", "p": "p", "q": "p", "l": "l"}


def test_cascade_layers(spark):
    pool = entities(
        spark,
        {"id": "p1", "seq": 1, "name": "alpha beta", "entityType": "X"},
        {"id": "p2", "seq": 2, "name": "gamma", "entityType": "X", "embedding": [1.0, 0.1]},
        {"id": "p3", "seq": 3, "name": "delta", "entityType": "X"},
    )
    new = entities(
        spark,
        {"id": "n1", "seq": 1, "name": "Beta Alpha", "ontologyClass": "X", "entityType": "Z"},
        {"id": "n2", "seq": 2, "name": "other", "entityType": "X", "embedding": [1.0, 0.0]},
        {"id": "n3", "seq": 3, "name": "dee", "entityType": "X"},
        {"id": "n4", "seq": 4, "name": "q"},
    )
    ask = lambda prompt: '{"match": "delta"}' if "dee" in prompt else "none"
    layers = dedup.LayeredDeduplicator([dedup.NameMatcher(), dedup.EmbeddingMatcher(), dedup.SemanticMatcher(ask)])
    got = {r.id: (r.layer, r.match, r.unclassified) for r in layers.dedup(new, pool).collect()}
    assert got == {"n1": ("name", "p1", False), "n2": ("embedding", "p2", False), "n3": ("semantic", "p3", False), "n4": (None, None, True)}


def test_ontology(spark):
    c = ontology.Catalog()
    c.register("upper", {"Base": {"description": "b", "relationships": {"r": ["Base"]}, "properties": {}}})
    c.register(
        "own",
        {
            "Kid": {"extends": "Base", "description": "k", "relationships": {"s": ["Kid"]}, "properties": {"p": {"type": "string"}}},
            "Loop": {"extends": "Loop", "description": ""},
        },
    )
    assert c.parents("Kid") == ["Base"] and c.parents("Loop") == [] and set(c.valid_relationships("Kid")) == {"r", "s"} and c.below("Base") == ["Kid"]
    e = entities(
        spark,
        {"id": "ok", "entityType": "Kid", "ontologyClass": "Base"},
        {"id": "bad", "entityType": "Base", "ontologyClass": "Kid"},
        {"id": "open", "entityType": "Nope", "ontologyClass": "Kid"},
    )
    assert ids(ontology.isa_violations(e, c.table(spark), c.ancestors(spark))) == ["bad"]
    assert "Kid (extends Base): k [r->Base, s->Kid]" in c.prompt()
    with pytest.raises(ValueError):
        ontologies.read_ontology('{"classes": {}}')
    upper = '{"meta": {"name": "u"}, "classes": {"Base": {"description": "b", "properties": {"p": {"type": "string"}}}}}'
    own = '{"meta": {"name": "own"}, "classes": {"Kid": {"extends": "Base", "description": "k"}}}'
    c.reload({"own.json": own, "upper.json": upper, "x.display.json": "", "bad.json": "{"})
    assert list(c.classes) == ["Base", "Kid"] and set(c.schema("Kid")["properties"]) == {"p"} and len(c.warnings) == 1 and c.domains() == ["upper", "own"]
    with pytest.raises(ValueError):
        c.reload({"upper.json": "{"})
    assert list(c.classes) == ["Base", "Kid"]
    hints = ontologies.display_hints('{"Kid": {"color": "#fff", "shape": "square", "pulseRule": null}, "Base": {"shape": "blob"}}')
    assert hints == {"Kid": {"color": "#fff", "shape": "square"}} and ontologies.display_hints("{") == {}
    with pytest.raises(ValueError):
        ontologies.parse_hint({"borderStyle": "wavy"})
    rows = ontology.class_listing(c.table(spark), hints, "coding").collect()
    assert [(r.name, r.level, r.parent, r.display) for r in rows] == [
        ("System", 0, None, None), ("Project", 0, None, None), ("Base", None, None, None), ("Kid", None, "Base", {"color": "#fff", "shape": "square"})
    ]
    assert [r.name for r in ontology.class_listing(c.table(spark)).collect()] == ["Base", "Kid"]
    with pytest.raises(ValueError):
        ontology.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string"), "x", "y", most=5)
    assert ontologies.ontology_order(["b.json", "upper.json", "a.display.json", "a.json"]) == ["upper.json", "a.json", "b.json"]


def test_files_round_trip(spark, tmp_path):
    g = copy(spark, [("x", "a", NOW), ("y", "b", NOW)], [("x", "t", "y")], [("entities", "q", NOW)])
    graphs.export(g, f"file://{tmp_path}/out", ["d"])
    graphs.export(g, f"file://{tmp_path}/out", ["d"], files=3)
    back = graphs.read_export(spark, f"file://{tmp_path}/out")
    assert ids(back.entities) == ["x", "y"] and back.relations.count() == 1 and back.tombstones.first().key == "q"
    snaps = graphs.Snapshots(spark, f"file://{tmp_path}/snaps")
    name = snaps.create(g, "first", "20240101T000000Z")
    assert [r.id for r in snaps.list().collect()] == [name]
    assert ids(snaps.restore(name, True).entities) == ["x", "y"]
    for bad in ((name, False), ("../x", True)):
        with pytest.raises(ValueError):
            snaps.restore(*bad)
    data = {
        "attributes": {"kmTombstones": {"entities": {"gone": {"at": NOW}}}},
        "nodes": [{"key": "n1", "attributes": {"name": "N", "metadata": {"a": "b"}}}],
        "edges": [{"key": "e", "source": "n1", "target": "n1", "attributes": {"type": "t"}}],
    }
    (tmp_path / "g.json").write_text(json.dumps(data))
    read = graphs.read_json(spark, [f"file://{tmp_path}/g.json"])[0]
    dangling = {"nodes": [{"key": "n2", "attributes": {}}], "edges": [{"key": "f", "source": "n2", "target": "gone?", "attributes": {"type": "t"}}]}
    (tmp_path / "h.json").write_text(json.dumps(dangling))
    merged, left = graphs.read_merged(spark, [f"file://{tmp_path}/g.json", f"file://{tmp_path}/./g.json", f"file://{tmp_path}/h.json"])
    assert ids(merged.graph.entities) == ["n1", "n2"] and [(r.key, r.path.split("/")[-1]) for r in left.collect()] == [("f", "h.json")]
    opened = graphs.hydrate(spark, f"file://{tmp_path}/snaps/{name}", [f"file://{tmp_path}/g.json", f"file://{tmp_path}/none.json"], NOW)
    assert ids(opened.graph.entities) == ["n1", "x", "y"] and graphs.hydrate(spark, None, [f"file://{tmp_path}/none.json"], NOW) is None
    assert [
        (r.id, r.name, r.metadata) for r in read.entities.collect()
    ] == [("n1", "N", {"a": "b"})] and read.relations.first().type == "t" and read.tombstones.first().key == "gone"


def test_vectors_and_missing_exports(spark, tmp_path):
    e = entities(spark, {"id": "a", "name": "n", "embedding": [1.0]}, {"id": "b"}, {"id": "c", "embedding": []})
    points = graphs.vector_points(e, NOW)
    assert ids(points) == ["a"]
    assert [(r.points, r.error) for r in graphs.sync_vectors(points, lambda batch: None).collect() if r.points] == [(1, None)]
    with pytest.raises(ValueError):
        graphs.sync_vectors(points, print, 0)
    rows, warning = graphs.read_online(spark, f"file://{tmp_path}/none.json", "id string")
    assert rows.count() == 0 and warning


def test_change_stream(spark, tmp_path):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = "op string, key string, payload string, ts timestamp"
    spark.createDataFrame([("put", "a", "1", t[1]), ("put", "b", "1", t[0])], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    q = apply_changes(
        spark,
        spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"),
        f"{tmp_path}/out",
        f"{tmp_path}/cp",
        {"processingTime": "0 seconds"},
    )
    try:
        q.processAllAvailable()
        spark.createDataFrame([("put", "a", "0", t[0]), ("delete", "b", None, t[2])], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.key: (r.op, r.payload) for r in current(spark, f"{tmp_path}/out").collect()} == {"a": ("put", "1"), "b": ("delete", None)}
    assert current(spark, f"{tmp_path}/nothing").count() == 0
    assert latest_changes(spark.createDataFrame([], schema)).count() == 0


def test_export_waits_for_the_last_write(spark, tmp_path):
    sink = DebouncedExport(f"file://{tmp_path}/out", [], delay=60)
    assert not sink.flush()
    for name in ("one", "two"):
        sink.schedule(copy(spark, [("x", name, NOW)]))
    assert not (tmp_path / "out").exists() and sink.flush() and not sink.flush()
    assert [r.name for r in graphs.read_export(spark, f"file://{tmp_path}/out").entities.collect()] == ["two"]


def test_resolve_and_backfill_and_pipeline(spark):
    e = entities(spark, *({"id": i, "seq": k, "name": n, "entityType": "X"} for k, (i, n) in enumerate((("a", "foo bar"), ("b", "bar foo"), ("c", "else")))))
    r = relations(spark, ("b", "t", "c"))
    assert [(x.dup, x.survivor) for x in writes.resolve_plan(e, r, ["X"]).collect()] == [("a", "b")]
    filled = writes.backfill(e, F.lit(NOW), stamp())
    assert {x.validFrom for x in filled.collect()} == {NOW}
    assert {x.validFrom for x in writes.backfill(filled, F.lit("later"), stamp()).collect()} == {NOW}
    told = []
    pipe = dedup.IngestPipeline(
        lambda t: t, dedup.LayeredDeduplicator([dedup.NameMatcher()]), lambda new, old, by: (old.unionByName(new), r), on_phase=lambda *x: told.append(x)
    )
    new = entities(spark, {"id": "n", "seq": 9, "name": "else", "entityType": "X"}, {"id": "m", "seq": 10, "name": "else", "entityType": "X"})
    done = pipe.ingest(new, e, r, stamp())
    assert {x.id: x.supersedes for x in done.entities.where("seq >= 9").collect()} == {"n": "c"} and [x.id for x in done.errors.collect()] == ["m"]
    assert tuple(done.counts.select("extracted", "merged", "refused", "stored").first()) == (2, 2, 1, 1)
    assert told == [(s, w) for s in ("extract", "dedup", "store") for w in ("start", "done")] and set(done.seconds) == {"extract", "dedup", "store"}
    for bad in (dict(provenance=None), dict(provenance=stamp(), skip=("extract",)), dict(provenance=stamp(), skip=("nope",))):
        with pytest.raises(ValueError):
            pipe.ingest(new, e, r, **bad)
    assert pipe.ingest(new.limit(0), e, r, stamp(), ("extract",)).decisions.count() == 0
    assert pipe.run_stage("dedup", new, e).where("match = 'c'").count() == 2
    stored, _ = pipe.run_stage("store", new, e, stamp(), spark.createDataFrame([("n", "c")], "id string, supersedes string"))
    assert {x.id: x.supersedes for x in stored.where("seq >= 9").collect()} == {"n": "c", "m": None}
    for bad in (("dedup", new), ("store", new, e), ("nope", new)):
        with pytest.raises(ValueError):
            pipe.run_stage(*bad)


def test_resolution_by_any_matcher(spark):
    rows = [{"id": f"e{k}", "seq": k, "name": n, "entityType": "X", "description": d} for k, (n, d) in enumerate([("OOM", "a"), ("Out of memory", "b"), ("disk full", None), ("Out of memory", "b" * 300), ("Out of memory", "b")])]
    e, r = entities(spark, *rows), relations(spark, ("e1", "t", "e2"))
    ask = lambda prompt: '{"matches": [{"newName": "OOM", "existingName": "Out of memory"}]}' if 'New: ["OOM"]' in prompt else '{"matches": []}'
    after, edges, done = writes.resolve_entities(e, r, ["X"], NOW, dedup.SemanticMatcher(ask))
    assert [(m["class"], m.dup, m.dup_name, m.survivor, m.confidence) for m in done.merges.collect()] == [("X", "e0", "OOM", "e1", 0.7)]
    assert [tuple(x) for x in done.counts.select("class", "scanned", "matches").collect()] == [("X", 5, 1)]
    assert after.where("id = 'e0'").first().validUntil == NOW and edges.where("type = 'SUPERSEDED_BY'").count() == 1
    same, _, trial = writes.resolve_entities(e, r, ["X"], NOW, dedup.NameMatcher(1.0), dry_run=True)
    assert same is e and trial.dry_run and sorted((m.dup, m.survivor) for m in trial.merges.collect()) == [("e3", "e1"), ("e3", "e1"), ("e4", "e1")]
    assert writes.resolve_plan(e, r, ["X"], dedup.SemanticMatcher(ask), threshold=0.8).count() == 0


def test_semantic_matcher_reads_answers(spark):
    pool = entities(spark, *({"id": f"p{k}", "seq": k, "name": f"n{k}", "entityType": "X"} for k in range(9)))
    new = entities(spark, {"id": "a", "seq": 1, "name": "new", "entityType": "X"})

    def match(answer, **how):
        return [r.match for r in dedup.SemanticMatcher(lambda _: answer, per_prompt=3, **how).match(new, pool).collect()]

    assert match('so: {"matches": [{"newName": "new", "existingName": "n7"}]}') == ["p7"] and match('{"match": "n2"}') == ["p2"]
    assert match("no idea") == match('{"matches": []}') == match("{broken") == match('{"matches": [{"newName": "old", "existingName": "n7"}]}') == []
    with pytest.raises(Exception, match="no JSON"):
        match("{broken", on_error="raise")

    def slow(_):
        import time

        time.sleep(0.5)
        return '{"match": "n2"}'

    assert dedup.SemanticMatcher(slow, timeout=0.05).match(new, pool).count() == 0


def test_name_matcher_keeps_every_match(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_TOKEN", 3)
    rng = random.Random(9)
    names = [" ".join(rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 9))) for _ in range(60)]
    names += [" ".join(f"t{k}" for k in range(100)), " ".join(f"t{k}" for k in range(55))]
    rows = [{"id": str(k), "seq": k, "name": n, "entityType": "X"} for k, n in enumerate(names)]
    new, pool = entities(spark, *rows[::2]), entities(spark, *rows)
    for t in (0.55, 0.7, 1.0):
        want = set()
        for a in rows[::2]:
            for b in rows:
                x, y = set(a["name"].split()), set(b["name"].split())
                if len(x & y) >= t * len(x | y) - 1e-9:
                    want.add((a["id"], b["id"]))
        assert {(r.id, r.cand) for r in dedup.NameMatcher(t).pairs(new, pool).collect()} == want


def test_name_matcher_compares_copies_once(spark, monkeypatch):
    """The best of each is that of all pairs, first by score and then by seq, and copies of names make no pairs."""
    rng, words = random.Random(4), [f"w{k}" for k in range(6)]
    rows = [{"id": str(k), "seq": (k * 7) % 400, "name": " ".join(rng.sample(words, rng.randint(1, 4))), "entityType": "XY"[k % 9 == 0]} for k in range(400)]
    new, pool = entities(spark, *rows[::3]), entities(spark, *rows[1::3], *rows[2::3])
    made = []
    whole = dedup.NameMatcher._met
    monkeypatch.setattr(dedup.NameMatcher, "_met", lambda self, a, b, unique: made.append((a.count(), b.count())) or whole(self, a, b, unique))
    for t in (0.5, 0.85, 0.0):
        matcher, top = dedup.NameMatcher(t), {}
        for r in matcher.pairs(new, pool).collect():
            top[r.id] = max(top.get(r.id, (-1, 0, "")), (r.score, -r.cand_seq, r.cand))
        assert {r.id: (r.confidence, r.match) for r in matcher.match(new, pool).collect()} == {i: (s, c) for i, (s, _, c) in top.items()}
        sets = {(r["entityType"], *sorted(r["name"].split())) for r in rows}
        assert max(made[-1]) <= len(sets) < 100 and len(top) > 80


def test_cascade_makes_no_pairs_of_copies(spark, monkeypatch):
    """A layer of names hands on its best without making all pairs of copies, which grow with the square of a class."""

    def refused(*_):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(dedup.NameMatcher, "pairs", refused)
    rows = [{"id": str(k), "seq": k, "name": "b a" if k % 2 else "a b", "entityType": "X"} for k in range(600)]
    new, pool = entities(spark, *rows[::2], {"id": "z", "seq": 999, "name": "c", "entityType": "X"}), entities(spark, *rows[1::2])
    got = {(r.layer, r.match): r["count"] for r in dedup.LayeredDeduplicator([dedup.NameMatcher()]).dedup(new, pool).groupBy("layer", "match").count().collect()}
    assert got == {("name", "1"): 300, (None, None): 1}


def test_cascade_splits_copies_once_and_runs_each_layer_once(spark, monkeypatch):
    """A name of many entities is split a few times in all, and what a layer finds is found once, whatever comes after it."""
    sc, kind = spark.sparkContext, "array<string>"
    split, made = sc.accumulator(0), [sc.accumulator(0) for _ in range(3)]

    def words(name):
        split.add(1)
        return sorted(set(name.lower().split()))

    class Watched:
        def __init__(self, k, layer):
            self.k, self.layer = k, layer

        def match(self, new, pool):
            count, found = made[self.k], self.layer.match(new, pool)

            def run(batches):
                for b in batches:
                    count.add(len(b))
                    yield b

            return found.mapInPandas(run, found.schema)

    monkeypatch.setattr(dedup, "tokens", lambda name: F.udf(words, kind)(name))
    rows = [{"id": str(k), "seq": k, "name": ("b a", "a b", "c")[k % 3] + (" d" if k % 4 < 1 else ""), "entityType": "XY"[k % 5 == 0]} for k in range(1200)]
    new, pool = entities(spark, *rows[::2]), entities(spark, *(r for r in rows[1::2] if r["name"][0] != "c"))
    assert dedup.NameMatcher().match(new, pool).count() == 200 and split.value < 200
    layers = [Watched(k, m) for k, m in enumerate((dedup.NameMatcher(), dedup.NameMatcher(0.6), dedup.NameMatcher(0.0)))]
    layers[1].layer.layer, layers[2].layer.layer = "near", "any"
    got = {(r.layer, r["count"]) for r in dedup.LayeredDeduplicator(layers).dedup(new, pool).groupBy("layer").count().collect()}
    assert got == {("name", 200), ("near", 200), ("any", 200)}
    assert [x.value for x in made] == [200, 200, 200]


def test_vectors_meet_by_keys(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 32))
    rows = [{"id": f"{s}{k}", "seq": k, "entityType": "X", "embedding": (v + (s == "n") * 0.2 * rng.standard_normal(32)).tolist()} for s in "np" for k, v in enumerate(base)]
    new, pool = entities(spark, *rows[:150]), entities(spark, *rows[150:])
    exact = {(r.id, r.cand) for r in dedup.EmbeddingMatcher(0.9).pairs(new, pool).collect()}
    by_key = {(r.id, r.cand) for r in dedup.EmbeddingMatcher(0.9, few=10).pairs(new, pool).collect()}
    assert len(exact) > 100 and by_key <= exact and len(by_key) >= 0.99 * len(exact)


def test_every_vector_is_compared(spark):
    """No pair at the threshold is missed in a large class, whatever its blocks; scores are those of the formula, odd vectors too."""
    rng = np.random.default_rng(5)
    vectors = [v.tolist() for v in rng.standard_normal((400, 8))] + [[0.0] * 8, None, [1.0, None] + [0.0] * 6, [1.0] * 3, [1e-80] * 8]
    vectors += [vectors[7], vectors[7], [1e90] * 8]
    rows = [{"id": str(k), "seq": k, "entityType": "XY"[k % 5 == 0], "embedding": v} for k, v in enumerate(vectors)]
    new, pool = entities(spark, *rows[::3]), entities(spark, *rows)
    from spanloom.functions import cosine

    both = new.alias("a").join(pool.alias("b"), "entityType").select("a.id", F.col("b.id").alias("cand"), "b.seq", cosine("a.embedding", "b.embedding").alias("s"))
    want = {(r.id, r.cand): r for r in both.where("s >= 0.3").collect()}
    for few in (7, 50_000):
        matcher = dedup.EmbeddingMatcher(0.3, few=few)
        got = {(r.id, r.cand): r.score for r in matcher.pairs(new, pool).collect()}
        assert got == {k: r.s for k, r in want.items()} and len(got) > 1000
        best = {r.id: (r.match, r.confidence) for r in matcher.match(new, pool).collect()}
        top = {}
        for (i, c), r in want.items():
            top[i] = max(top.get(i, (-1, 0, "")), (r.s, -r.seq, c))
        assert best == {i: (c, s) for i, (s, _, c) in top.items()}


def test_example_adapter(spark):
    store = GraphStore(spark, as_of=NOW)
    text = lambda *rows: spark.createDataFrame(list(rows), "seq int, text string")
    example.run(spark, store, text((1, "cache is cold\nfirst"), (2, "queue is full")))
    done = example.run(spark, store, text((3, "Cache is cold\nagain"), (4, "new thing")))
    assert sorted(r.layer or "" for r in done.decisions.collect()) == ["", "name"]
    assert sorted(r.seq for r in reads.scan(store.graph.entities, "2024-06-01T00:00:00.001Z").collect()) == [2, 3, 4]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared.work_dir(Cluster())


def test_reprojection_is_idempotent(spark):
    from spanloom.operators.reproject import convert_dump, reproject_online

    obs = spark.createDataFrame(
        [("o1", "first\nline", "a", "p", "q", NOW), ("o2", "", "a", "p", "q", NOW)],
        "id string, summary string, agent string, project string, quality string, createdAt string",
    )
    dig = spark.createDataFrame(
        [("d1", "2024-01-01", "theme", "s", ["o1", "zz"], ["a"], None)],
        "id string, date string, theme string, summary string, observationIds array<string>, agents array<string>, createdAt string",
    )
    ins = spark.createDataFrame(
        [("i1", "topic", "s", 0.5, ["d1"], NOW)], "id string, topic string, summary string, confidence double, digestIds array<string>, createdAt string"
    )
    got = reproject_online(entities(spark), relations(spark, ("x", "t", "y")).limit(0), obs, dig, ins, stamp(), NOW)
    assert {(r.name, r.layer) for r in got.entities.collect()} == {("first", "evidence"), ("(empty)", "evidence"), ("theme", "evidence"), ("topic", "pattern")}
    assert got.relations.count() == 2 and [r.ref for r in got.warnings.collect()] == ["zz"]
    assert reads.find_by_legacy_id(got.entities, "A", "o1", NOW).count() == 1
    assert all(r.ok for r in got.entities.select(fn.is_uuid7("id").alias("ok")).collect())
    again = reproject_online(got.entities, got.relations, obs, dig, ins, stamp(), NOW)
    assert {r.kind: (r.scanned, r.written) for r in again.counts.collect()} == {
        "Observation": (2, 0), "Digest": (1, 0), "Insight": (1, 0)
    } and again.relations.count() == 2
    nodes, edges = convert_dump(
        spark.createDataFrame([("1", "n"), ("2", None)], "id string, name string"),
        spark.createDataFrame([(0, "n", "2", "t")], "seq int, `from` string, `to` string, relationType string"),
    )
    assert ids(nodes, "key") == ["2", "n"] and edges.first().key == "b-rel-0"


def test_files_and_vectors(spark, tmp_path, monkeypatch):
    from spanloom.sources import embeddings, files

    told, path = [], tmp_path / "x" / "f.json"
    digest, wrote = files.write_if_changed(path, "a")
    assert wrote and files.write_if_changed(path, "a", digest) == (digest, False)
    path.write_text("other")
    assert not files.write_if_changed(path, "b", digest, told.append)[1] and told == [str(path)] and path.read_text() == "other"
    files.write_checkpoint(tmp_path / "cp", {"done": 3})
    assert files.read_checkpoint(tmp_path / "cp") == {"done": 3} and files.read_checkpoint(tmp_path / "none") is None
    with pytest.raises(ValueError):
        files.read_checkpoint("../x")
    monkeypatch.setenv("SPANLOOM_ONTOLOGY_DIR", str(tmp_path))
    assert files.ontology_dir() == tmp_path
    t = spark.createDataFrame([("a b",), ("B  a",), (None,)], "t string")
    v = [r.v for r in t.select(embeddings.hashed("t", 16).alias("v")).collect()]
    assert len(v[0]) == 16 and v[0] == v[1] and sum(map(abs, v[0])) == 2
    model = embeddings.embedder(lambda: lambda texts: [[float(len(x))] for x in texts], 2)
    assert [r.v for r in t.select(model("t").alias("v")).collect()] == [[3.0], [4.0], [0.0]]
