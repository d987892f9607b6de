from __future__ import annotations

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph import LinkedGraph, Store, save_graph
from quillgraph.operators.identity import check_namespace
from quillgraph.operators.upsert import class_changes, decide, delete_using, last_link, latest_versions, move_subtype, relinked
from quillgraph.plans.save import DuplicateValueError, GraphError
from quillgraph.sources.jsonld import expanded_list
from quillgraph.sources.turtle import parse
from quillgraph.streaming.ingest import ingest, record_stream
from quillgraph.vocab import OTHER, STUB_STATUS, WORK

from .test_graph import HEAD, RELATION, graph

FULL = 'bf:adminMetadata [ a bf:AdminMetadata ; bf:status <http://id.loc.gov/vocabulary/mstatus/c> ]'
RECORDS = {
    # a work with an instance, an agent and a subject; what it points to is a stub
    "r1": f'<w1> a bf:Work, bf:Text ; bf:title [ a bf:Title ; bf:mainTitle "One" ] ; {FULL} ; bf:subject <s1> ; bf:contribution [ bf:agent <a1> ] ; bf:hasInstance <i1> ; bf:relatedTo <w2> ; bf:identifiedBy [ a bf:OclcNumber ; rdfs:label "1" ] . <w2> a bf:Work ; rdfs:label "Two" ; bf:subject <s1> . <s1> rdfs:label "S" . <a1> rdfs:label "A" .',
    # the stub's record comes later
    "r2": f'<w2> a bf:Work ; bf:title [ bf:mainTitle "Two in full" ] ; {FULL} ; bf:subject <s2> . <s2> rdfs:label "S2" . <s1> rdfs:label "S again" .',
    # and once more, pointed at
    "r3": f'<w3> a bf:Work ; {FULL} ; bf:relatedTo <w2> . <w2> a bf:Work ; rdfs:label "stub again" .',
    "r4": 'bf:none rdfs:label "x" . <h> a bf:Hub, bf:Work ; bf:place <p> . <p> rdfs:label "P" . [] a bf:Work ; bf:title [ bf:mainTitle "no name" ] .',
    "r5": RELATION.replace("<w>", "<w5>").replace("<u>", "<u5>"),
    "bad1": '<w9> a bf:Work ; bf:title [ bf:mainTitle "t" ], [ bf:mainTitle "t" ] .',
    "bad2": "<w8> a bf:Work, bf:Instance .",
}
STAMP = datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=datetime.UTC)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    out = save_graph(store, graph(spark, **RECORDS), stamp=STAMP, user="me")
    return store, out, {n: t.toPandas() for n, t in out.tables.items()}


def by_source(base, name):
    rows = base[base["derived_from"] == f"http://ex.org/{name}"]
    assert len(rows) == 1
    return rows.iloc[0]


def test_rejects(saved):
    assert {r["record_id"] for r in saved[1].rejects.collect()} == {"bad1", "bad2"}


def test_resources(saved):
    base = saved[2]["resource_base"]
    assert base.groupby("type").size().to_dict() == {"hubs": 1, "instances": 2, "other_resources": 5, "works": 5}
    w2 = by_source(base, "w2")
    assert "Two in full" in w2["data"] and not w2["is_stub"] and w2["uuid"] == w2["uri"].rsplit("/", 1)[1]
    i1 = by_source(base, "i1")
    assert i1["is_stub"] and STUB_STATUS in i1["data"] and i1["work_id"] == by_source(base, "w1")["id"]
    assert base["id"].is_unique and base["uri"].is_unique and base["uri"].notna().all()
    unnamed = base[(base["type"] == "works") & base["derived_from"].isna()].iloc[0]
    assert "no name" in unnamed["data"] and "adminMetadata" not in unnamed["data"] and unnamed["uri"].startswith("https://data.example.org/works/")
    assert "OclcNumber" not in by_source(base, "w1")["data"]
    assert set(base[base["type"] == "other_resources"]["uri"]) == {"http://ex.org/" + x for x in ("s1", "s2", "a1", "p")} | {STUB_STATUS}
    # r2 doesn't name s1, so what it says of it is no description of its own
    assert '"S"' in base[base["uri"] == "http://ex.org/s1"].iloc[0]["data"]


def test_versions_classes_links(saved):
    t = saved[2]
    base = t["resource_base"]
    w1, w2 = by_source(base, "w1"), by_source(base, "w2")
    versions = t["versions"].groupby("resource_id").size()
    assert versions[w2["id"]] == 2 and versions[w1["id"]] == 1 and set(t["versions"]["keycloak_user_id"]) == {"me"}
    names = t["bibframe_classes"].set_index("id")["name"]
    of = lambda i: sorted(names[c] for c in t["resource_bibframe_classes"].query("resource_id == @i")["bf_class_id"])
    assert of(w1["id"]) == ["Text", "Work"] and of(by_source(base, "h")["id"]) == ["Hub", "Work"]
    uris = base.set_index("id")["uri"]
    links = lambda i: sorted(uris[o].rsplit("/", 1)[1] for o in t["bibframe_other_resources"].query("bibframe_resource_id == @i")["other_resource_id"])
    assert links(w1["id"]) == ["a1", "s1"] and links(w2["id"]) == ["s2"] and links(by_source(base, "h")["id"]) == []
    assert not t["bibframe_other_resources"].duplicated(["other_resource_id", "bibframe_resource_id"]).any()


def test_mentions_are_not_saved(saved):
    data = " ".join(saved[2]["resource_base"].query("type == 'works'")["data"])
    assert data.count('"m"') == 1  # inside its relation only


def test_saved_again_is_a_fixpoint(spark, saved):
    store, out, before = saved
    again = save_graph(store, out.triples, stamp=STAMP, user="me", batch_id="b1")
    assert not {r["action"] for r in again.decisions.select("action").distinct().collect()} & {"insert"}
    after = {n: t.toPandas() for n, t in again.tables.items()}
    for n in before:
        assert len(before[n]) == len(after[n]), n
    applied = save_graph(store, graph(spark, x="<w77> a bf:Work ."), batch_id="b1")
    assert not applied.applied and len(store.table("resource_base").toPandas()) == len(before["resource_base"])


def test_one_by_one_is_the_batch(spark, tmp_path, saved):
    store = Store(spark, str(tmp_path / "s"))
    for k in ("r1", "r2", "r3"):
        save_graph(store, graph(spark, **{k: RECORDS[k]}), stamp=STAMP, user="me")
    one = store.table("resource_base").toPandas().set_index("uri")
    batch = saved[2]["resource_base"].set_index("uri")
    for uri, row in one.iterrows():
        if not uri.endswith("mstatus/incmp"):
            assert batch.loc[uri, "content_hash"] == row["content_hash"] and batch.loc[uri, "is_stub"] == row["is_stub"], uri
    assert len(store.table("versions").toPandas().groupby("resource_id").size().pipe(lambda s: s[s > 1])) >= 1


def test_primary_class(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    own = "<https://data.example.org/works/1>"
    first = f'{own} a bf:Work ; rdfs:label "full" ; {FULL} ; bf:subject <s> ; bf:hasInstance <https://data.example.org/instances/1> . <https://data.example.org/instances/1> rdfs:label "i" . <s> rdfs:label "s" .'
    save_graph(store, graph(spark, a=first), stamp=STAMP)
    work = lambda: store.table("resource_base").where("type = 'works'").first()
    before = work()["content_hash"]
    save_graph(store, graph(spark, a=f'<https://data.example.org/instances/1> a bf:Instance ; rdfs:label "new" ; bf:instanceOf {own} . {own} rdfs:label "only a label" .'), primary_class="http://id.loc.gov/ontologies/bibframe/Instance", stamp=STAMP)
    assert work()["content_hash"] == before and "new" in store.table("resource_base").where("type = 'instances'").first()["data"]
    save_graph(store, graph(spark, a=f'{own} a bf:Work ; rdfs:label "changed" ; bf:adminMetadata [ a bf:AdminMetadata ; bf:status <{STUB_STATUS}> ] ; bf:toc [ bf:status <{STUB_STATUS}> ] . <s> rdfs:label "s2" .'), primary_class=WORK, stamp=STAMP)
    assert "changed" in work()["data"] and not work()["is_stub"] and work()["data"].count("incmp") == 1
    save_graph(store, graph(spark, a='<s> rdfs:label "s3" .  <https://data.example.org/works/1> a bf:Work ; rdfs:label "changed" ; bf:subject <s> .'), update_other_resources=False, stamp=STAMP)
    assert '"s"' in store.table("resource_base").where("uri = 'http://ex.org/s'").first()["data"]
    save_graph(store, graph(spark, a='<s> rdfs:label "s3" .  <https://data.example.org/works/1> a bf:Work ; rdfs:label "changed" ; bf:subject <s> .'), primary_class=OTHER, stamp=STAMP)
    assert '"s3"' in store.table("resource_base").where("uri = 'http://ex.org/s'").first()["data"]


def test_strict_and_namespace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(DuplicateValueError, match="file: .*2 identical .*'t'"):
        save_graph(store, graph(spark, a=RECORDS["bad1"]), source="file", strict=True)
    assert store.table("resource_base").count() == 0
    with pytest.raises(TypeError):
        LinkedGraph(graph(spark, a="<a> <b> <c> ."), namespace=None)
    with pytest.raises(GraphError):
        LinkedGraph(graph(spark, a="<a> <b> <c> ."), namespace="not-a-url")
    assert check_namespace("https://example.edu") == "https://example.edu/"


def test_in_graph_identity(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    text = f'<https://data.example.org/works/7> a bf:Work ; rdfs:label "own" ; bf:adminMetadata [ bf:derivedFrom <w7> ; bf:status <http://id.loc.gov/vocabulary/mstatus/c> ] . <w7> a bf:Work ; bf:hasInstance <i7> . <i7> rdfs:label "i" ; {FULL} .'
    out = save_graph(store, graph(spark, a=text), stamp=STAMP)
    works = out.tables["resource_base"].where("type = 'works'").collect()
    assert [w["uri"] for w in works] == ["https://data.example.org/works/7"] and not works[0]["is_stub"] and works[0]["derived_from"] == "http://ex.org/w7"
    store.reset()
    assert store.table("resource_base").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.data())
def test_fold(spark, data):
    """Decisions for a batch are those of a fold, arrival by arrival."""
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    ingest_ = rng.random() < 0.7
    rows, stored = [], []
    for u in range(12):
        kind, full = rng.choice(["works", "other_resources"]), rng.random() < 0.8
        if rng.random() < 0.5:
            stored.append((f"u{u}", rng.random() < 0.5, rng.choice("xyz")))
        for s in rng.sample(range(50), rng.randint(1, 5)):
            stub = rng.random() < 0.5 and kind == "works"
            rows.append((f"u{u}", s, kind, stub, stub and rng.random() < 0.8, rng.random() < 0.5, full, rng.choice("xyz")))
    expected, state = {}, {u: (s, h) for u, s, h in stored}
    for u, s, kind, stub, marked, resolved, primary, h in sorted(rows, key=lambda r: (r[0], r[1])):
        if u not in state:
            expected[u, s] = "insert"
        elif not primary or kind == "works" and (stub or ingest_ and resolved and not state[u][0]):
            expected[u, s] = "keep"
            continue
        else:
            expected[u, s] = "noop" if state[u][1] == h else "update"
        state[u] = (marked, h)
    a = spark.createDataFrame(rows, "uri string, seq long, type string, stub boolean, marked boolean, resolved boolean, `primary` boolean, content_hash string")
    out = decide(a, spark.createDataFrame(stored, "uri string, is_stub boolean, content_hash string"), ingest_)
    assert {(r["uri"], r["seq"]): r["action"] for r in out.collect()} == expected
    assert relinked(out).count() <= 12


def test_small_operators(spark):
    links = spark.createDataFrame([("i", "b", 1), ("i", "a", 2), ("i", "c", 2), ("j", "z", 1)], "instance string, work string, seq long")
    assert {tuple(r) for r in last_link(links).select("instance", "work").collect()} == {("i", "c"), ("j", "z")}
    versions = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 6, "c")], "id long, resource_id long, data string")
    assert {r["data"] for r in latest_versions(versions).collect()} == {"b", "c"}
    old, new = (spark.createDataFrame(x, "resource_id long, uri string") for x in ([(1, "a"), (1, "b")], [(1, "b"), (1, "c")]))
    assert {(r["uri"], r["change"]) for r in class_changes(old, new).collect()} == {("a", "removed"), ("c", "added")}
    res = spark.createDataFrame([(1, "works"), (2, "works")], "id long, type string")
    assert {tuple(r) for r in move_subtype(res, res.where("id = 2"), "profiles").select("id", "type").collect()} == {(1, "works"), (2, "profiles")}
    assert delete_using(res, res.where("id = 2"), "id").count() == 1


def test_stream(spark, tmp_path):
    import json

    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.jsonld").write_text(json.dumps(expanded_list(parse(HEAD + f'<w{k}> a bf:Work ; rdfs:label "{k}" ; {FULL} .'))))
    (source / "bad.jsonld").write_text("{")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest(record_stream(spark, str(source)), store, str(tmp_path / "checkpoint"), "https://data.example.org/").awaitTermination()
    assert store.table("resource_base").where(F.col("type") == "works").count() == 2
