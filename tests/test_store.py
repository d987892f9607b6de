"""The store, documents written as given, and what saving keeps beside the resources."""

from __future__ import annotations

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from quillgraph import Store, save_graph
from quillgraph.operators.graph import fingerprints, subjects
from quillgraph.operators.search import best, match, parse_query, plain_query
from quillgraph.plans import session
from quillgraph.plans.direct import mint_profiles, reindex, unmint_profiles, views, write_documents
from quillgraph.plans.save import LinkError
from quillgraph.plans.store import ConflictError
from quillgraph.schema import LINEAGE, TABLES, migrate
from quillgraph.sources.jsonld import expanded_list
from quillgraph.sources.turtle import parse
from quillgraph.streaming.ingest import ingest, record_stream, rejected

from .test_graph import HEAD, graph

STAMP = datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=datetime.UTC)
WORK = '<w> a bf:Work ; bf:title [ bf:mainTitle "Renewable energy policy in Korea" ] ; bf:subject <s> ; bf:hasInstance <i> . <s> rdfs:label "Government policy" . '
INSTANCE = '<i> a bf:Instance ; bf:title [ bf:mainTitle "Chaesaeng enŏji kumae" ; bf:subtitle "Renewable energy policy in Korea" ] .'


def rows(spark, *more):
    schema = TABLES["resource_bibframe_classes"]
    return spark.createDataFrame(list(more), schema)


def test_pointer_survives_a_crash(spark, tmp_path, monkeypatch):
    """Between writing and publishing nothing is lost, and a second writer from the same state fails."""
    store = Store(spark, str(tmp_path), buckets=4)
    assert store.bootstrap() and not store.bootstrap() and Store(spark, str(tmp_path)).buckets == 4 and store.table("versions").isEmpty()
    store.commit({"resource_bibframe_classes": rows(spark, (1, 1, 1), (2, 1, 2))})
    state = store.state()
    monkeypatch.setattr(store, "_publish", lambda state: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        store.commit({"resource_bibframe_classes": rows(spark, (9, 9, 9))})
    monkeypatch.undo()
    assert store.state() == state and Store(spark, str(tmp_path)).table("resource_bibframe_classes").count() == 2
    assert Store(spark, str(tmp_path), buckets=99).buckets == 4
    store.commit({"resource_bibframe_classes": rows(spark, (3, 1, 3))}, state=state)
    with pytest.raises(ConflictError):
        store.commit({"resource_bibframe_classes": rows(spark, (4, 1, 4))}, state=state)
    assert [r["id"] for r in store.table("resource_bibframe_classes").collect()] == [3]


def test_buckets_batches_and_reset(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    store.commit({"resource_bibframe_classes": rows(spark, *[(k, 1, k) for k in range(20)])}, "stream#0")
    at = {r["resource_id"]: r["b"] for r in store.table("resource_bibframe_classes").select("resource_id", store.bucket("resource_id").alias("b")).collect()}
    before = store.state()["tables"]["resource_bibframe_classes"]
    only = [at[3]]
    stays = store.table("resource_bibframe_classes", only).where("resource_id <> 3")
    assert store.commit({"resource_bibframe_classes": stays}, "stream#1", {"resource_bibframe_classes": only})
    after = store.state()
    assert {k for k in before if before[k] != after["tables"]["resource_bibframe_classes"].get(k)} == {str(at[3])} and after["top"]["resource_bibframe_classes"] == 19
    assert sorted(r["resource_id"] for r in store.table("resource_bibframe_classes").collect()) == [k for k in range(20) if k != 3]
    assert not store.commit({"resource_bibframe_classes": rows(spark)}, "stream#1") and not store.commit({"resource_bibframe_classes": rows(spark)}, "stream#0") and after["batches"] == {"stream": 1}
    for k in range(4):
        store.commit({"versions": spark.createDataFrame([(k, 1, "d", None, None)], TABLES["versions"])}, f"stream#{k + 2}")
    assert store.table("versions").count() == 4 and len([n for n in os.listdir(tmp_path) if n.startswith("pointer-")]) == 2
    store.reset()
    assert store.table("versions").count() == 0 and store.commit({"resource_bibframe_classes": rows(spark, (1, 1, 1))}, "stream#1")


def test_save_then_search(spark, tmp_path):
    """Stored documents are framed, and the index follows what is saved."""
    store = Store(spark, str(tmp_path), buckets=4)
    save_graph(store, graph(spark, a=WORK + INSTANCE), stamp=STAMP)
    base = {r["type"]: r for r in store.resources().collect()}
    data = json.loads(base["works"]["data"])
    assert data["title"] == {"mainTitle": "Renewable energy policy in Korea"} and "@context" not in data and data["@id"] == base["works"]["uri"] and data["hasInstance"] == base["instances"]["uri"]
    assert store.by_uri(base["works"]["uri"]).first()["id"] == base["works"]["id"] and store.by_uri("http://none.example.org/").isEmpty()
    work, instance = base["works"]["id"], base["instances"]["id"]

    def found(text, config="simple", query=parse_query):
        return {r["resource_id"] for r in match(store.table("postings"), query(text, config)).collect()}

    assert found("renewable:A & korea") == {work} and found("renewable:B") == {instance}
    assert found("Renewable <-> energy") == {work, instance} and found("Chaesaeng <-> enŏji") == {instance} and found("Rene:* <-> ener:* <-> poli:* <-> in <-> Kor:*") == {work, instance}
    assert found("Renewable & policy | Korea", "english") == {work, instance} and found("Nope nada never", "english", plain_query) == set()
    assert found("renewable & !subtitle") == {work}
    order = best(store.table("postings"), parse_query("Renewable <-> energy <-> policy <-> in <-> Korea", "simple")).collect()
    assert [r["resource_id"] for r in order] == [work, instance] and order[0]["rank"] > order[1]["rank"]
    assert best(store.table("postings"), parse_query("renewable", "simple"), 1).count() == 1
    own = f'<{base["works"]["uri"]}> a bf:Work ; bf:title [ bf:mainTitle "zyxwv" ] .'
    save_graph(store, graph(spark, b=own), primary_class="http://id.loc.gov/ontologies/bibframe/Work", stamp=STAMP)
    assert found("zyxwv") == {work} and found("renewable") == {instance} and store.table("versions").count() == 4
    ways = views(store.tables())
    assert [tuple(r) for r in ways["work_instances"].collect()] == [(work, instance)] and ways["resource_versions"].where(F.col("from_id") == work).count() == 2


def test_links_need_both_ends(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    lost = "<h> a bf:Hub, bf:Work ; bf:hasInstance <i> . <i> a bf:Instance ."
    with pytest.raises(LinkError, match="file: .*which isn't there"):
        save_graph(store, graph(spark, a=lost), source="file", strict=True)
    assert store.state()["number"] == 0
    out = save_graph(store, graph(spark, a=lost, b="<w2> a bf:Work ."), stamp=STAMP)
    assert [tuple(r) for r in out.rejects.collect()] == [("a", "an instance of what is no work")] and store.resources("works").count() == 1 and store.resources("hubs").count() == 0
    out.release()
    with pytest.raises(ValueError):
        store.resources("cats")


def test_conflict_is_tried_again(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path), buckets=4), Store(spark, str(tmp_path), buckets=4)
    publish, met = store._publish, []

    def slow(state):
        if not met:
            met.append(save_graph(other, graph(spark, x="<w1> a bf:Work ."), stamp=STAMP))
        publish(state)

    monkeypatch.setattr(store, "_publish", slow)
    save_graph(store, graph(spark, y="<w2> a bf:Work ."), stamp=STAMP)
    found = store.resources("works").collect()
    assert {r["derived_from"] for r in found} == {"http://ex.org/w1", "http://ex.org/w2"} and {r["id"] for r in found} == {1, 2}


def test_direct_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    docs = [("http://ex.org/p", "profiles", '{"b": 1, "a": {"x": []}}'), ("http://ex.org/w", "works", json.dumps({"@id": "http://ex.org/w", "@type": ["Work", "Text"], "title": {"mainTitle": "T"}})), ("http://ex.org/n", "works", "[]")]
    schema = "uri string, type string, data string"
    assert write_documents(store, spark.createDataFrame(docs, schema), user="me", stamp=STAMP)
    stored = {r["uri"]: r for r in store.resources().collect()}
    assert stored["http://ex.org/p"]["data"] == docs[0][2] and json.loads(stored["http://ex.org/w"]["data"])["@type"] == ["Text", "Work"] and json.loads(stored["http://ex.org/n"]["data"]) == {"@id": "http://ex.org/n"}
    assert stored["http://ex.org/w"]["created_at"] == stored["http://ex.org/w"]["updated_at"]
    classes = store.table("resource_bibframe_classes").join(store.table("bibframe_classes").select(F.col("id").alias("bf_class_id"), "name"), "bf_class_id")
    assert {(r["resource_id"], r["name"]) for r in classes.collect()} == {(stored["http://ex.org/w"]["id"], "Work"), (stored["http://ex.org/w"]["id"], "Text")}
    again = [docs[0], ("http://ex.org/w", "works", '{"@id": "http://ex.org/w", "@type": "Work", "title": {"mainTitle": "U"}}')]
    write_documents(store, spark.createDataFrame(again, schema), stamp=STAMP)
    assert store.table("versions").count() == 4 and store.resources("profiles").count() == 1
    assert {r["resource_id"] for r in match(store.table("postings"), parse_query("u:A", "simple")).collect()} == {stored["http://ex.org/w"]["id"]}
    before = sorted(tuple(r) for r in store.table("postings").collect())
    assert before and reindex(store) and sorted(tuple(r) for r in store.table("postings").collect()) == before
    for wrong in ([(None, "works", "{}")], [("u", "cats", "{}")], [("u", "works", "{")], [("u", "works", "3")], [("u", "works", "{}"), ("u", "works", "{}")], [("http://ex.org/w", "profiles", "{}")]):
        with pytest.raises(ValueError):
            write_documents(store, spark.createDataFrame(wrong, schema))


def test_profiles_and_migration(spark):
    bare = spark.createDataFrame([(1, "profiles", None, None), (2, "works", "x", "http://ex.org/x")], "id long, type string, uuid string, uri string")
    made = {r["id"]: r for r in mint_profiles(bare, "https://data.example.org/").collect()}
    assert made[1]["uri"] == f"https://data.example.org/profiles/{made[1]['uuid']}" and made[2]["uri"] == "http://ex.org/x"
    back = {r["id"]: r for r in unmint_profiles(mint_profiles(bare, "https://data.example.org")).collect()}
    assert back[1]["type"] == "other_resources" and back[1]["uri"] is None and back[2]["type"] == "works"
    first = spark.createDataFrame([(1, "works", "{}")], "id long, type string, data string")
    for k in range(len(LINEAGE) + 1):
        assert migrate("resource_base", migrate("resource_base", first, 0, k), k, 0).columns == first.columns
    assert set(migrate("resource_base", first).columns) - set(first.columns) == {"hub_id", "derived_from", "is_stub", "content_hash"}


def test_subjects(spark):
    text = {"one": "<w> a bf:Work .", "two": "<w> a bf:Work . <x> a bf:Work .", "blank": "<w> a bf:Work . [] a bf:Work .", "none": "<i> a bf:Instance ."}
    out = {r["record_id"]: (r["subject"], r["error"]) for r in subjects(graph(spark, **text), "http://id.loc.gov/ontologies/bibframe/Work").collect()}
    assert out == {"one": ("http://ex.org/w", None), "two": (None, "2 subjects"), "blank": ("http://ex.org/w", None), "none": (None, "0 subjects")}
    assert {r["record_id"]: r["subject"] for r in subjects(graph(spark, **text)).collect()}["none"] == "http://ex.org/i"
    with pytest.raises(ValueError):
        subjects(graph(spark, **text), "Work")


def test_entangled_blank_nodes(spark):
    """Long chains above a cycle, and nodes that all name each other, end; equal content has equal fingerprints."""
    chain = " ".join(f"_:c{k} bf:next _:c{k + 1} ." for k in range(1500)) + " _:c1500 bf:next _:c1500 ."
    clique = " ".join(f"_:k{a} bf:to _:k{b} ." for a in range(12) for b in range(12) if a != b) + ' _:k0 rdfs:label "zero" .'
    ring = "_:r0 bf:n _:r1 . _:r1 bf:n _:r0 . _:q0 bf:n _:q1 . _:q1 bf:n _:q0 ."
    out = fingerprints(graph(spark, chain=chain, clique=clique, ring=ring)).collect()
    by = lambda name: {r["node"]: r["fp"] for r in out if r["record_id"] == name}
    assert len(by("chain")) == 1501 and len(set(by("chain").values())) == 1501
    assert len(by("clique")) == 12 and len(set(by("clique").values())) == 2
    assert len(set(by("ring").values())) == 1


def test_stream_keeps_what_it_leaves_out(spark, tmp_path):
    """Records that can't be read or saved are kept with the reason, and scratch data goes with its batch."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "good.jsonld").write_text(json.dumps(expanded_list(parse(HEAD + "<w> a bf:Work ."))))
    (source / "bad.jsonld").write_text("{")
    (source / "hub.jsonld").write_text(json.dumps(expanded_list(parse(HEAD + "<h> a bf:Hub, bf:Work ; bf:hasInstance <i> ."))))
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    shared = session.shared_dir(spark)
    before = set(os.listdir(shared.removeprefix("file:"))) if os.path.isdir(shared.removeprefix("file:")) else set()
    ingest(record_stream(spark, str(source)), store, str(tmp_path / "checkpoint"), "https://data.example.org/").awaitTermination()
    left = {r["record_id"].rsplit("/", 1)[1]: r["reason"] for r in rejected(store).collect()}
    assert store.resources("works").count() == 1 and set(left) == {"bad.jsonld", "hub.jsonld"} and left["hub.jsonld"] == "an instance of what is no work" and "JSON" in left["bad.jsonld"]
    after = set(os.listdir(shared.removeprefix("file:")))
    assert not [n for n in after - before if n.startswith("quillgraph-")]


def test_shared_folder_is_asked_for(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class X:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class Y:
                            isEmpty = staticmethod(lambda: True)  # noqa: N815

                        return Y

                return X

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
