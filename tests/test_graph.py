from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.closure import blank_edges, description, reach
from quillgraph.operators.graph import duplicate_values, entities, fingerprints, infer, other_resources, relation_mentions, rewrite, strip_excluded
from quillgraph.schema import TRIPLES
from quillgraph.sources import rdfxml, turtle
from quillgraph.vocab import BF, HUB, INSTANCE, LABEL, WORK

from .test_sources import XML

HEAD = "@prefix bf: <http://id.loc.gov/ontologies/bibframe/> . @prefix bflc: <http://id.loc.gov/ontologies/bflc/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix dc: <http://purl.org/dc/terms/> . @prefix l: <http://id.loc.gov/ontologies/lclocal/> . @base <http://ex.org/> .\n"


def graph(spark, **records):
    """Triples of records in Turtle, by record id."""
    return spark.createDataFrame([(k, *t) for k, text in records.items() for t in turtle.parse(HEAD + text)], TRIPLES)


def none(spark):
    return spark.createDataFrame([], "record_id string, node string")


def roots(spark, *pairs):
    return spark.createDataFrame([(r, WORK, e) for r, e in pairs], "record_id string, class string, entity string")


def test_description(spark):
    g = graph(spark, a='<w> a bf:Work ; bf:x [ bf:y [ rdfs:label "z" ] ] ; dc:modified "m" ; l:note [ rdfs:label "gone" ] ; bf:q dc:thing ; bf:lit "http://purl.org/dc/terms/x" . <v> bf:x [ rdfs:label "other" ] .', b="<w> bf:c _:1 . _:1 bf:c _:2 ; rdfs:label 'one' . _:2 bf:c _:1 ; rdfs:label 'two' ; dc:a 'x' . ")
    out = {r["record_id"]: r["n"] for r in description(g, roots(spark, ("a", "http://ex.org/w"), ("b", "http://ex.org/w"))).groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out == {"a": 5, "b": 5}


def test_reach_matches_search(spark):
    rng = random.Random(3)
    edges = sorted({(r, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for r in ("a", "b") for _ in range(30)})
    seeds = [("a", "s", "n0"), ("a", "t", "n1"), ("b", "s", "n2")]
    out = {tuple(r) for r in reach(spark.createDataFrame(edges, "record_id string, s string, o string"), spark.createDataFrame(seeds, "record_id string, root string, node string")).select("record_id", "root", "node").collect()}
    expected = set()
    for r, root, n in seeds:
        todo = [n]
        while todo:
            x = todo.pop()
            if (r, root, x) not in expected:
                expected.add((r, root, x))
                todo += [o for q, s, o in edges if q == r and s == x]
    assert out == expected


RELATION = '<w> a bf:Work ; bf:relation [ a bf:Relation ; bf:associatedResource [ a bf:Work ; rdfs:label "m" ; bf:hasInstance [ rdfs:label "mi" ] ] ] ; bf:relation [ bflc:associatedResource <u> ] ; bf:hasInstance [ rdfs:label "new" ] .'


def test_mentions_and_inference(spark):
    g = graph(spark, a=RELATION)
    m = relation_mentions(g)
    assert m.count() == 2
    inferred = infer(g, m).cache()
    assert entities(inferred, m, WORK).count() == 1 and entities(inferred, m, INSTANCE).count() == 1
    assert inferred.where(F.col("p") == BF + "instanceOf").count() == 2  # links of mentions are made too
    assert infer(inferred, m).count() == inferred.count()


def test_hub_is_no_work(spark):
    g = graph(spark, a="<h> a bf:Hub, bf:Work . <w> a bf:Work .", b="<h> a bf:Work .")
    assert sorted((r["record_id"], r["entity"][-1]) for r in entities(g, none(spark), WORK).collect()) == [("a", "w"), ("b", "h")]
    assert entities(g, none(spark), HUB).count() == 1


def test_others(spark):
    g = graph(spark, a='<w> a bf:Work ; bf:subject <s>, <bare>, bf:Text ; bf:x [ bf:agent <ag> ] ; bf:hasInstance <i> . <s> rdfs:label "s" ; bf:of <far> . <far> rdfs:label "f" . <ag> rdfs:label "a" . <i> a bf:Instance . bf:Text rdfs:label "t" .')
    found = description(g, roots(spark, ("a", "http://ex.org/w")))
    assert sorted(r["entity"] for r in other_resources(g, found).collect()) == ["http://ex.org/ag", "http://ex.org/s"]


def test_rewrite(spark):
    g = graph(spark, a='<old> bf:x <old> ; <old> "old" ; bf:lit "http://ex.org/old" . _:b bf:y <old> .', b="<old> bf:x <y> .")
    names = spark.createDataFrame([("a", "http://ex.org/old", "http://ex.org/new"), ("a", "_nb", "http://ex.org/made")], "record_id string, old string, new string")
    out = {(r["record_id"], r["s"], r["s_kind"], r["p"], r["o"], r["o_kind"]) for r in rewrite(g, names).collect()}
    n, o = "http://ex.org/new", "http://ex.org/old"
    assert out == {("a", n, "u", BF + "x", n, "u"), ("a", n, "u", o, "old", "l"), ("a", n, "u", BF + "lit", o, "l"), ("a", "http://ex.org/made", "u", BF + "y", n, "u"), ("b", o, "u", BF + "x", "http://ex.org/y", "u")}


def test_strip(spark):
    g = graph(spark, a='<w> bf:identifiedBy [ a bf:OclcNumber ; bf:source [ rdfs:label "x" ] ], [ a bf:Isbn ], <u> ; bf:other [ a bf:OclcNumber ] .')
    assert strip_excluded(g).count() == 5


def test_fingerprints_and_duplicates(spark):
    g = graph(
        spark,
        same='<w> bf:t [ rdfs:label " x " ; bf:a [ bf:v "1" ] ], [ bf:a [ bf:v "1" ] ; rdfs:label " x " ], [ rdfs:label " x " ] .',
        near='<w> bf:t [ a bf:T ; rdfs:label "x" ], [ rdfs:label "x" ] ; bf:n [ rdfs:label "x"@en ], [ rdfs:label "x"@fr ] ; bf:m "x", "x" ; bf:k [ bf:a [ bf:v "1" ], [ bf:v "1" ] ], [ bf:a [ bf:v "1" ] ] .',
        nested='<w> bf:t [ bf:inner [ rdfs:label "y" ], [ rdfs:label "y" ] ] .',
        bare="<w> bf:t _:x, _:y .",
        cycle='<w> bf:t _:a, _:b . _:a bf:n _:a ; rdfs:label "c" . _:b bf:n _:b ; rdfs:label "c" .',
        apart='<w> bf:t _:a . <v> bf:t _:b . _:a rdfs:label "x" . _:b rdfs:label "x" .',
    )
    out = sorted((r["record_id"], r["s"][-1] if r["s"].startswith("http") else "b", r["p"].rsplit("/", 1)[1], r["copies"], r["label"]) for r in duplicate_values(g).collect())
    assert out == [("bare", "w", "t", 2, None), ("cycle", "w", "t", 2, "c"), ("near", "b", "a", 2, None), ("nested", "b", "inner", 2, "y"), ("same", "w", "t", 2, "x")]
    fp = {(r["record_id"], r["node"]): r["fp"] for r in fingerprints(g).collect()}
    assert len(fp) == g.select("record_id", "s").distinct().count() + 2  # and the two bare nodes, which are no subjects


def test_xml_duplicate(spark):
    g = spark.createDataFrame([("r", *t) for t in rdfxml.parse(XML)], TRIPLES)
    assert [(r["copies"], r["label"]) for r in duplicate_values(g).collect()] == [(2, "AI & society")]


@pytest.mark.parametrize("depth", [1, 9])
def test_long_chain(spark, depth):
    chain = [("r", "w", "u", BF + "p", "c0", "b", None, None)] + [("r", f"c{k}", "b", BF + "p", f"c{k + 1}", "b", None, None) for k in range(depth)] + [("r", f"c{depth}", "b", LABEL, "end", "l", None, None)]
    g = spark.createDataFrame(chain, TRIPLES)
    assert description(g, roots(spark, ("r", "w"))).count() == depth + 2 and blank_edges(g).count() == depth + 1
    assert fingerprints(g).count() == depth + 2
