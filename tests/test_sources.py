from __future__ import annotations

import json

import pytest

from quillgraph.sources import jsonld, rdfxml, turtle
from quillgraph.sources.files import empty_graph, load_jsonld, read_graphs
from quillgraph.vocab import BF, BFLC, CONTEXT, FIRST, LABEL, NIL, RDF, REST, TYPE, XSD

TURTLE = """@prefix bf: <http://id.loc.gov/ontologies/bibframe/> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
@base <http://ex.org/> .
# a comment
<w1> a bf:Work, bf:Text ; bf:title [ a bf:Title ; bf:mainTitle "A \\"title\\"\\u00e9"@EN, '''long
text''' ] ;
  bf:list ( "a" <b> _:c ) ; bf:n 12, 1.5, 2e3, true ; bf:date "2020-01-01"^^xsd:date ; .
_:c rdfs:label "c" .
[] rdfs:label "alone" .
[ rdfs:label "list" ] .
"""


def shape(triples):
    """Triples with blank nodes by the triples around them, so that names don't count."""
    names = {t[0] for t in triples if t[1] == "b"} | {t[3] for t in triples if t[4] == "b"}
    color = dict.fromkeys(names, "")
    for _ in range(6):
        color = {n: str(hash(tuple(sorted((t[2], color.get(t[3], t[3]) if t[4] == "b" else t[3], str(t[5:])) for t in triples if t[0] == n) + sorted(("in", t[2], color.get(t[0], t[0]) if t[1] == "b" else t[0]) for t in triples if t[3] == n and t[4] == "b")))) for n in names}
    return sorted(tuple(str(color.get(x, x)) for x in t) for t in triples)


def test_turtle():
    out = turtle.parse(TURTLE)
    s = "http://ex.org/w1"
    assert (s, "u", TYPE, BF + "Work", "u", None, None) in out and (s, "u", BF + "date", "2020-01-01", "l", XSD + "date", None) in out
    assert {(t[3], t[5]) for t in out if t[2] == BF + "n"} == {("12", XSD + "integer"), ("1.5", XSD + "decimal"), ("2e3", XSD + "double"), ("true", XSD + "boolean")}
    assert {(t[3], t[6]) for t in out if t[2] == BF + "mainTitle"} == {('A "title"é', "en"), ("long\ntext", None)}
    assert len([t for t in out if t[2] == FIRST]) == 3 and [t for t in out if t[2] == REST and t[3] == NIL]
    assert len([t for t in out if t[2] == LABEL and t[1] == "b"]) == 3
    for bad in ("<a> <b> .", "x:y a z:w .", "<a> <b> 'c'", "<a <b> <c> ."):
        with pytest.raises(ValueError):
            turtle.parse(bad)


def test_jsonld_forms():
    compact = {"@id": "http://ex.org/w1", "@type": ["Work", "Text"], "title": {"@type": "Title", "mainTitle": ["x", {"@value": "y", "@language": "ko-Hang"}]}, "hasInstance": "http://ex.org/i1", "bflc:aap": "z", "rdfs:label": 3}
    before = json.dumps(compact)
    out = jsonld.parse(compact)
    assert json.dumps(compact) == before
    s = "http://ex.org/w1"
    assert (s, "u", BF + "hasInstance", "http://ex.org/i1", "u", None, None) in out and (s, "u", BFLC + "aap", "z", "l", None, None) in out and (s, "u", LABEL, "3", "l", XSD + "integer", None) in out
    assert {t[6] for t in out if t[2] == BF + "mainTitle"} == {None, "ko-hang"}
    assert shape(jsonld.parse(jsonld.expanded_list(out))) == shape(out)
    # a list has no default context: bare terms say nothing
    assert jsonld.parse([{"@id": "http://ex.org/a", "title": "x", BF + "note": [{"@value": "y"}]}]) == [("http://ex.org/a", "u", BF + "note", "y", "l", None, None)]
    for bad in (3, "3", '"x"'):
        with pytest.raises(ValueError):
            jsonld.parse(bad)


def test_jsonld_context():
    doc = {
        "@context": [{"ex": "http://ex.org/", "name": {"@id": "ex:name", "@container": "@language"}, "items": {"@id": "ex:items", "@container": "@list"}, "when": {"@id": "ex:when", "@type": "xsd:date"}, "xsd": XSD, "id": "@id", "part": {"@reverse": "ex:whole"}, "no": None, "@language": "fr"}],
        "@graph": [{"id": "ex:a", "name": {"en": "A", "de": ["B"]}, "items": [1, 2], "when": "2020", "ex:t": "x", "part": {"id": "ex:b"}, "no": "n"}, {"@id": "ex:c", "@reverse": {"ex:of": {"id": "ex:d"}}}],
    }
    out = jsonld.parse(doc)
    assert {(t[3], t[6]) for t in out if t[2].endswith("/name")} == {("A", "en"), ("B", "de")}
    assert ("http://ex.org/b", "u", "http://ex.org/whole", "http://ex.org/a", "u", None, None) in out and ("http://ex.org/d", "u", "http://ex.org/of", "http://ex.org/c", "u", None, None) in out
    assert ("http://ex.org/a", "u", "http://ex.org/t", "x", "l", None, "fr") in out and ("http://ex.org/a", "u", "http://ex.org/when", "2020", "l", XSD + "date", None) in out
    assert [t[3] for t in out if t[2] == FIRST] and not [t for t in out if t[3] == "n"]


def test_frame_round_trip():
    triples = turtle.parse(TURTLE)
    own = [t for t in triples if not (t[2] == LABEL and t[3] in ("alone", "list"))]
    framed = jsonld.frame("http://ex.org/w1", own)
    assert "@context" not in framed and framed["@type"] == ["Text", "Work"] and framed["title"]["@type"] == "Title" and isinstance(framed["title"]["mainTitle"], list)
    assert framed["list"]["@list"][0] == "a" and framed["date"] == {"@type": XSD + "date", "@value": "2020-01-01"}
    assert shape(jsonld.parse({"@context": CONTEXT} | framed)) == shape(own)
    cycle = [("w", "u", BF + "x", "b", "b", None, None), ("b", "b", BF + "y", "w", "u", None, None), ("b", "b", BF + "instanceOf", "http://ex.org/q", "u", None, None)]
    assert jsonld.frame("w", cycle) == {"@id": "w", "x": {"y": {"@id": "w"}, "instanceOf": "http://ex.org/q"}}
    assert jsonld.frame("w", [("w", "u", "http://other.org/p", "1", "l", XSD + "string", None)])["http://other.org/p"] == {"@type": XSD + "string", "@value": "1"}


XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:bf="http://id.loc.gov/ontologies/bibframe/" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:lang="en">
<bf:Work rdf:about="http://ex.org/w"><bf:title><bf:Title><bf:mainTitle>Rain &amp; rivers</bf:mainTitle></bf:Title></bf:title><bf:note rdf:parseType="Resource"><rdfs:label xml:lang="">n</rdfs:label></bf:note>
<bf:date rdf:datatype="http://www.w3.org/2001/XMLSchema#date">2020</bf:date><bf:of rdf:resource="http://ex.org/x"/><bf:seq rdf:parseType="Collection"><rdf:Description rdf:about="http://ex.org/y"/></bf:seq></bf:Work>
<rdf:Description rdf:about="http://ex.org/w"><bf:title><bf:Title><bf:mainTitle>Rain &amp; rivers</bf:mainTitle></bf:Title></bf:title><bf:agent rdfs:label="l"/></rdf:Description></rdf:RDF>"""


def test_rdfxml():
    out = rdfxml.parse(XML)
    assert len([t for t in out if t[2] == BF + "title"]) == 2 and {t[6] for t in out if t[2] == BF + "mainTitle"} == {"en"}
    assert ("http://ex.org/w", "u", BF + "date", "2020", "l", XSD + "date", None) in out and ("http://ex.org/w", "u", BF + "of", "http://ex.org/x", "u", None, None) in out
    assert [t for t in out if t[2] == FIRST and t[3] == "http://ex.org/y"] and {t[6] for t in out if t[2] == LABEL} == {None, "en"}
    assert [t[3] for t in out if t[2] == TYPE and t[1] == "u"] == [BF + "Work"]
    assert RDF in TYPE


def test_files(spark, tmp_path):
    (tmp_path / "b.ttl").write_text(TURTLE)
    (tmp_path / "a.jsonld").write_text(json.dumps({"@id": "http://ex.org/1", "title": "x"}))
    (tmp_path / "c.xml").write_text(XML)
    (tmp_path / "bad.jsonld").write_text("{")
    (tmp_path / "none.jsonld").write_text("[]")
    triples, errors = read_graphs(spark, str(tmp_path))
    assert {r["record_id"].rsplit("/", 1)[1]: r["n"] for r in triples.groupBy("record_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {"a.jsonld": 1, "b.ttl": len(turtle.parse(TURTLE)), "c.xml": len(rdfxml.parse(XML))}
    assert [r["record_id"].rsplit("/", 1)[1] for r in errors.collect()] == ["bad.jsonld"]
    assert empty_graph(spark).count() == 0 and load_jsonld(spark, {"@id": "http://ex.org/1", "title": "x"}).count() == 1
