"""Set algebra over triples: inference, relation mentions, rewriting, fingerprints and duplicate values."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import carried, object_key, sized, vocabulary_term
from ..plans.session import checkpoint
from ..schema import TRIPLE
from ..vocab import ADMIN, BF, DERIVED_FROM, EXCLUDED, HUB, INSTANCE, INVERSES, LABELS, RELATION_PREDICATES, TYPE, TYPE_RULES, WORK
from .closure import blank_edges, description, links_by_type, reach, without_nodes


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples of a pattern; unset positions are free."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def value(triples: DataFrame, p: str, o: str | None = None) -> DataFrame:
    """``record_id, s, value``: of each subject the least object of a predicate; with ``o``, of each record the least subject that has it."""
    if o is None:
        return triples.where(F.col("p") == p).groupBy("record_id", "s").agg(F.min("o").alias("value"))
    return match(triples, p=p, o=o).groupBy("record_id").agg(F.min("s").alias("value"))


def subjects(triples: DataFrame, class_: str | None = None) -> DataFrame:
    """``record_id, subject, error``: the one subject of each record that has the class, or the one IRI there is if ``class_`` is unset.

    Of several, IRIs alone are looked at. Where that doesn't leave one, the subject is null and the error says how many
    there are. A class that isn't an IRI is a ValueError.
    """
    if class_ is not None and (not isinstance(class_, str) or ":" not in class_):
        raise ValueError(f"a class is an IRI, not {class_!r}")
    records = triples.select("record_id").distinct()
    found = triples.where("s_kind = 'u'") if class_ is None else match(triples, p=TYPE, o=class_)
    counted = found.select("record_id", "s", "s_kind").distinct().groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("any"), F.count(F.when(F.col("s_kind") == "u", 1)).alias("iris"), F.min(F.when(F.col("s_kind") == "u", F.col("s"))).alias("iri")
    )
    one = F.when(F.col("n") == 1, F.col("any")).when(F.col("iris") == 1, F.col("iri"))
    said = F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" subjects"))
    return records.join(counted, "record_id", "left").select("record_id", one.alias("subject"), F.when(one.isNull(), said).alias("error"))


def skeleton(triples: DataFrame) -> DataFrame:
    """The triples that decide which entities there are and what they are derived from: links to blank nodes, types and a few predicates."""
    deciding = {TYPE, ADMIN, DERIVED_FROM, BF + "relation", *RELATION_PREDICATES, *(p for pair in INVERSES for p in pair)}
    return triples.where((F.col("o_kind") == "b") | F.col("p").isin(*sorted(deciding)))


def relation_mentions(triples: DataFrame, predicates: Sequence[str] = RELATION_PREDICATES) -> DataFrame:
    """``record_id, node``: blank nodes that only stand for the other end of a relation, and all blank nodes below."""
    relations = triples.where((F.col("p") == BF + "relation") & (F.col("o_kind") != "l")).select("record_id", F.col("o").alias("s"))
    relations = relations.unionByName(triples.where((F.col("p") == TYPE) & (F.col("o") == BF + "Relation")).select("record_id", "s")).distinct()
    seeds = triples.where(F.col("p").isin(*predicates) & (F.col("o_kind") == "b")).join(relations, ["record_id", "s"], "left_semi").select("record_id", F.col("o").alias("root"), F.col("o").alias("node"))
    return reach(blank_edges(triples), seeds).select("record_id", "node").distinct()


def inferred(triples: DataFrame, mentions: DataFrame, inverses: Sequence[tuple[str, str]] = INVERSES, types: Sequence[tuple[str, str]] = TYPE_RULES) -> DataFrame:
    """The inverse links that ``triples``, a set, doesn't have, and types of the links' ends unless those are mentions.

    Only links and types are compared with what is there, so the bulk of the triples isn't moved.
    """
    none = F.lit(None).cast("string")
    key = ["record_id", "s", "p", "o"]
    ends = triples.where("o_kind <> 'l'")

    def turned(p: str, q: str) -> DataFrame:
        return ends.where(F.col("p") == p).select("record_id", F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), F.lit(q).alias("p"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))

    both = [turned(a, b) for p, q in inverses for a, b in ((p, q), (q, p))]
    found = reduce(DataFrame.unionByName, both).dropDuplicates(key)
    known = ends.where(F.col("p").isin(*[x for pair in inverses for x in pair]))
    new_links = checkpoint(found.join(known.select(*key), key, "left_anti"))
    rules = triples.sparkSession.createDataFrame(list(types), "p string, type string")
    linked = ends.where(F.col("p").isin(*[p for p, _ in types])).select(*TRIPLE).unionByName(new_links.select(*TRIPLE).where(F.col("p").isin(*[p for p, _ in types])))
    given = linked.join(F.broadcast(rules), "p").select("record_id", F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), F.lit(TYPE).alias("p"), F.col("type").alias("o")).dropDuplicates(key)
    given = given.join(mentions.withColumnRenamed("node", "s"), ["record_id", "s"], "left_anti").join(ends.where(F.col("p") == TYPE).select(*key), key, "left_anti")
    typed = given.select("record_id", "s", "s_kind", "p", "o", F.lit("u").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    return new_links.select(*TRIPLE).unionByName(typed)


def infer(triples: DataFrame, mentions: DataFrame, **given) -> DataFrame:
    """``triples``, a set, with what follows from its links."""
    return triples.select(*TRIPLE).unionByName(inferred(triples, mentions, **given))


def entities(triples: DataFrame, mentions: DataFrame, *classes: str) -> DataFrame:
    """``record_id, class, entity, kind``: subjects of the classes that are no mentions; a work that is a hub is a hub only."""
    typed = triples.where((F.col("p") == TYPE) & (F.col("o_kind") == "u"))
    found = typed.where(F.col("o").isin(*classes)).select("record_id", F.col("o").alias("class"), F.col("s").alias("entity"), F.col("s_kind").alias("kind")).distinct()
    found = found.join(mentions.withColumnRenamed("node", "entity"), ["record_id", "entity"], "left_anti")
    if WORK in classes:
        hubs = typed.where(F.col("o") == HUB).select("record_id", F.col("s").alias("entity"), F.lit(WORK).alias("class"))
        found = found.join(hubs, ["record_id", "entity", "class"], "left_anti")
    return found.select("record_id", "class", "entity", "kind")


def other_resources(triples: DataFrame, described: DataFrame) -> DataFrame:
    """``record_id, class, entity, kind``: IRIs named in the descriptions that are described themselves but are no hub, work or instance."""
    named = described.where("o_kind = 'u'").where(~vocabulary_term("o")).select("record_id", F.col("o").alias("entity")).distinct()
    main = triples.where((F.col("p") == TYPE) & F.col("o").isin(WORK, INSTANCE, HUB)).select("record_id", F.col("s").alias("entity")).distinct()
    subjects = triples.select("record_id", F.col("s").alias("entity")).distinct()
    found = named.join(main, ["record_id", "entity"], "left_anti").join(subjects, ["record_id", "entity"], "left_semi")
    return found.select("record_id", F.lit("OtherResource").alias("class"), "entity", F.lit("u").alias("kind"))


def rewrite(triples: DataFrame, renamed: DataFrame) -> DataFrame:
    """All renamings ``record_id, old, new`` at once, in subjects and objects but never in predicates or literals.

    Where old and new stand in both places both are rewritten. Renamings hold inside a record, so a record's are sent to its
    triples as one map, which is no larger than the record, and the triples are moved once.
    """
    of = renamed.groupBy("record_id").agg(F.map_from_entries(F.collect_set(F.struct("old", "new"))).alias("to"))
    met = triples.select(*TRIPLE).join(of, "record_id", "left")
    subject, object_ = F.col("to")[F.col("s")], F.when(F.col("o_kind") != "l", F.col("to")[F.col("o")])
    changed = met.select(
        "record_id", F.coalesce(subject, "s").alias("s"), F.when(subject.isNotNull(), "u").otherwise(F.col("s_kind")).alias("s_kind"), "p",
        F.coalesce(object_, "o").alias("o"), F.when(object_.isNotNull(), "u").otherwise(F.col("o_kind")).alias("o_kind"), "o_dt", "o_lang",
    )
    return changed.dropDuplicates(TRIPLE)


def strip_excluded(triples: DataFrame, rules: Sequence[tuple[str, str]] = EXCLUDED) -> DataFrame:
    """``triples`` without values of excluded (predicate, type), with all that belongs to them."""
    return without_nodes(triples, links_by_type(triples, list(rules)))


#: Visits that following all paths from the nodes of one record on or above a cycle may take.
MOST_VISITS = 2_000_000


def _digest(parts: list[str]) -> str:
    return hashlib.sha256(("{" + "|".join(sorted(parts)) + "}").encode()).hexdigest()


def _by_paths(fixed: dict[str, list[str]], below: dict[str, list[tuple[str, str]]], most: int) -> dict[str, str] | None:
    """Fingerprints of the keys of ``below`` by all paths from each, where a node met again on its path is a mark; None beyond ``most`` visits."""
    out, visits = {}, 0
    for start in below:
        path, done = {start}, None
        stack = [(start, iter(below[start]), list(fixed[start]), "")]
        while stack:
            node, rest, parts, p = stack[-1]
            if done is not None:
                parts.append(p + done)
                done = None
            for p, o in rest:
                if o in path:
                    parts.append(p + "<cycle>")
                    continue
                visits += 1
                if visits > most:
                    return None
                stack[-1] = (node, rest, parts, p)
                stack.append((o, iter(below[o]), list(fixed[o]), ""))
                path.add(o)
                break
            else:
                done = _digest(parts)
                stack.pop()
                path.discard(node)
        out[start] = done
    return out


def _by_colours(fixed: dict[str, list[str]], below: dict[str, list[tuple[str, str]]]) -> dict[str, str]:
    """Fingerprints by refinement: nodes are told apart by their content, then by that of what they lead to, until no more are."""
    colour = {n: _digest([*fixed[n], *(p + "<node>" for p, _ in below[n])]) for n in below}
    kinds = len(set(colour.values()))
    for _ in below:
        colour = {n: _digest([*fixed[n], colour[n], *(p + colour[o] for p, o in below[n])]) for n in below}
        if (now := len(set(colour.values()))) == kinds:
            break
        kinds = now
    return colour


def _cyclic(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fingerprints of the nodes of one record whose blank nodes are on or above a cycle.

    Nodes are as the paths from them read; where there are too many paths, as far as refinement tells them apart.
    """
    fixed, below = {}, {}
    for row in pdf.itertuples():
        fixed.setdefault(row.s, list(row.parts))
        below.setdefault(row.s, [])
        if row.key is None:
            below[row.s].append((row.p, row.o))
        else:
            fixed[row.s].append(row.p + row.key)
    fps = _by_paths(fixed, below, MOST_VISITS) or _by_colours(fixed, below)
    return pd.DataFrame({"record_id": pdf["record_id"].iloc[0], "node": list(fps), "fp": list(fps.values())})


def fingerprints(triples: DataFrame) -> DataFrame:
    """``record_id, node, fp`` for every subject and blank node: a hash of its predicates and objects, blank nodes by their content.

    The triples are read once, into one row a node with the parts that name no blank node; nodes are settled from the leaves
    up, and a level moves the links to blank nodes that still wait. What is left when a level settles nothing is on or above
    a cycle; those nodes of a record are done together, as the result there depends on the path.
    """
    blank = F.col("o_kind") == "b"
    part = F.concat(sized("p"), object_key())
    held = triples.groupBy("record_id", "s").agg(F.collect_list(F.when(~blank, part)).alias("parts"), F.count(F.when(blank, 1)).alias("waits"))
    held = checkpoint(held)
    waiting = checkpoint(triples.where(blank).select("record_id", "s", sized("p").alias("p"), "o", F.lit(None).cast("string").alias("key")))
    hashed = lambda parts: F.sha2(F.concat(F.lit("{"), F.array_join(F.sort_array(parts), "|"), F.lit("}")), 256)
    # a blank node without triples of its own has an empty content
    bare = waiting.select("record_id", F.col("o").alias("node")).distinct().join(held.select("record_id", F.col("s").alias("node")), ["record_id", "node"], "left_anti").withColumn("fp", F.sha2(F.lit("{}"), 256))
    done = checkpoint(held.where("waits = 0").select("record_id", F.col("s").alias("node"), hashed(F.col("parts")).alias("fp")).unionByName(bare))
    open_, settled = held.where("waits > 0").select("record_id", "s", "parts"), done
    while not waiting.isEmpty():
        met = waiting.join(settled.select("record_id", F.col("node").alias("o"), F.col("fp").alias("__fp")), ["record_id", "o"], "left")
        waiting = checkpoint(met.select("record_id", "s", "p", "o", F.coalesce("key", "__fp").alias("key")))
        ready = waiting.groupBy("record_id", "s").agg(F.collect_list(F.concat("p", "key")).alias("more"), F.count(F.when(F.col("key").isNull(), 1)).alias("missing")).where("missing = 0")
        settled = checkpoint(ready.join(open_, ["record_id", "s"]).select("record_id", F.col("s").alias("node"), hashed(F.concat("parts", "more")).alias("fp")))
        if settled.isEmpty():
            break
        done = done.unionByName(settled)
        waiting = waiting.join(settled.select("record_id", F.col("node").alias("s")), ["record_id", "s"], "left_anti")
    cyclic = waiting.join(open_, ["record_id", "s"]).select("record_id", "s", "p", "o", "key", "parts").groupBy("record_id").applyInPandas(_cyclic, "record_id string, node string, fp string")
    return done.unionByName(cyclic)


def labelled(triples: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``record_id, node, label``: of each subject the label of the first predicate that it has."""
    rank = F.coalesce(*[F.when(F.col("p") == p, F.lit(k)) for k, p in enumerate(labels)])
    return triples.where(F.col("p").isin(*labels)).groupBy("record_id", F.col("s").alias("node")).agg(F.trim(F.min_by("o", F.struct(rank, F.col("o")))).alias("label"))


def copies(values: DataFrame, named: DataFrame) -> DataFrame:
    """Of values ``record_id, s, p, node, fp`` those that are held more than once."""
    met = values.join(named, ["record_id", "node"], "left")
    return met.groupBy("record_id", "s", "p", "fp").agg(F.count(F.lit(1)).alias("copies"), F.min("label").alias("label")).where("copies > 1").drop("fp")


def duplicate_values(triples: DataFrame, prints: DataFrame | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """``record_id, s, p, copies, label``: subjects that have the same blank node value more than once under a predicate."""
    prints = fingerprints(triples) if prints is None else prints
    values = triples.where("o_kind = 'b'").select("record_id", "s", "p", F.col("o").alias("node")).distinct().join(prints, ["record_id", "node"])
    return copies(values, labelled(triples, labels))


def bibframe_classes(described: DataFrame) -> DataFrame:
    """``record_id, entity, uri``: types of the entities themselves that are in the main namespace."""
    return described.where((F.col("p") == TYPE) & (F.col("s") == F.col("entity")) & F.col("o").startswith(BF)).select("record_id", "entity", F.col("o").alias("uri")).distinct()


__all__ = ["bibframe_classes", "carried", "description", "duplicate_values", "entities", "fingerprints", "infer", "inferred", "match", "other_resources", "relation_mentions", "rewrite", "skeleton", "strip_excluded", "subjects", "value"]
