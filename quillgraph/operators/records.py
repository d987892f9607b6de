"""What follows inside a record, for triples that lie by record: a record is read as a whole, and nothing is moved.

These give what the joins of ``graph`` and ``closure`` give. Records of more than ``MOST`` triples aren't gathered: they go
through those joins, which need no place for a whole record.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import carried, object_key, sized, vocabulary_term
from ..schema import TRIPLE
from ..vocab import BF, DCTERMS, HUB, INSTANCE, INVERSES, LABELS, LCLOCAL, RELATION_PREDICATES, TYPE, TYPE_RULES, WORK
from . import closure, graph

#: Triples of a record that are gathered in one row.
MOST = 200_000

#: Buckets of records whose rows are counted together before any triple is.
BUCKETS = 1 << 18

_NAMED = sorted({TYPE, BF + "relation", *RELATION_PREDICATES, *(p for pair in INVERSES for p in pair), *(p for p, _ in TYPE_RULES)})
_LOCAL = (LCLOCAL, DCTERMS)
_CODE = {p: k for k, p in enumerate(_NAMED)}
_NEW = "array<struct<s string, s_kind string, p string, o string, o_kind string>>"
_FOUND = {"mentions": "array<string>", "new": _NEW, "entities": "array<struct<class string, entity string, kind string>>", "members": "array<struct<class string, entity string, node string>>", "below": "array<struct<root string, node string>>"}


def reached(below: dict[str, list[str]], seeds: Iterable[str]) -> list[str]:
    """The seeds and all nodes that they lead to, each once."""
    seen = dict.fromkeys(seeds)
    todo = list(seen)
    while todo:
        for o in below.get(todo.pop(), ()):
            if o not in seen:
                seen[o] = None
                todo.append(o)
    return list(seen)


def _facts(what: str, s: list, s_kind: list, o: list, o_kind: list, code: list, kept: list) -> list:
    """Mentions, inferred triples, entities or the nodes of their descriptions, from the deciding triples of one record."""
    below, carried_below, relations, typed, known, links, seeds = {}, {}, set(), [], set(), [], []
    for row in zip(s, s_kind, o, o_kind, code, kept, strict=True):
        a, ak, b, bk, p, keep = row
        if bk == "b":
            below.setdefault(a, []).append(b)
            if keep:
                carried_below.setdefault(a, []).append(b)
        if p < 0:
            continue
        name = _NAMED[p]
        if name == TYPE:
            if b == BF + "Relation":
                relations.add(a)
            typed.append((a, ak, b, bk))
        elif bk != "l":
            if name == BF + "relation":
                relations.add(b)
            if name in RELATION_PREDICATES and bk == "b":
                seeds.append((a, b))
            links.append((a, ak, name, b, bk))
            known.add((a, name, b))
    mentions = reached(below, [b for a, b in seeds if a in relations])
    if what == "mentions":
        return mentions
    mentioned = set(mentions)
    new: dict[tuple, tuple] = {}
    for p, q in INVERSES:
        for x, y in ((p, q), (q, p)):
            for a, ak, name, b, bk in links:
                if name == x and (b, y, a) not in known:
                    new.setdefault((b, y, a), (b, bk, y, a, ak))
    added = list(new.values())
    rules: dict[str, list[str]] = {}
    for p, c in TYPE_RULES:
        rules.setdefault(p, []).append(c)
    have = {(a, b) for a, _, b, bk in typed if bk != "l"}
    for _, _, name, b, bk in [*links, *added]:
        for c in rules.get(name, ()):
            if b not in mentioned and (b, c) not in have:
                have.add((b, c))
                new[b, TYPE, c] = (b, bk, TYPE, c, "u")
    if what == "new":
        return list(new.values())
    hubs, main = set(), {}
    for a, ak, c, bk in [*typed, *((x[0], x[1], x[3], "u") for x in new.values() if x[2] == TYPE)]:
        if bk == "u" and c in (HUB, WORK, INSTANCE):
            if c == HUB:
                hubs.add(a)
            if a not in mentioned:
                main[c, a, ak] = None
    main = [x for x in main if x[0] != WORK or x[1] not in hubs]
    if what == "entities":
        return main
    for b, _, name, a, ak in added:
        if ak == "b" and not name.startswith(_LOCAL) and not a.startswith(_LOCAL):
            carried_below.setdefault(b, []).append(a)
    members = _members(carried_below, main)
    return members if what == "members" else list(dict.fromkeys((e, n) for _, e, n in members if n != e))


def _members(below: dict[str, list[str]], main: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    nodes: dict[str, list[str]] = {}
    out = []
    for c, e in dict.fromkeys(x[:2] for x in main):
        if e not in nodes:
            nodes[e] = reached(below, [e])
        out += [(c, e, n) for n in nodes[e]]
    return out


def _structs(rows: list[tuple], kind: pa.DataType) -> pa.Array:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(kind))


def _lists(groups: list[list], kind: pa.DataType) -> pa.Array:
    ends = [0]
    for g in groups:
        ends.append(ends[-1] + len(g))
    flat = [x for g in groups for x in g]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _structs(flat, kind) if pa.types.is_struct(kind) else pa.array(flat, kind))


def _struct_type(*names: str) -> pa.DataType:
    return pa.struct([pa.field(n, pa.string()) for n in names])


_ARROW = {"mentions": pa.string(), "new": _struct_type("s", "s_kind", "p", "o", "o_kind"), "entities": _struct_type("class", "entity", "kind"), "members": _struct_type("class", "entity", "node"), "below": _struct_type("root", "node")}


def gathered(column: pa.Array):
    """Of a column of lists of structs, each list's fields as lists."""
    offsets, values = column.offsets.to_pylist(), column.values
    fields = [values.field(k).to_pylist() for k in range(values.type.num_fields)]
    for a, b in zip(offsets, offsets[1:], strict=False):
        yield [f[a:b] for f in fields]


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows of whole records, dealt by record where ``parts`` is set: what Python has seen has no place that Spark knows of."""
    return rows if parts is None else rows.repartition(parts, "record_id")


def _read(triples: DataFrame, what: str, parts: int | None = None) -> DataFrame:
    """``record_id, x``: each record's items of a kind."""
    code = F.coalesce(*[F.when(F.col("p") == p, F.lit(k)) for p, k in _CODE.items()], F.lit(-1))
    row = F.struct("s", "s_kind", "o", "o_kind", code.alias("code"), carried().alias("kept"))

    @F.arrow_udf(_FOUND[what])
    def facts(rows: pa.Array) -> pa.Array:
        return _lists([_facts(what, *fields) for fields in gathered(rows)], _ARROW[what])

    found = triples.where((F.col("o_kind") == "b") | F.col("p").isin(*_NAMED)).groupBy("record_id").agg(F.collect_list(row).alias("rows")).select("record_id", facts("rows").alias("x"))
    return _dealt(found, parts).select("record_id", F.explode("x").alias("x"))


def large(triples: DataFrame, most: int | None = None, bounds: DataFrame | None = None) -> DataFrame | None:
    """``record_id`` of the records that aren't gathered; None where there are none.

    ``bounds`` has ``record_id, n``, a row for each row that triples come from, which gives ``n`` of them at most. Summed by
    buckets of records these show, mostly, that no record can be large. Triples of fuller buckets only are then counted.
    """
    most = MOST if most is None else most
    if bounds is not None:
        bucket = F.pmod(F.xxhash64("record_id"), F.lit(BUCKETS)).alias("bucket")
        full = closure.checkpoint(bounds.groupBy(bucket).agg(F.sum("n").alias("n")).where(F.col("n") > most).select("bucket"))
        if full.isEmpty():
            return None
        triples = triples.select("record_id", bucket).join(F.broadcast(full), "bucket", "left_semi")
    found = closure.checkpoint(triples.groupBy("record_id").count().where(F.col("count") > most).select("record_id"))
    return None if found.isEmpty() else found


class Settled:
    """What follows in the records of ``triples``, a set: see ``graph`` for what each is.

    Where the triples lie by record in a number of partitions, ``parts`` says so: what is joined to them is dealt alike.
    ``bounds`` are those of ``large``.
    """

    def __init__(self, triples: DataFrame, parts: int | None = None, bounds: DataFrame | None = None) -> None:
        self.parts = parts
        self.triples = triples.select(*TRIPLE)
        self.big = big = large(self.triples, bounds=bounds)
        self.small = self.triples if big is None else self.triples.join(F.broadcast(big), "record_id", "left_anti")
        self.joined = None
        if big is not None:
            given = self.triples.join(F.broadcast(big), "record_id", "left_semi")
            core = closure.checkpoint(graph.skeleton(given))
            mentions = closure.checkpoint(graph.relation_mentions(core))
            new = closure.checkpoint(graph.inferred(core, mentions))
            linked = core.unionByName(new)
            roots = closure.checkpoint(graph.entities(linked, mentions, HUB, WORK, INSTANCE))
            self.joined = {"mentions": mentions, "new": new, "entities": roots, "core": linked}

    def _with(self, small: DataFrame, what: str) -> DataFrame:
        return small if self.joined is None else small.unionByName(self.joined[what].select(*small.columns))

    def mentions(self) -> DataFrame:
        return self._with(_read(self.small, "mentions").select("record_id", F.col("x").alias("node")), "mentions")

    def new(self, parts: int | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        return self._with(_read(self.small, "new", parts).select("record_id", "x.*", none.alias("o_dt"), none.alias("o_lang")), "new")

    def inferred(self, parts: int | None = None) -> DataFrame:
        return self.triples.unionByName(self.new(parts))

    def entities(self, *classes: str, parts: int | None = None) -> DataFrame:
        found = self._with(_read(self.small, "entities", parts).select("record_id", "x.*"), "entities")
        return found.where(F.col("class").isin(*classes)) if classes else found

    def members(self, parts: int | None = None) -> DataFrame:
        """``record_id, class, entity, node``: the nodes of the entities' descriptions."""
        self._reach()
        return self._with(_read(self.small, "members", parts).select("record_id", "x.*"), "members")

    def below(self) -> DataFrame:
        """``record_id, root, node``: the blank nodes below each entity, each once."""
        self._reach()
        if self.joined is not None:
            self.joined["below"] = self.joined["members"].where("node <> entity").select("record_id", F.col("entity").alias("root"), "node").distinct()
        return self._with(_read(self.small, "below").select("record_id", "x.*"), "below")

    def _reach(self) -> None:
        if self.joined is not None and "members" not in self.joined:
            roots = self.joined["entities"].select("record_id", "class", "entity", F.col("entity").alias("node"))
            self.joined["members"] = closure.reach(closure.blank_edges(self.joined["core"].where(carried())), roots)

    def described(self, keep: Column | None = None, own: bool = False) -> DataFrame:
        """The descriptions of all entities; of their triples those that ``keep`` is true of, and with ``own`` the entities' own only."""
        kept = self.inferred(self.parts).where(carried())
        kept = (kept if keep is None else kept.where(keep)).withColumnRenamed("s", "node")
        of = self.entities(parts=self.parts).select("record_id", "class", "entity", F.col("entity").alias("node")).distinct() if own else self.members(self.parts)
        return of.join(kept, ["record_id", "node"]).select("record_id", "entity", "class", F.col("node").alias("s"), "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")

    def sizes(self) -> DataFrame:
        """``class, entity, n``: how many triples describe each entity."""
        counted = self.inferred(self.parts).where(carried()).groupBy("record_id", F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        return self.members(self.parts).join(counted, ["record_id", "node"]).groupBy("class", "entity").agg(F.sum("n").alias("n"))

    def others(self, *but: str) -> DataFrame:
        """``record_id, entity, other``: the other resources that each entity's description names, for entities of all classes but those."""
        main = (F.col("p") == TYPE) & F.col("o").isin(WORK, INSTANCE, HUB)
        free = self.inferred(self.parts).groupBy("record_id", F.col("s").alias("other")).agg(F.max(F.coalesce(main, F.lit(False))).alias("main")).where("not main").drop("main")
        named = self.described((F.col("o_kind") == "u") & ~vocabulary_term("o"))
        return named.where(~F.col("class").isin(*but)).select("record_id", "entity", F.col("o").alias("other")).distinct().join(free, ["record_id", "other"], "left_semi").select("record_id", "entity", "other")


def without_nodes(triples: DataFrame, links: DataFrame, big: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``triples`` without the links ``record_id, s, p, o`` to blank nodes and all that is reached from those; ``big`` has the large records."""
    if big is not None:
        big = F.broadcast(big)
        left = closure.without_nodes(triples.join(big, "record_id", "left_semi"), links.join(big, "record_id", "left_semi"))
        return without_nodes(triples.join(big, "record_id", "left_anti"), links.join(big, "record_id", "left_anti"), parts=parts).unionByName(left)

    @F.arrow_udf("array<string>")
    def below(rows: pa.Array) -> pa.Array:
        out = []
        for s, o, seed in gathered(rows):
            edges: dict[str, list[str]] = {}
            for a, b in zip(s, o, strict=True):
                edges.setdefault(a, []).append(b)
            out.append(reached(edges, [b for b, x in zip(o, seed, strict=True) if x]))
        return _lists(out, pa.string())

    edges = triples.where("o_kind = 'b'").select("record_id", "s", "o", F.lit(False).alias("seed")).unionByName(links.select("record_id", "s", "o", F.lit(True).alias("seed")))
    rows = edges.groupBy("record_id").agg(F.collect_list(F.struct("s", "o", "seed")).alias("rows"), F.max("seed").alias("any")).where("any")
    gone = _dealt(rows.select("record_id", below("rows").alias("s")), parts).select("record_id", F.explode("s").alias("s"))
    return triples.join(gone, ["record_id", "s"], "left_anti").join(links.select("record_id", "s", "p", "o").distinct(), ["record_id", "s", "p", "o"], "left_anti")


def _prints(s: list, p: list, o: list, key: list) -> list[tuple[str, str]]:
    """Fingerprints of the nodes of one record, from the leaves up; what is left is on or above a cycle."""
    fixed: dict[str, list[str]] = {}
    below: dict[str, list[tuple[str, str]]] = {}
    above: dict[str, list[str]] = {}
    for a, name, b, k in zip(s, p, o, key, strict=True):
        parts = fixed.setdefault(a, [])
        if k is None:
            below.setdefault(a, []).append((name, b))
            above.setdefault(b, []).append(a)
        else:
            parts.append(name + k)
    done: dict[str, str] = {}
    waits = {a: len(links) for a, links in below.items()}
    ready = [n for n in dict.fromkeys([*fixed, *above]) if n not in waits]
    while ready:
        n = ready.pop()
        done[n] = graph._digest(fixed.get(n, []) + [name + done[b] for name, b in below.get(n, ())])
        for a in above.get(n, ()):
            waits[a] -= 1
            if not waits[a]:
                ready.append(a)
    left = {a: [x for x in below[a] if x[1] not in done] for a, k in waits.items() if k}
    if left:
        parts = {a: fixed[a] + [name + done[b] for name, b in below[a] if b in done] for a in left}
        done |= graph._by_paths(parts, left, graph.MOST_VISITS) or graph._by_colours(parts, left)
    return list(done.items())


def fingerprints(triples: DataFrame, big: DataFrame | None = None) -> DataFrame:
    """``record_id, node, fp``: what ``graph.fingerprints`` gives; ``big`` has the large records."""
    if big is not None:
        big = F.broadcast(big)
        return fingerprints(triples.join(big, "record_id", "left_anti")).unionByName(graph.fingerprints(triples.join(big, "record_id", "left_semi")))

    kind = _struct_type("node", "fp")

    @F.arrow_udf("array<struct<node string, fp string>>")
    def prints(rows: pa.Array) -> pa.Array:
        return _lists([_prints(*fields) for fields in gathered(rows)], kind)

    row = _print_row()
    return triples.groupBy("record_id").agg(F.collect_list(row).alias("rows")).select("record_id", F.explode(prints("rows")).alias("x")).select("record_id", "x.*")


def _print_row() -> Column:
    return F.struct("s", sized("p").alias("p"), F.when(F.col("o_kind") == "b", F.col("o")).alias("o"), F.when(F.col("o_kind") != "b", object_key()).alias("key"))


def _doubled(s: list, p: list, o: list, key: list) -> list[tuple[str, str, str, str]]:
    prints = dict(_prints(s, p, o, key))
    held: dict[tuple[str, str, str], dict[str, None]] = {}
    for a, name, b, k in zip(s, p, o, key, strict=True):
        if k is None:
            held.setdefault((a, name, prints[b]), {})[b] = None
    return [(a, name.split(":", 1)[1], fp, n) for (a, name, fp), nodes in held.items() if len(nodes) > 1 for n in nodes]


def duplicate_values(triples: DataFrame, big: DataFrame | None = None, parts: int | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """``record_id, s, p, copies, label``: what ``graph.duplicate_values`` gives; ``big`` has the large records."""
    if big is not None:
        big = F.broadcast(big)
        return duplicate_values(triples.join(big, "record_id", "left_anti"), None, parts, labels).unionByName(graph.duplicate_values(triples.join(big, "record_id", "left_semi"), labels=labels))

    kind = _struct_type("s", "p", "fp", "node")

    @F.arrow_udf("array<struct<s string, p string, fp string, node string>>")
    def doubled(rows: pa.Array) -> pa.Array:
        return _lists([_doubled(*fields) for fields in gathered(rows)], kind)

    rows = triples.where("s_kind = 'b' or o_kind = 'b'").groupBy("record_id").agg(F.collect_list(_print_row()).alias("rows"))
    found = _dealt(rows.select("record_id", doubled("rows").alias("x")).where("size(x) > 0"), parts).select("record_id", F.explode("x").alias("x")).select("record_id", "x.*")
    return graph.copies(found, graph.labelled(triples, labels))


__all__ = ["MOST", "Settled", "duplicate_values", "fingerprints", "gathered", "large", "reached", "without_nodes"]
