"""Documents written as they are given, without a graph around them: resources of any type, and profiles."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import derived_from, is_stub
from ..functions.terms import numbered, uuid_of
from ..operators.closure import description
from ..operators.documents import framed
from ..operators.graph import bibframe_classes
from ..operators.search import postings
from ..schema import SUBTYPES, TRIPLE
from ..sources.files import parse_records
from ..vocab import STUB_STATUS
from .save import write_classes, write_resources
from .session import checkpoint
from .store import Store


def as_stored(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``uri, type, data`` with each document in the form it is stored in, and the triples of those that are no profiles.

    A profile is kept as it is. Any other document is read as JSON-LD, with the default context if it has none, and framed
    by its IRI, without the context. A document without an IRI, or one that can't be read, is a ValueError.
    """
    if not documents.where("uri is null").isEmpty():
        raise ValueError("a document needs its uri before its data")
    if bad := [r[0] for r in documents.where(~F.col("type").isin(*SUBTYPES)).select("type").distinct().limit(5).collect()]:
        raise ValueError(f"no types of resources: {', '.join(map(repr, bad))}")
    graphs = documents.where("type <> 'profiles'")
    parsed = checkpoint(parse_records(graphs.select(F.col("uri").alias("record_id"), F.col("data").alias("body"), F.lit("jsonld").alias("format"))))
    if wrong := parsed.where("error is not null").select("record_id", "error").limit(5).collect():
        raise ValueError("; ".join(f"<{r['record_id']}>: {r['error']}" for r in wrong))
    roots = graphs.select(F.col("uri").alias("record_id"), F.col("type").alias("class"), F.col("uri").alias("entity"))
    described = checkpoint(description(parsed.drop("error").select(*TRIPLE), roots))
    compact = framed(described).select(F.col("entity").alias("uri"), "data")
    bare = F.concat(F.lit('{"@id": '), F.to_json(F.array("uri")).substr(F.lit(2), F.length(F.to_json(F.array("uri"))) - 2), F.lit("}"))
    out = graphs.select("uri", "type").join(compact, "uri", "left").select("uri", "type", F.coalesce("data", bare).alias("data"))
    return out.unionByName(documents.where("type = 'profiles'").select("uri", "type", "data")), described


def write_documents(store: Store, documents: DataFrame, user: str | None = None, stamp: datetime.datetime | None = None, batch_id: str | None = None) -> bool:
    """Write documents ``uri, type, data``, one a uri, each with a version if it changes what is stored; profiles have no classes."""
    stamp, state = stamp or datetime.datetime.now(datetime.UTC), store.state()
    if not documents.groupBy("uri").count().where("count > 1").isEmpty():
        raise ValueError("a uri has more than one document")
    data, described = as_stored(documents)
    data = checkpoint(data.withColumn("content_hash", F.sha2("data", 256)))
    stored = store.table("resource_base", state=state).select("id", "uri", F.col("type").alias("old_type"), F.col("data").alias("old_data"))
    met = checkpoint(data.join(stored, "uri", "left"))
    if not met.where("old_type <> type").isEmpty():
        raise ValueError("a stored resource can't become one of another type")
    won = met.where("old_data is null or old_data <> data").drop("old_type", "old_data")
    fresh = numbered(won.where("id is null").select("uri", "type"), ["type", "uri"], state["top"].get("resource_base", 0))
    ids = checkpoint(won.where("id is not null").select("id", "uri", "type").unionByName(fresh.select("id", "uri", "type")))
    profile = F.col("type") == "profiles"
    won = won.drop("id").withColumns({"derived_from": F.when(~profile, derived_from("data")), "is_stub": F.when(~profile, is_stub("data", STUB_STATUS)).otherwise(F.lit(False))})
    made = won.join(ids.select("uri", "id"), "uri").select(F.col("id").alias("resource_id"), F.lit(1).alias("seq"), "data")
    none = store.spark.createDataFrame([], "uri string, to_work long")
    tables, touched = write_resources(store, state, won, ids, none, made, user, stamp)
    owners = ids.where("type in ('hubs', 'works', 'instances')").select(F.col("uri").alias("entity"), F.col("id").alias("resource_id"))
    more, where = write_classes(store, state, bibframe_classes(described).join(owners, "entity").select("resource_id", "uri"), owners.select("resource_id"), stamp)
    return store.commit(tables | more, batch_id, touched | where, state)


def reindex(store: Store) -> bool:
    """The index of all stored resources made anew, as a change of its sections asks for."""
    state = store.state()
    made = postings(store.table("resource_base", state=state).select("id", "uri", "data"))
    return store.commit({"postings": made.withColumn("pos", F.col("pos").cast("int"))}, state=state)


def mint_profiles(profiles: DataFrame, base: str) -> DataFrame:
    """``profiles`` (with ``id``) with a ``uuid`` that is a function of the id and a ``uri`` under ``base``, where they have none."""
    made = F.coalesce("uuid", uuid_of(F.concat(F.lit("profile\n"), F.col("id").cast("string"))))
    return profiles.withColumn("uuid", made).withColumn("uri", F.coalesce("uri", F.concat(F.lit(base.rstrip("/") + "/profiles/"), F.col("uuid"))))


def unmint_profiles(resources: DataFrame, to: str = "other_resources") -> DataFrame:
    """Profiles as resources of the type that they were before; what IRIs they had then isn't known."""
    was = F.col("type") == "profiles"
    none = F.lit(None).cast("string")
    return resources.withColumns({"uuid": F.when(was, none).otherwise(F.col("uuid")), "uri": F.when(was, none).otherwise(F.col("uri")), "type": F.when(was, F.lit(to)).otherwise(F.col("type"))})


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ways from one stored row to others, each a table of (from, to) ids: a join on the key that holds the link."""
    base, links, bridge = tables["resource_base"], tables["bibframe_other_resources"], tables["resource_bibframe_classes"]
    pair = lambda df, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    of = lambda kind: base.where(F.col("type") == kind)
    return {
        "work_instances": pair(of("instances"), "work_id", "id"), "instance_work": pair(of("instances"), "id", "work_id"), "hub_works": pair(of("works"), "hub_id", "id"), "work_hub": pair(of("works"), "id", "hub_id"),
        "resource_versions": pair(tables["versions"], "resource_id", "id"), "resource_classes": pair(bridge, "resource_id", "bf_class_id"), "class_resources": pair(bridge, "bf_class_id", "resource_id"),
        "resource_others": pair(links, "bibframe_resource_id", "other_resource_id"), "other_resources": pair(links, "other_resource_id", "bibframe_resource_id"),
    }
