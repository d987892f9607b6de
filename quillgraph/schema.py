"""Schemas: triples, and the tables of the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blank node ids are unique within a record only. Kinds: u (IRI), b (blank node), l (literal).
TRIPLES = "record_id string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
TRIPLE = ["record_id", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
TABLES = {
    "resource_base": "id long, type string, data string, uuid string, uri string, derived_from string, is_stub boolean, content_hash string, hub_id long, work_id long, created_at timestamp, updated_at timestamp",
    "versions": "id long, resource_id long, data string, keycloak_user_id string, created_at timestamp",
    "bibframe_classes": "id long, name string, uri string, created_at timestamp, updated_at timestamp",
    "resource_bibframe_classes": "id long, bf_class_id long, resource_id long",
    "bibframe_other_resources": "id long, other_resource_id long, bibframe_resource_id long, created_at timestamp, updated_at timestamp",
    "postings": "resource_id long, config string, lexeme string, pos int, weight string",
}
#: The types of stored resources; each is the rows of ``resource_base`` of that type.
SUBTYPES = ("works", "instances", "hubs", "other_resources", "profiles")

Step = tuple[str, str, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]


def _added(name: str, kind: str) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    return lambda df: df.withColumn(name, F.lit(None).cast(kind)), lambda df: df.drop(name)


#: Steps from older tables to these: (step, table, forward, back), oldest first. What goes back loses what was added.
LINEAGE: list[Step] = [
    ("user", "versions", *_added("keycloak_user_id", "string")),
    ("hubs", "resource_base", *_added("hub_id", "long")),
    ("derived", "resource_base", *_added("derived_from", "string")),
    ("stubs", "resource_base", *_added("is_stub", "boolean")),
    ("content", "resource_base", *_added("content_hash", "string")),
]


def migrate(table: str, df: DataFrame, done: int = 0, upto: int | None = None) -> DataFrame:
    """``df`` taken through the steps of its table from the first ``done`` to ``upto`` (all if unset), forward or back."""
    upto = len(LINEAGE) if upto is None else upto
    steps = LINEAGE[done:upto] if upto >= done else LINEAGE[upto:done][::-1]
    for _, name, forward, back in steps:
        if name == table:
            df = (forward if upto >= done else back)(df)
    return df
