"""What is done record by record: the same results as by joins, for small and large records, and nothing moved but the tables' rows."""

from __future__ import annotations

import os
import random

import pytest

from pyspark.sql import functions as F

from quillgraph import triplify
from quillgraph.operators import closure, graph, records
from quillgraph.queries import QUERIES
from quillgraph.schema import TRIPLES
from quillgraph.vocab import ADMIN, BF, DCTERMS, EXCLUDED, HAS_INSTANCE, HUB, INSTANCE, INSTANCE_OF, LABEL, TYPE, WORK

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    rng, rows = random.Random(3), set()
    for r in range(12):
        nodes = [(f"b{k}", "b") for k in range(7)] + [(f"http://x/{k}", "u") for k in range(4)]
        for _ in range(40):
            s, sk = rng.choice(nodes)
            p = rng.choice([HAS_INSTANCE, INSTANCE_OF, BF + "relation", BF + "associatedResource", BF + "title", BF + "identifiedBy", ADMIN, DCTERMS + "part"])
            o, ok = rng.choice([*nodes, ("text", "l")])
            rows.add((f"r{r}", s, sk, p, o, ok, None, None))
        for s, sk in nodes:
            for t in rng.sample([WORK, INSTANCE, HUB, BF + "Relation", BF + "OclcNumber", BF + "Title"], 2):
                rows.add((f"r{r}", s, sk, TYPE, t, "u", None, None))
            rows.add((f"r{r}", s, sk, LABEL, rng.choice("xy"), "l", None, rng.choice([None, "en"])))
    return spark.createDataFrame(sorted(rows, key=str), TRIPLES).cache()


def bag(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


@pytest.mark.parametrize("most", [0, 78, None])
def test_as_joins(given, monkeypatch, most):
    """Records read whole, records that are too large for it, and both at once."""
    if most is not None:
        monkeypatch.setattr(records, "MOST", most)
    settled = records.Settled(given)
    mentions = closure.checkpoint(graph.relation_mentions(given))
    new = closure.checkpoint(graph.inferred(given, mentions))
    found = closure.checkpoint(graph.entities(given.unionByName(new), mentions, HUB, WORK, INSTANCE))
    assert bag(settled.mentions()) == bag(mentions)
    assert bag(settled.new(), "record_id", "s", "p", "o") == bag(new, "record_id", "s", "p", "o")
    columns = ["record_id", "class", "entity", "kind"]
    assert bag(settled.entities(), *columns) == bag(found, *columns) != []
    columns = ["record_id", "class", "entity", "s", "p", "o", "o_kind"]
    assert bag(settled.described(), *columns) == bag(closure.description(given.unionByName(new), found), *columns) != []
    assert bag(settled.below(), "record_id", "root", "node") == bag(closure.description(given.unionByName(new), found).where("s <> entity").selectExpr("record_id", "entity", "s").distinct())
    links = closure.links_by_type(given, EXCLUDED)
    assert bag(records.without_nodes(given, links, settled.big)) == bag(closure.without_nodes(given, links))
    assert bag(records.fingerprints(given, settled.big), "record_id", "node", "fp") == bag(graph.fingerprints(given), "record_id", "node", "fp")
    assert bag(records.duplicate_values(given, settled.big)) == bag(graph.duplicate_values(given))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
@pytest.mark.parametrize(
    "name",
    ["link_others", "others_extract", "read_jsonld", "read_rdfxml", "read_turtle", "to_documents", "frame_documents", "bf_classes", "bnode_closure", "infer_inverse", "infer_types", "type_extract_work", "fingerprint", "duplicate_values", "strip_excluded", "clear_stub"],
)
def test_moves_nothing_but_rows(spark, name):
    """Triples are made where their record's rows have been dealt; they aren't moved after that."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" in plan
    assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("buckets", [1, 3, 1 << 18])
@pytest.mark.parametrize("most", [0, 71, 10_000])
def test_large_by_bounds(given, monkeypatch, buckets, most):
    """The records that are large don't depend on how they are looked for."""
    monkeypatch.setattr(records, "BUCKETS", buckets)
    exact, found = records.large(given, most), records.large(given, most, given.select("record_id", F.lit(3).alias("n")))
    assert (exact is None) == (found is None) == (most == 10_000)
    assert exact is None or bag(found) == bag(exact)


def test_small_records_are_not_counted(given):
    """Where rows are few enough, no triple is made to see that no record is large."""
    broken = given.withColumn("record_id", F.raise_error(F.lit("counted")).cast("string"))
    assert records.large(broken, 10_000, given.select("record_id", F.lit(1).alias("n"))) is None


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_bounds_of_tables(spark):
    bounds = triplify.bounds(spark, DIR).groupBy("record_id").agg(F.sum("n").alias("n"))
    have = triplify.triples(spark, DIR).groupBy("record_id").count()
    assert have.join(bounds, "record_id", "left").where("n is null or n < count").isEmpty() and not have.isEmpty()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", ["type_extract_work", "strip_excluded", "fingerprint", "duplicate_values"])
def test_triples_are_made_once(spark, monkeypatch, name):
    """What is looked at beforehand are the tables' rows."""
    plans, write = [], closure.checkpoint

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(closure, "checkpoint", noted)
    QUERIES[name](spark, DIR)
    assert plans and not any("Generate explode" in p for p in plans)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_partitions_are_small(spark):
    """Of 600,000 items no task gets more than about a tenth, so that it needn't spill what it gathers."""
    rows = triplify.triples(spark, "/root/testdata/sf0.1").where((F.col("p") == TYPE) & (F.col("o") == WORK)).groupBy(F.spark_partition_id().alias("part")).count()
    assert rows.agg(F.max("count")).first()[0] < 3500
