"""The star-schema tables as triples, by one specification for Spark and for SQL.

Each row of the specification is (table, condition, subject, its kind, predicate, object, its kind, datatype, language) in
expressions that Spark and other engines read alike. Spark scans each table once and unfolds its rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.session import keep_records_together
from .schema import TRIPLE
from .vocab import ADMIN, ADMIN_TYPE, BF, DCTERMS, DERIVED_FROM, HAS_INSTANCE, HUB, INSTANCE, INSTANCE_OF, LABEL, LCLOCAL, NAMESPACE, STATUS, STATUS_OF, STUB_STATUS, TYPE, VALUE, WORK, XSD


def _text(*parts: str) -> str:
    return " || ".join(parts)


def _node(letter: str, key: str = "k") -> str:
    return f"'{letter}' || {key}"


W = "'http://ex.org/works/' || k"
I = "'http://ex.org/instances/' || k || '-' || m"  # noqa: E741
A = "'http://ex.org/agents/' || m"
OWN = f"'{NAMESPACE}works/w' || k"
BRAND = "'http://ex.org/brand/' || replace(p_brand, ' ', '_')"
KIND = "'http://ex.org/type/' || replace(p_type, ' ', '_')"

#: Sources: the columns that the specification speaks of.
SOURCES = {
    "part": "SELECT 'r' || CAST(p_partkey AS STRING) AS record_id, CAST(p_partkey AS STRING) AS k, p_partkey AS n, p_name, p_brand, p_type FROM part",
    "item": "SELECT DISTINCT 'r' || CAST(l_partkey AS STRING) AS record_id, CAST(l_partkey AS STRING) AS k, CAST(l_suppkey AS STRING) AS m, l_partkey AS n, l_suppkey AS s FROM lineitem",
}


def _u(x: str) -> str:
    return f"'{x}'"


SPEC: list[tuple] = [
    ("part", "true", W, "u", TYPE, _u(WORK), "u"),
    ("part", "n % 10 = 0", W, "u", TYPE, _u(HUB), "u"),
    ("part", "n % 3 = 0", W, "u", TYPE, _u(BF + "Text"), "u"),
    ("part", "true", W, "u", BF + "title", _node("t"), "b"),
    ("part", "true", _node("t"), "b", TYPE, _u(BF + "Title"), "u"),
    ("part", "true", _node("t"), "b", BF + "mainTitle", "p_name", "l"),
    ("part", "n % 7 = 0", W, "u", BF + "title", _node("u"), "b"),
    ("part", "n % 7 = 0", _node("u"), "b", TYPE, _u(BF + "Title"), "u"),
    ("part", "n % 7 = 0", _node("u"), "b", BF + "mainTitle", "p_name", "l"),
    ("part", "true", W, "u", BF + "subject", BRAND, "u"),
    ("part", "true", BRAND, "u", LABEL, "p_brand", "l"),
    ("part", "true", W, "u", BF + "subject", KIND, "u"),
    ("part", "n % 2 = 0", KIND, "u", LABEL, "p_type", "l"),
    ("part", "true", W, "u", DCTERMS + "modified", "'2020-01-01'", "l", XSD + "date"),
    ("part", "n % 2 = 0", W, "u", LCLOCAL + "note", _node("q"), "b"),
    ("part", "n % 2 = 0", _node("q"), "b", VALUE, "'local'", "l"),
    ("part", "n % 4 <> 3", W, "u", ADMIN, _node("a"), "b"),
    ("part", "n % 4 <> 3", _node("a"), "b", TYPE, _u(ADMIN_TYPE), "u"),
    ("part", "n % 4 <> 3", _node("a"), "b", DERIVED_FROM, "'http://src.org/' || k", "u"),
    ("part", "n % 4 <> 3 AND n % 8 <> 0", _node("a"), "b", STATUS_OF, _u(STATUS), "u"),
    ("part", "n % 8 = 0", _node("a"), "b", STATUS_OF, _u(STUB_STATUS), "u"),
    ("part", "n % 4 <> 3", _node("a"), "b", BF + "assigner", _node("g"), "b"),
    ("part", "n % 4 <> 3", _node("g"), "b", LABEL, "'assigner'", "l"),
    ("part", "true", W, "u", BF + "contribution", _node("c"), "b"),
    ("part", "true", _node("c"), "b", BF + "agent", _node("e"), "b"),
    ("part", "true", _node("e"), "b", LABEL, "p_brand", "l", None, "en"),
    ("part", "true", _node("e"), "b", BF + "place", _node("l"), "b"),
    ("part", "true", _node("l"), "b", VALUE, "p_type", "l"),
    ("part", "true", W, "u", BF + "identifiedBy", _node("i"), "b"),
    ("part", "n % 4 = 0", _node("i"), "b", TYPE, _u(BF + "OclcNumber"), "u"),
    ("part", "n % 4 <> 0", _node("i"), "b", TYPE, _u(BF + "Isbn"), "u"),
    ("part", "true", _node("i"), "b", VALUE, "k", "l"),
    ("part", "true", _node("i"), "b", BF + "source", _node("j"), "b"),
    ("part", "true", _node("j"), "b", LABEL, "'source'", "l"),
    ("part", "n % 5 = 0", W, "u", BF + "relation", _node("r"), "b"),
    ("part", "n % 5 = 0", _node("r"), "b", TYPE, _u(BF + "Relation"), "u"),
    ("part", "n % 5 = 0", _node("r"), "b", BF + "associatedResource", _node("s"), "b"),
    ("part", "n % 5 = 0", _node("s"), "b", TYPE, _u(WORK), "u"),
    ("part", "n % 5 = 0", _node("s"), "b", HAS_INSTANCE, _node("k"), "b"),
    ("part", "n % 5 = 0", _node("k"), "b", LABEL, "'mentioned'", "l"),
    ("part", "n % 6 = 0", OWN, "u", TYPE, _u(WORK), "u"),
    ("part", "n % 6 = 0", OWN, "u", ADMIN, _node("b"), "b"),
    ("part", "n % 6 = 0", _node("b"), "b", DERIVED_FROM, W, "u"),
    ("item", "s % 2 = 1", I, "u", INSTANCE_OF, W, "u"),
    ("item", "s % 2 = 0", W, "u", HAS_INSTANCE, I, "u"),
    ("item", "s % 3 = 0", I, "u", TYPE, _u(INSTANCE), "u"),
    ("item", "true", I, "u", BF + "publisher", A, "u"),
    ("item", "true", I, "u", BF + "title", _node("x", "k || '-' || m"), "b"),
    ("item", "true", _node("x", "k || '-' || m"), "b", BF + "mainTitle", "'item ' || m", "l"),
    ("item", "s % 2 = 0", A, "u", LABEL, "'agent ' || m", "l"),
]
SPEC = [(*x, *[None] * (9 - len(x))) for x in SPEC]


def _quoted(x: str | None) -> str:
    return "CAST(NULL AS STRING)" if x is None else f"'{x}'"


def triples_sql() -> str:
    """One SELECT of all triples."""
    rows = [f"SELECT record_id, {s} AS s, '{sk}' AS s_kind, '{p}' AS p, {o} AS o, '{ok}' AS o_kind, {_quoted(dt)} AS o_dt, {_quoted(lang)} AS o_lang FROM {t}_ WHERE {c}" for t, c, s, sk, p, o, ok, dt, lang in SPEC]
    sources = ", ".join(f"{t}_ AS ({q})" for t, q in SOURCES.items())
    return f"WITH {sources} SELECT DISTINCT * FROM (" + " UNION ALL ".join(rows) + ")"


#: Bytes of a table's files that make one partition of records, which is some half a million triples: a task sorts those that
#: it gathers by record, and has to do so in its share of an executor's memory.
PART_BYTES = 1 << 20

#: What Spark moves of each source: the record and the numbers that the specification's columns follow from.
MOVED = {
    "part": ("part", "SELECT 'r' || CAST(p_partkey AS STRING) AS record_id, p_partkey AS n, p_name, p_brand, p_type FROM {src}", "*, CAST(n AS STRING) AS k", False),
    "item": ("lineitem", "SELECT 'r' || CAST(l_partkey AS STRING) AS record_id, l_partkey AS n, l_suppkey AS s FROM {src}", "*, CAST(n AS STRING) AS k, CAST(s AS STRING) AS m", True),
}


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions the records are dealt into: as the tables' files are large, and no fewer than shuffles have."""
    size = max(int(str(spark.read.parquet(f"{sf_dir}/{base}.parquet")._jdf.queryExecution().analyzed().stats().sizeInBytes())) for base, *_ in MOVED.values())
    return max(-(-size // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_id, n``: for every row of the tables how many triples it can give, read from the columns of the records alone."""
    given, out = Counter(t for t, *_ in SPEC), None
    for t, (base, moved, *_) in MOVED.items():
        one = spark.sql(moved, src=spark.read.parquet(f"{sf_dir}/{base}.parquet")).select("record_id", F.lit(given[t]).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples: every table is scanned once, and only its columns used here.

    Keys of the sources are unique and no two rows of the specification say the same of one, so nothing repeats. The rows of
    the tables are dealt by record before they are unfolded, a few numbers each; the triples lie by record then, and what
    goes by record and something else moves nothing more.
    """
    keep_records_together(spark)
    out, n = None, partitions(spark, sf_dir)
    for t, (base, moved, columns, repeats) in MOVED.items():
        df = spark.sql(moved, src=spark.read.parquet(f"{sf_dir}/{base}.parquet")).repartition(n, "record_id")
        df = (df.distinct() if repeats else df).selectExpr(*columns.split(", "))
        rows = [f"CASE WHEN {c} THEN named_struct('s', {s}, 's_kind', '{sk}', 'p', '{p}', 'o', {o}, 'o_kind', '{ok}', 'o_dt', {_quoted(dt)}, 'o_lang', {_quoted(lang)}) END" for t2, c, s, sk, p, o, ok, dt, lang in SPEC if t2 == t]
        one = df.select("record_id", F.explode(F.expr(f"array({', '.join(rows)})")).alias("x")).where("x is not null").select("record_id", "x.*").select(*TRIPLE)
        out = one if out is None else out.unionByName(one)
    return out
