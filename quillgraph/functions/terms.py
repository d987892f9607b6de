"""Column expressions over terms: namespaces, keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import BF, DCTERMS, LCLOCAL, MADS, RDF

def in_namespace(term: Column | str, *namespaces: str) -> Column:
    term = F.col(term) if isinstance(term, str) else term
    out = F.lit(False)
    for n in namespaces:
        out = out | term.startswith(n)
    return out


def carried() -> Column:
    """Triples that extraction keeps: neither predicate nor object in the local or the terms namespace."""
    local = (LCLOCAL, DCTERMS)
    return ~in_namespace("p", *local) & ~((F.col("o_kind") != "l") & in_namespace("o", *local))


def vocabulary_term(uri: Column | str) -> Column:
    """IRIs that are terms of a vocabulary rather than resources."""
    return in_namespace(uri, BF, MADS, RDF)


def sized(text: Column | str) -> Column:
    """A text after its length, so that texts put one after another can't be read in two ways."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def object_key(nested: Column | None = None) -> Column:
    """A key of an object that is equal exactly for equal terms; ``nested`` is the key of a blank node's content."""
    literal = F.concat(F.lit("lit"), sized("o"), sized("o_dt"), sized("o_lang"))
    ref = F.concat(F.lit("ref"), sized("o"))
    return F.when(F.col("o_kind") == "l", literal).when(F.col("o_kind") == "u", ref).otherwise(nested if nested is not None else F.lit("<cycle>"))


def last_segment(uri: Column | str) -> Column:
    return F.substring_index(uri, "/", -1)


def uuid_of(key: Column) -> Column:
    """A UUID that is a function of the key, so recomputed tasks and repeated saves give the same."""
    h = F.sha2(key, 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def numbered(df: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """Consecutive numbers after ``start`` in the given order, without gathering rows: counts by range, then places in it."""
    from ..plans.session import checkpoint

    dealt = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted(dealt.groupBy("__part").count().collect())  # a row for each partition
    before, offsets = start, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    from pyspark.sql.window import Window

    first = dealt.sparkSession.createDataFrame(offsets, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(first), "__part").withColumn(name, (F.col("__before") + place).cast("long")).drop("__part", "__before")
