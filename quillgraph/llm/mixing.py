"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a in [0, 1] and normalised: w = p^a / sum(p^a). The exponent is found by
repeated section of its interval, to meet a target entropy or a limit on how often a source's text is repeated. The weights are
realised as budgets of tokens: whole passes over a source's blocks, then a last pass over a permutation of its blocks
that ends where the budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty

SECTIONS, DEPTH = 16, 6
#: Tokens a block aims at.
BLOCK_TOKENS = 50_000
#: A source's blocks are summed up by slices of their order, of which there are two to this power.
SLICE_BITS = 10
MAX_REPEATS = 1.5


def token_count(text_col: str):
    """Words at white space."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"\S+")).cast("long")


def exponent(sizes: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> tuple[float, float]:
    """The exponent and the budget in tokens, from one row ``tokens`` a source.

    ``target_entropy`` is a share of the highest possible entropy. The least flattening that reaches it is taken, or the
    most flattening that keeps to ``max_repeats``. Each round is one aggregation with a sum for each section.
    """
    some = sizes.where("tokens > 0")
    total, most, fewest, n = some.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0, 0.0

    def sums(points: list[float]) -> list[tuple[float, float]]:
        p = F.col("tokens") / F.lit(float(total))
        row = some.agg(*[e for a in points for e in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]).first()
        return [(row[2 * k], row[2 * k + 1]) for k in range(len(points))]

    def spent(a: float, z: float) -> float:
        return float(budget) if budget is not None else total * (most / total) ** (1 - a) * z

    def flat_enough(a: float, z: float, s: float) -> bool:
        if target_entropy is not None:
            return math.log(z) - a * s / z >= target_entropy * math.log(n) - 1e-12
        return spent(a, z) * (fewest / total) ** (a - 1) / z / total >= max_repeats

    low, high = 0.0, 1.0  # flat enough at low, if anywhere
    for _ in range(DEPTH):
        points = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        ok = [flat_enough(a, *x) for a, x in zip(points, sums(points), strict=True)]
        at = max((k for k, x in enumerate(ok) if x), default=None)
        if at is None:
            high = low = points[0]
            break
        if at == SECTIONS:
            low = high = points[-1]
            break
        low, high = points[at], points[at + 1]
    a = low if target_entropy is not None else high
    return a, spent(a, sums([a])[0][0])


def own_names(docs: DataFrame) -> dict[str, str]:
    """What ``mix`` calls its own columns: the names it is documented with, after more underscores where ``docs`` has such columns."""
    taken, out = {c.lower() for c in docs.columns}, {}
    for name in ("tokens", "epoch", "block", "order"):
        own = f"__{name}"
        while own in taken:
            own = f"_{own}"
        out[name] = own
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 0, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """All columns of ``docs``, a row for each use of a document, with ``__tokens, __epoch, __block, __order``.

    ``__order`` sorts a source's blocks within an epoch. Without ``budget`` the budget is the least that uses every document
    at least once, so nothing is dropped: the largest source is read once and the others up to ``max_repeats`` times. Tokens are
    words at white space, unless ``tokens`` is an expression over ``docs`` that counts them.

    A null source is a source of its own. Null and empty texts have no tokens and go with their block. Texts of any length
    are counted whole and never cut. Rows repeated with one id go together: the last pass takes all or none. Rows with a null id share
    a block. Equal order keys of documents are taken together too. A source without tokens is used once. An empty table
    gives an empty result. Columns of any name pass through; where one is called as an own column is, ``own_names`` says what the own
    one is called.
    """
    given, own = docs.columns, own_names(docs)
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(given)], F.coalesce(tokens if tokens is not None else token_count(text_col), F.lit(0)).cast("long").alias("__tokens"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("__source"), F.coalesce(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(0)).alias("__key"),
    )
    # narrow facts about the documents; their texts aren't moved for the plan
    facts = materialize(rows.select("__source", "__key", "__tokens"), "mix-facts")
    sizes = materialize(facts.groupBy("__source").agg(F.sum("__tokens").alias("tokens")), "mix-sizes")
    a, spent = exponent(sizes, target_entropy, max_repeats, budget)
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    z = sizes.where("tokens > 0").agg(F.sum(F.pow(share, F.lit(a)))).first()[0] or 1.0
    size = F.col("tokens")
    budgeted = sizes.withColumn("want", F.when(size > 0, F.round(F.lit(spent) * F.pow(share, F.lit(a)) / F.lit(z))).otherwise(0).cast("long"))
    budgeted = budgeted.select(
        "__source",
        F.when(size > 0, F.floor(F.col("want") / size)).otherwise(1).cast("int").alias("full"),
        F.when(size > 0, F.pmod(F.col("want"), size)).otherwise(0).alias("rest"),
        F.greatest(F.lit(1), F.ceil(size / block_tokens)).cast("long").alias("blocks"),
    )
    block = F.pmod(F.col("__key"), F.col("blocks"))
    placed = facts.join(budgeted, "__source").select("__source", block.alias("__block"), "__key", "__tokens", "full", "rest")
    order = F.xxhash64("__source", "__block", F.col("full"), F.lit(seed))
    by_block = placed.groupBy("__source", "__block").agg(F.sum("__tokens").alias("tokens"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    by_block = by_block.withColumn("at", order).withColumn("slice", F.shiftrightunsigned("at", 64 - SLICE_BITS).cast("int"))
    by_block = materialize(by_block, "mix-blocks")
    # the slice of each source in which the budget ends, and in it the block: slices before are taken, those after aren't
    sliced = by_block.groupBy("__source", "slice").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    so_far = lambda *by: F.sum("tokens").over(Window.partitionBy("__source").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    sliced = materialize(sliced.withColumn("before", so_far("slice")), "mix-slices").select("__source", "slice", F.col("before").alias("base"), (F.col("before") + F.col("tokens")).alias("end"))
    met = by_block.join(sliced, ["__source", "slice"])
    inside = met.where("base < rest and end > rest").withColumn("before", F.col("base") + so_far("at", "__block"))
    last = inside.where("before < rest and before + tokens > rest").select("__source", "__block", (F.col("rest") - F.col("before")).alias("left"))
    # the one block of each source in which the budget ends: its documents in the order of their keys
    keyed = placed.join(last, ["__source", "__block"]).groupBy("__source", "__block", "left", "__key").agg(F.sum("__tokens").alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("__source", "__block").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    ends = keyed.withColumn("used", used).where("used < left").groupBy("__source", "__block").agg(F.max("__key").alias("upto"))
    top, bottom = F.lit(2**63 - 1), F.lit(-(2**63))
    taken = (F.col("rest") > 0) & F.coalesce(F.col("before") + F.col("tokens") <= F.col("rest"), F.col("end") <= F.col("rest"))
    plan = met.join(inside.select("__source", "__block", "before"), ["__source", "__block"], "left").join(ends, ["__source", "__block"], "left")
    plan = plan.select("__source", "__block", "full", F.when(taken, top).otherwise(F.coalesce("upto", bottom)).alias("upto"))
    plan = plan.where((F.col("full") > 0) | (F.col("upto") > bottom))
    sized = rows.join(budgeted.select("__source", "blocks"), "__source").withColumn("__block", block)
    out = sized.join(plan, ["__source", "__block"]).withColumn("__uses", F.col("full") + F.when((F.col("__key") <= F.col("upto")) & (F.col("upto") > bottom), 1).otherwise(0))
    out = out.where("__uses > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__uses") - 1)))
    made = {"tokens": F.col("__tokens"), "epoch": F.col("__epoch"), "block": F.col("__block"), "order": F.xxhash64("__source", "__block", "__epoch", F.lit(seed))}
    return out.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(given)], *[made[k].alias(name) for k, name in own.items()])
