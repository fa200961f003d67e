"""Mixing sources to target weights by temperature, in DataFrame functions only.

The token shares of the sources are raised to an exponent and normalised. The exponent is found
by bisection so that the mixture reaches a target entropy or repeats no source more often than a
limit. A source's weight then becomes whole passes over its documents and a part of one more,
which takes documents in the order of a pseudo-random permutation until its tokens are spent.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.session import materialize

#: Words are counted as tokens.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Documents of a source that one window adds up.
BLOCK_ROWS = 50_000
#: Bisections that one job evaluates together, and jobs.
_SECTIONS, _JOBS = 64, 5


class Exponent(NamedTuple):
    """The exponent with what it makes of the sources: sum of powers and tokens to draw."""

    alpha: float
    total: float
    budget: float


def shares(docs: DataFrame) -> DataFrame:
    """(source, rows, tokens) of every source; null is a source of its own."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"))


def _evaluate(sources: DataFrame, alphas: list[float], n: float, budget: float | None) -> list[tuple]:
    """(alpha, sum of powers, entropy, largest repetition, budget) of every exponent, in one job."""
    p = F.col("tokens") / F.lit(n)
    grid = sources.select(p.alias("p"), F.col("tokens"), F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    power = F.pow("p", F.col("alpha"))
    rows = grid.groupBy("alpha").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.max(power / F.col("tokens")).alias("m"), F.min(power / F.col("tokens")).alias("s")
    ).collect()
    out = []
    for r in sorted(rows, key=lambda r: r.alpha):
        tokens = budget if budget is not None else r.z / r.s
        out.append((r.alpha, r.z, math.log(r.z) - r.alpha * r.l / r.z, tokens * r.m / r.z, tokens))
    return out


def temper(sources: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: float | None = None) -> Exponent | None:
    """The smallest exponent from 0 to 1 that keeps the repetition limit, and reaches the entropy at most.

    At 1 the sources keep their shares, at 0 all are equal; entropy (in nats) and the largest
    repetition fall as the exponent rises. ``budget`` is the number of tokens to draw; by default
    the smallest number with which every document is taken at least once. With a limit that even
    the natural shares break, or an entropy below theirs, the exponent is 1. None without tokens.
    """
    known = sources.filter("tokens > 0")
    n = known.agg(F.sum("tokens")).first()[0]
    if not n:
        return None

    def fits(row: tuple) -> bool:
        return (repetition is None or row[3] <= repetition * (1 + 1e-12)) and (entropy is None or row[2] <= entropy + 1e-12)

    low, high = 0.0, 1.0
    for job in range(_JOBS):
        rows = _evaluate(known, [low + (high - low) * i / _SECTIONS for i in range(_SECTIONS + 1)], n, budget)
        if job == 0 and fits(rows[0]):
            found = rows[0]
            break
        good = next((i for i, row in enumerate(rows) if fits(row)), None)
        if good is None:
            found = rows[-1]
            break
        found = rows[good]
        low, high = rows[max(good - 1, 0)][0], found[0]
    alpha, total, _, _, tokens = found
    return Exponent(alpha, total, tokens)


def _key(seed: int, pass_: Column | str) -> Column:
    """Place of a document in a pass's permutation: 60 bits of a hash of its id."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(pass_) if isinstance(pass_, str) else pass_, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")


def quotas(sources: DataFrame, chosen: Exponent | None) -> DataFrame:
    """(source, rows, tokens, weight, passes, rest): whole passes and the tokens of one more."""
    if chosen is None:
        return sources.select("source", "rows", "tokens", F.lit(0.0).alias("weight"), F.lit(1).alias("passes"), F.lit(0.0).alias("rest"))
    n = sources.agg(F.sum("tokens")).first()[0]
    weight = F.pow(F.col("tokens") / F.lit(float(n)), F.lit(chosen.alpha)) / F.lit(chosen.total)
    repeats = F.lit(chosen.budget) * F.col("weight") / F.col("tokens")
    some = sources.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(0.0))
    counted = some.withColumn("repeats", F.when(F.col("tokens") > 0, repeats).otherwise(1.0))
    counted = counted.withColumn("passes", F.floor(F.col("repeats") + 1e-7).cast("int"))
    rest = F.greatest(F.col("repeats") - F.col("passes"), F.lit(0.0))
    return counted.select(
        "source", "rows", "tokens", "weight", "passes", F.when(rest > 1e-7, rest * F.col("tokens")).otherwise(0.0).alias("rest")
    )


def _limits(rows: DataFrame, plan: DataFrame, seed: int, block_rows: int) -> DataFrame:
    """(source, last): the greatest place that the unfinished pass of a source takes.

    Places are cut into blocks of about ``block_rows`` documents. The totals of the blocks say
    in which one the tokens run out; only that one is added up document by document.
    """
    part = plan.filter("rest > 0").select(F.col("source").alias("__source"), "passes", "rest", "rows")
    bits = F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.col("rows") / F.lit(block_rows), F.lit(1.0))))).cast("int")
    placed = rows.join(part, F.col("source").eqNullSafe(F.col("__source"))).select(
        "source", "rest", "tokens", _key(seed, "passes").alias("key"), bits.alias("bits")
    ).withColumn("block", F.expr("shiftright(key, 60 - bits)"))
    totals = placed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("total"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(upto), F.lit(0)))
    whole = before.filter(F.col("before") + F.col("total") <= F.col("rest")).select(
        "source", F.expr("null").cast("long").alias("last"), "block"
    )
    edge = before.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("total") > F.col("rest")))
    inside = placed.alias("p").join(
        edge.select(F.col("source").alias("__source"), F.col("block").alias("__block"), "before"),
        F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block")),
    )
    by_key = inside.groupBy("source", "block", "rest", "before", "key").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    taken = by_key.withColumn("upto", F.col("before") + F.sum("tokens").over(running)).filter(
        F.col("upto") - F.col("tokens") / 2 <= F.col("rest")
    ).groupBy("source").agg(F.max("key").alias("last"))
    # Every place of a whole block counts as taken.
    ends = whole.join(part.select("__source", bits.alias("bits")), F.col("source").eqNullSafe(F.col("__source"))).select(
        "source", F.expr("shiftleft(block + 1, 60 - bits) - 1").alias("last")
    )
    return taken.union(ends).groupBy("source").agg(F.max("last").alias("last"))


def mix(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: float | None = None,
        seed: int = 23, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mixture: every drawn copy as a row of ``docs`` (doc_id, text, source, ...) with pass and place.

    ``pass`` counts from 0, ``place`` is the document's place in that pass's permutation; sorted
    by (pass, place) a source's rows are its permutations one after another. Tokens are words.
    The unfinished pass takes the documents in whose middle its tokens are not yet spent, so that
    a source misses its weight by half a document at most (documents that share a place, like
    repeated rows, are taken together). A source without tokens is taken once. Null sources are
    one source, null texts have no tokens, rows without doc_id share a place. All columns of
    ``docs`` stay but pass and place, which are replaced. An empty table gives an empty one.
    """
    docs = docs.drop(*[c for c in ("pass", "place") if c in docs.columns])
    tokens = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    rows = materialize(docs.select("source", "doc_id", tokens.alias("tokens")), "tokens")
    sources = materialize(shares(rows), "sources")
    plan = materialize(quotas(sources, temper(sources, repetition, entropy, budget)), "quotas")
    limits = _limits(rows, plan, seed, block_rows)
    drawing = materialize(
        plan.alias("p").join(limits.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
        .select(F.col("p.source").alias("__source"), F.col("passes").alias("__passes"), F.col("last").alias("__last")),
        "drawing",
    )
    joined = docs.join(drawing, F.col("source").eqNullSafe(F.col("__source")))
    more = F.coalesce(_key(seed, "__passes") <= F.col("__last"), F.lit(False))
    copies = F.col("__passes") + more.cast("int")
    drawn = joined.withColumn("pass", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    return drawn.withColumn("place", _key(seed, "pass")).select(*docs.columns, "pass", "place")
