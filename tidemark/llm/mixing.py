"""Mixing sources to target shares of the total size.

The plan is made on counts by exact token length: how many documents of each length to take.  All
lengths are taken in proportion first; what is left of the budget is filled exactly, if it can be,
by a bounded knapsack.  Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, ship

PLAN = "source string, tokens long, n long, full_repeats int, extra long, source_tokens long, capacity double, budget double, scarce boolean"


def source_key(c: Column) -> Column:
    """One form of all spellings: lower case, no blanks at the ends, one joint."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[-_\s]+", "-")


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take, so that their sum is the greatest not above ``budget``.

    Reachable sums are the bits of one integer; counts are split into powers of two.
    """
    steps: list[tuple[int, int, int]] = []
    reach, limit = 1, (1 << (budget + 1)) - 1
    for length in sorted(x for x in counts if 0 < x <= budget):
        left, k = min(counts[length], budget // length), 1
        while left > 0 and not reach >> budget & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (k * length) & limit
            left, k = left - k, k * 2
        if reach >> budget & 1:
            break
    at, take = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            take[length] = take.get(length, 0) + k
            at -= k * length
    return take


def plan_source(pdf: pd.DataFrame, exact: int = 1 << 16) -> pd.DataFrame:
    """The plan of one source from its counts by length (a null length: no documents).

    The greedy steps leave about ``exact`` tokens, at least twice the longest document, to the
    knapsack, which fills what is left whatever its size.
    """
    share, most, total = float(pdf["target_share"].iloc[0]), int(pdf["max_repeats"].iloc[0]), int(pdf["total"].iloc[0])
    h = pdf.dropna(subset=["tokens"]).sort_values("tokens")
    lengths, ns = [int(x) for x in h["tokens"]], [int(x) for x in h["n"]]
    size, budget, exact = sum(a * b for a, b in zip(lengths, ns)), share * total, max([exact, *[2 * a for a in lengths]])
    goal = int(round(budget))
    full, extra = most, dict.fromkeys(lengths, 0)
    if most * size > goal:
        full, rest = divmod(goal, size)
        extra = {a: b * rest // size for a, b in zip(lengths, ns)}
        left = rest - sum(a * k for a, k in extra.items())
        for a, b in sorted(zip(lengths, ns), reverse=True):
            if left <= exact:
                break
            if a:
                k = min(b - extra[a], (left - exact // 2) // a)
                extra[a] += max(0, k)
                left -= a * max(0, k)
        for a, k in knapsack({a: b - extra[a] for a, b in zip(lengths, ns)}, left).items():
            extra[a] += k
    rows = [(pdf["source"].iloc[0], a, b, full, extra[a], size, float(most * size), budget, most * size < budget) for a, b in zip(lengths, ns)]
    rows = rows or [(pdf["source"].iloc[0], None, 0, most, 0, 0, 0.0, budget, 0 < budget)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])


def plan(sizes: DataFrame, targets: DataFrame, exact: int = 1 << 16) -> DataFrame:
    """One row per listed source and token length: ``full_repeats`` of all n documents, one more
    copy of ``extra`` of them.  ``sizes`` is (source, tokens, ...); the counts of a source are as
    many rows as it has different lengths.  ``exact``: see ``plan_source``.
    """
    ship(sizes.sparkSession)
    t = targets.select(F.col("source").alias("named"), source_key(F.col("source")).alias("key"), "target_share", "max_repeats")
    counts = sizes.groupBy(source_key(F.col("source")).alias("key"), "tokens").agg(F.count(F.lit(1)).alias("n"))
    # the targets are the small side: Spark broadcasts them by their size, never the counts
    counts = materialize(counts.join(t.select("key"), "key", "left_semi"), "length-counts")
    total = counts.agg(F.coalesce(F.sum(F.col("tokens") * F.col("n")), F.lit(0))).scalar()
    without = t.join(counts.select("key").distinct(), "key", "left_anti")
    grouped = counts.join(t, "key").unionByName(without, allowMissingColumns=True).withColumns({"source": F.col("named"), "total": total})
    grouped = grouped.select("source", "target_share", "max_repeats", "total", "tokens", "n")
    return grouped.groupBy("source").applyInPandas(lambda pdf: plan_source(pdf, exact), PLAN)


def select(sizes: DataFrame, targets: DataFrame, planned: DataFrame, seed: int = 11, bucket_rows: int = 100_000) -> DataFrame:
    """(doc_id, source, tokens, repeats): the documents of the mixture, each with its number of copies.

    The documents of a length are taken in the order of a seeded hash.  Lengths with more than
    ``bucket_rows`` documents are ranked in ranges of that hash, so no group of equal lengths meets
    in one task; which documents are taken doesn't depend on it.
    """
    t = targets.select(F.col("source").alias("named"), source_key(F.col("source")).alias("key"))
    p = planned.select(F.col("source").alias("named"), "tokens", "full_repeats", "extra", "n").filter("tokens IS NOT NULL")
    h = F.xxhash64(F.lit(seed), "doc_id")
    part = F.ceil(F.col("n") / bucket_rows)
    place = F.least(F.floor((h / F.lit(2.0**64) + 0.5) * part).cast("bigint"), part - 1)  # rises with the hash
    docs = (
        sizes.select("doc_id", source_key(F.col("source")).alias("key"), "tokens").join(t, "key").join(p, ["named", "tokens"])
        .select("doc_id", F.col("named").alias("source"), "tokens", "full_repeats", "extra", h.alias("h"), place.alias("bucket"))
    )
    group = ["source", "tokens", "bucket"]
    upto = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shares = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("m")).select(
        *group, F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id"))
    return (
        docs.join(shares, group).withColumn("r", rank + F.col("before"))
        .select("doc_id", "source", "tokens", (F.col("full_repeats") + F.when(F.col("r") <= F.col("extra"), 1).otherwise(0)).alias("repeats"))
        .filter("repeats > 0")
    )


def report(planned: DataFrame) -> DataFrame:
    """(source, budget, source_tokens, used_tokens, actual_share, scarce), shares of the mixture's total."""
    used = F.sum(F.coalesce(F.col("tokens"), F.lit(0)) * (F.col("n") * F.col("full_repeats") + F.col("extra")))
    r = planned.groupBy("source").agg(
        F.max("budget").alias("budget"), F.max("source_tokens").alias("source_tokens"), used.alias("used_tokens"), F.max("scarce").alias("scarce")
    )
    whole = r.agg(F.sum("used_tokens")).scalar()
    return r.withColumn("actual_share", F.try_divide(F.col("used_tokens"), whole))
