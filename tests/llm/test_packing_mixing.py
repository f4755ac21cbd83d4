"""Containers and mixtures against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixing as M
from tidemark.llm import packing as P
from tidemark.llm import tokens


def test_token_counts(spark):
    texts = [None, "", "hello world", "<|endoftext|>", "ü" * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, body string, text string")
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df, ["doc_id"], "body").collect()}
    enc = tokens.encoder(tokens.default_vocabulary())
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def _check(packed, sizes, capacity):
    rows = packed.collect()
    used, parts = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r["size"]
        parts.setdefault(r.doc_id, []).append((r.part, r["size"]))
    assert max(used.values()) <= capacity
    assert {i: sum(s for _, s in p) for i, p in parts.items()} == {i: s or 0 for i, s in sizes}
    for i, s in sizes:
        assert len(parts[i]) == (1 if (s or 0) <= capacity else -(-s // capacity))
        assert sorted(p for p, _ in parts[i]) == list(range(len(parts[i])))
    return len(used)


def test_pack_is_whole_and_tight(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 1, 3, 10, 40, 99, 100, 101, 250, 300, None] + [rng.randrange(1, 100)] * 8)) for i in range(700)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    n = _check(P.pack(df, capacity=100, shard_items=120), sizes, 100)
    least = -(-sum(s or 0 for _, s in sizes) // 100)
    assert n <= least * 1.03 + 2
    assert P.pack(df.limit(0)).count() == 0
    again = P.pack(df.repartition(5), capacity=100, shard_items=120)
    assert _check(again, sizes, 100) == n


def test_pack_reports(spark):
    df = spark.createDataFrame([(1, 60), (2, 40), (3, 30)], "doc_id bigint, tokens bigint")
    got = sorted((r.used, r.unused, r.n_parts) for r in P.containers(P.pack(df, capacity=100), 100).collect())
    assert got == [(30, 70, 1), (100, 0, 2)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(0, 1000))
def test_genetic_steps_keep_every_item(sizes, seed):
    rng = random.Random(seed)
    order = list(range(len(sizes)))
    a, b = P.best_fit([], order, sizes, 50), P.best_fit([], sorted(order, key=lambda i: -sizes[i]), sizes, 50)
    child = P.crossover(a, b, sizes, 50, rng)
    assert sorted(i for x in child for i in x) == order
    assert all(sum(sizes[i] for i in x) <= 50 for x in child)
    best = P.evolve(sizes, 50, [], seed, 4, 3)[0]
    assert P.least_bins(sizes, 50) <= len(best) <= len(a)


def test_breeding_beats_best_fit():
    """Items between a quarter and a half of a container: fitting them by size leaves room that breeding uses."""
    for seed in (1, 2):
        rng = random.Random(seed)
        sizes = [rng.randrange(1024, 2049) for _ in range(300)]
        fitted = P.best_fit([], sorted(range(300), key=lambda i: -sizes[i]), sizes, 4096)
        best = P.evolve(sizes, 4096, [], seed, 8, 12)[0]
        assert len(best) <= 0.97 * len(fitted)
        assert sorted(i for b in best for i in b) == list(range(300)) and max(sum(sizes[i] for i in b) for b in best) <= 4096


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 120))
def test_knapsack_is_optimal(counts, budget):
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1) if r + k * length <= budget}
    take = M.knapsack(counts, budget)
    assert all(0 <= k <= counts[a] for a, k in take.items())
    assert sum(a * k for a, k in take.items()) == max(reach)


def _sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, n int")


def test_mixture_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([" A-b", "a_B ", "c", "C"]), rng.randrange(0, 60), 1) for i in range(900)] + [(1000 + i, "d", 50, 1) for i in range(3)]
    rows += [(2000, None, 10**6, 1), (2001, "unlisted", 10**6, 1)]
    targets = spark.createDataFrame([("a-b", 0.3, 1), ("c", 0.6, 3), ("d", 0.05, 2), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    sizes = _sizes(spark, rows)
    total = sum(r[2] for r in rows if r[1] and M.source_key and r[0] < 2000)
    planned = M.plan(sizes, targets).cache()
    report = {r.source: r for r in M.report(planned).collect()}
    assert {s for s, r in report.items() if r.scarce} == {"d", "none"}
    for s, share in (("a-b", 0.3), ("c", 0.6)):
        assert report[s].used_tokens == round(share * total)
    assert report["d"].used_tokens == 300 and report["none"].used_tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    chosen = M.select(sizes, targets, planned, bucket_rows=7)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, M.select(sizes, targets, planned).collect()))  # whatever the ranges
    used = {r.source: (r.u, r.m) for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("u"), F.max("repeats").alias("m")).collect()}
    assert {s: u for s, (u, _) in used.items()} == {s: r.used_tokens for s, r in report.items() if r.used_tokens}
    assert used["a-b"][1] <= 1 and used["c"][1] <= 3 and used["d"][1] == 2
    assert chosen.count() == chosen.select("doc_id").distinct().count()


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    planned = M.plan(_sizes(spark, []), targets)
    assert [(r.used_tokens, r.scarce) for r in M.report(planned).collect()] == [(0, False)]
    assert M.select(_sizes(spark, []), targets, planned).count() == 0


def _filled(lengths, share, total):
    import pandas as pd

    pdf = pd.DataFrame({"source": "s", "tokens": list(lengths), "n": list(lengths.values()), "target_share": share, "max_repeats": 1, "total": total})
    plan = M.plan_source(pdf)
    return int((plan["tokens"] * plan["extra"]).sum())


def test_long_documents_fill_the_budget():
    """Documents longer than the greedy step can place are left to the knapsack, whatever is left."""
    assert _filled({70_000: 1, 90_000: 1}, 0.5, 200_000) == 90_000
    assert _filled({70_000: 1, 80_000: 1}, 0.5, 150_000) == 70_000
    assert _filled({66_000: 1, 90_000: 1, 95_000: 1}, 0.5, 135_540) == 66_000


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(60_000, 200_000), st.integers(1, 2), min_size=1, max_size=5), st.integers(1, 400_000))
def test_long_documents_equal_brute_force(lengths, budget):
    reach = {0}
    for length, n in lengths.items():
        reach = {r + k * length for r in reach for k in range(n + 1)}
    size = sum(a * n for a, n in lengths.items())
    if budget < size:
        used = _filled(lengths, 0.5, 2 * budget)
        assert used <= budget and budget - used <= max(lengths)
        if all(n == 1 for n in lengths.values()) and budget <= 2 * max(lengths):  # nothing is taken in proportion or by greed
            assert used == max(r for r in reach if r <= budget)
