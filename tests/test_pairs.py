"""Joins of like feature sets: equal sets, blocks of their members, and features that all share."""

import random
import time

import pytest

from quadrille.operators import graph, learning, pairs

OF = {"jaccard": lambda c, n, m: c / (n + m - c), "dice": lambda c, n, m: 2 * c / (n + m), "simpson": lambda c, n, m: c / min(n, m), "ochiai": lambda c, n, m: c / (n * m) ** 0.5, "braun_blanquet": lambda c, n, m: c / max(n, m), "tversky": lambda c, n, m: c / (c + 0.9 * (n - c) + 0.2 * (m - c))}


def frame(spark, sets):
    return spark.createDataFrame(list(sets.items()), "entity string, features array<string>")


@pytest.mark.parametrize("measure", OF)
def test_blocks_equal_brute_force(spark, monkeypatch, measure):
    monkeypatch.setattr(pairs, "BLOCK", 3)
    rng = random.Random(5)
    kinds = [{"all", *rng.sample("abcdefgh", rng.randint(0, 5))} for _ in range(9)]
    one = {f"e{k}": sorted(kinds[k * k % 9]) for k in range(60)}
    other = {f"e{k}": sorted(kinds[k % 4]) for k in range(40, 80)}
    f, args = OF[measure], {"alpha": 0.9, "beta": 0.2} if measure == "tversky" else {}
    for y, ordered in ((one, True), (other, False)):
        want = {}
        for a in one:
            for b in y:
                c = len(set(one[a]) & set(y[b]))
                if (a < b if ordered else a != b) and c and f(c, len(one[a]), len(y[b])) >= 0.6:
                    want[a, b] = round(f(c, len(one[a]), len(y[b])), 9)
        got = learning.similar(frame(spark, one), None if ordered else frame(spark, y), measure, 0.6, **args).collect()
        assert len(got) == len(want) and {(r.left, r.right): round(r.value, 9) for r in got} == want


@pytest.mark.parametrize("join", [lambda df: learning.similar(df, measure="dice", threshold=0.6), lambda df: learning.similar(df, measure="simpson", threshold=0.6), lambda df: graph.similarity(df, df, "jaccard", 0.9)])
def test_a_feature_that_all_share_joins_nothing(spark, join):
    """200 million pairs share it, 10,000 are alike."""
    df = spark.range(20000).selectExpr("cast(id as string) AS entity", "array('all', concat('f', id % 10000)) AS features")
    began = time.time()
    assert join(df).count() == 10000 and time.time() - began < 60
