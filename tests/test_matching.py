import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastegrid.operators import graph, matching

NAMES = [
    "Stumptown", "Stumptown Coffee", "Stumptown Roasters", "Stumptown Coffee Roasters", "Onyx Coffee Lab", "Onyx Coffee Lab LLC", "onyx coffee lab", "Onyx Coffee",
    "Black Oak Coffee Roasters", "Black & White Coffee Roasters", "Red Bay Coffee", "Red Rooster Coffee Roaster", "J.B.C. Coffee Roasters", "JBC Coffee", "The Coffee Company",
    "Café X", "Cafe X", "Stumptwon", None,
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n,) for n in [*NAMES, "Stumptown"]], "roaster string")


def test_keys(names):
    keys = {r.raw_name: r.core_key for r in matching.exact_clusters(names, "roaster").collect()}
    assert {keys[n] for n in NAMES[:4]} == {"stumptown"} and keys["Onyx Coffee"] == "onyx" and keys["Onyx Coffee Lab LLC"] == "lab onyx"
    assert keys["J.B.C. Coffee Roasters"] == keys["JBC Coffee"] == "jbc" and keys["The Coffee Company"] == "coffee company the" and keys["Café X"] == keys["Cafe X"] == "x"


def test_scores():
    assert round(matching.key_score("black oak", "black white"), 2) == 71.43 and matching.key_score("bay red", "red rooster") == 60.0
    assert matching.key_score("onyx", "lab onyx") == 100.0 and round(matching.key_score("stumptown", "stumptwon"), 1) == 88.9
    assert matching.set_ratio("", "a") == 0.0 and matching.sorted_ratio("", "") == 100.0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert matching._common_subsequence(a, b) == row[-1]


def test_no_pair_is_missed(spark):
    heads, tails = ["mala", "kole", "kola", "river", "rivers", "oak"], ["ab", "abc", "mill", "mil", "hill"]
    keys = sorted({" ".join(sorted({h, t})) for h in heads for t in tails} | set(heads))
    got = {(r.core_a, r.core_b) for r in matching.key_pairs(spark.createDataFrame([(k,) for k in keys], "core_key string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(keys, 2) if matching.key_score(a, b) >= matching.REVIEW}


@pytest.mark.parametrize("least", [60.0, 82.0, 92.0])
def test_no_pair_of_random_keys_is_missed(spark, least):
    import random

    rng = random.Random(3)
    stock = ["bay", "river", "rivers", "oak", "mill", "mille", "a", "ab", "hollow", "lantern", "lantetn", "red", "zed"]
    keys = sorted({" ".join(sorted(set(rng.choices(stock, k=rng.randint(1, 4))))) for _ in range(150)})
    got = {(r.core_a, r.core_b) for r in matching.key_pairs(spark.createDataFrame([(k,) for k in keys], "core_key string"), least).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(keys, 2) if matching.key_score(a, b) >= least}


def test_chunks_hold_every_pair_that_lengths_allow(monkeypatch):
    monkeypatch.setattr(matching, "LEAST_KEYS", 10)
    sizes = {3: 4, 4: 6, 5: 25, 6: 9, 7: 30, 11: 1}
    of, pairs = matching._chunks(sizes, 82.0)
    assert {s: n for s, (_, n) in of.items()} == {3: 1, 4: 1, 5: 3, 6: 1, 7: 3, 11: 1}
    for a, b in itertools.combinations_with_replacement(sizes, 2):
        met = {(of[a][0] + x, of[b][0] + y) for x in range(of[a][1]) for y in range(of[b][1])}
        if 200.0 * a / (a + b) >= 82.0:
            assert {(min(m), max(m)) for m in met} <= set(pairs)
    assert of[3] == of[4] and (of[3][0], of[7][0]) not in pairs


def test_keys_in_many_chunks_and_of_one_hot_word_miss_no_pair(spark, monkeypatch):
    import random

    monkeypatch.setattr(matching, "LEAST_KEYS", 12)
    rng = random.Random(11)
    stock = ["lab", "works", "lighthouse", "specialty", "mafufuno", "mafufun", "mafufnuo", "of", "x" * 40, "y" * 30, "zz"]
    keys = sorted({" ".join(sorted(set(["lab", *rng.choices(stock, k=rng.randint(0, 5))]))) for _ in range(160)})
    got = {(r.core_a, r.core_b): r.score for r in matching.key_pairs(spark.createDataFrame([(k,) for k in keys], "core_key string")).collect()}
    scores = {(a, b): matching.key_score(a, b) for a, b in itertools.combinations(keys, 2)}
    assert got == {p: s for p, s in scores.items() if s >= matching.REVIEW}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aab c1", min_size=1, max_size=70), min_size=2, max_size=12))
def test_scores_of_arrays(texts):
    import numpy as np

    from tastegrid.operators.lettering import Lettered, near, pair_scores

    keys = sorted({" ".join(sorted(t.split())) for t in texts}, key=lambda k: (len(k), k))
    held = Lettered(keys, {})
    i, j = np.triu_indices(len(keys), 1)
    want = [matching.key_score(keys[a], keys[b]) for a, b in zip(i, j, strict=True)]
    assert pair_scores(held, held, i, j, matching.key_score).tolist() == want
    met = {(int(a), int(b)) for p, q in near(held, held, 82.0, True) for a, b in zip(p, q, strict=True)}
    letters = pair_scores(held, held, i, j, matching.sorted_ratio, contained=False)
    assert met >= {(int(a), int(b)) for a, b, s in zip(i, j, letters, strict=True) if s >= 82.0}


def test_few_of_many_pairs_are_left_to_score():
    import random

    from tastegrid.operators.lettering import Lettered, near

    rng = random.Random(2)
    keys = sorted({"forest " + "".join(rng.choice(x) for x in ("bdfgkmnprstv", "aeiou") * 4) for _ in range(1500)}, key=lambda k: (len(k), k))
    held = Lettered(keys, {})
    assert 0 < sum(len(i) for i, _ in near(held, held, matching.REVIEW, True)) < 0.03 * len(keys) ** 2 / 2


def test_review_queue_without_clusters(names):
    alone = matching.review_queue(names, "roaster").collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, matching.crosswalk(names, "roaster")[1].collect())) and alone


def test_crosswalk(names):
    table, queue = matching.crosswalk(names, "roaster")
    rows = {r.raw_name: r for r in table.collect()}
    assert len(rows) == len([n for n in NAMES if n])
    assert rows["Stumptown"].canonical_name == "Stumptown" and rows["Stumptown"].n_records == 2 and rows["Stumptown"].cluster_size == 4
    assert rows["Onyx Coffee"].cluster_id == rows["Onyx Coffee Lab"].cluster_id and rows["Onyx Coffee"].canonical_name == "Onyx Coffee Lab LLC"
    assert rows["Black Oak Coffee Roasters"].cluster_id != rows["Black & White Coffee Roasters"].cluster_id
    assert sorted({r.cluster_id for r in rows.values()}) == list(range(len({r.cluster_id for r in rows.values()})))
    assert [(r.core_a, r.core_b, r.score) for r in queue.collect()] == [("stumptown", "stumptwon", 88.9)]
    assert not any(r.chain_risk for r in rows.values())
    totals = matching.diagnostics(table).first()
    assert (totals.names, totals.at_risk) == (len(rows), 0)
    assert {r.raw_name for r in matching.new_names(names, "roaster", table.where("raw_name <> 'JBC Coffee'")).collect()} == {"JBC Coffee"}


def test_canonical_name_and_its_plan(spark):
    rows = [("Onyx", 2), ("ONYX", 2), ("Onyx Coffee", 2), ("onyx coffee", 2), ("The Onyx Coffee Company", 1), ("Mill", 1)]
    table, _ = matching.crosswalk(spark.createDataFrame([(n,) for n, k in rows for _ in range(k)], "roaster string"), "roaster")
    got = {r.raw_name: (r.canonical_name, r.cluster_size, r.cluster_id) for r in table.collect()}
    assert got == {n: ("Mill", 1, 0) if n == "Mill" else ("Onyx Coffee", 5, 1) for n, _ in rows}
    # Each join is a plan that the driver holds and compiles: with the roots, the clusters, and what the worst pair of each comes from.
    assert table._jdf.queryExecution().analyzed().toString().count("Join ") <= 5


def test_chain_risk_and_empty(spark):
    chained = spark.createDataFrame([("black",), ("black oak",), ("black white",)], "roaster string")
    rows = matching.crosswalk(chained, "roaster")[0].collect()
    assert {r.chain_risk for r in rows} == {True} and {r.min_internal_score for r in rows} == {71.4} and len({r.cluster_id for r in rows}) == 1
    table, queue = matching.crosswalk(chained.limit(0), "roaster")
    assert table.count() == queue.count() == 0


def test_components_and_reach_against_python(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, *edges[:9], (None, 1), (2, None)], "a bigint, b bigint")
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert {tuple(r) for r in graph.components(df).collect()} == {(n, find(n)) for n in linked}
    depth, frontier = {1000: 0}, [1000]
    while frontier:
        frontier = [b for a, b in edges if a in frontier and b not in depth and depth.setdefault(b, depth[a] + 1)]
    got = graph.reachable(spark.createDataFrame([(1000,), (None,)], "node bigint"), df).collect()
    assert {tuple(r) for r in got} == set(depth.items())
    assert graph.components(df.limit(0)).count() == 0


def test_diagnostics_without_names(spark, names):
    chained = spark.createDataFrame([(n,) for n in ("black", "black oak", "black white", "mill", "Mill", None)], "roaster string")
    assert tuple(matching.cluster_diagnostics(chained, "roaster").first()) == (5, 2, 1)
    assert tuple(matching.cluster_diagnostics(names, "roaster").first()) == tuple(matching.diagnostics(matching.crosswalk(names, "roaster")[0]).first())
    assert tuple(matching.cluster_diagnostics(chained.limit(0), "roaster").first()) == (0, 0, 0)


def test_streamed_names(spark, tmp_path):
    from tastegrid.streaming.increments import monthly_counts, watch_new_names

    path = lambda n: str(tmp_path / n)
    spark.createDataFrame([("old",)], "raw_name string").write.parquet(path("crosswalk"))
    for names in (["old", "new", "new"], ["new", "newer", None]):
        spark.createDataFrame([(n,) for n in names], "roaster string").coalesce(1).write.mode("append").parquet(path("in"))
    for _ in range(2):
        watch_new_names(spark, path("in"), "roaster string", "roaster", path("crosswalk"), path("out"), path("state")).awaitTermination(120)
    assert sorted(r.raw_name for r in spark.read.parquet(path("out")).collect()) == ["new", "newer"]
    stream = spark.readStream.schema("roaster string").parquet(path("in")).withColumn("at", F.timestamp_seconds(F.lit(0)))
    q = monthly_counts(stream, "at").writeStream.outputMode("complete").format("memory").queryName("months").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("months").first().n == 6
