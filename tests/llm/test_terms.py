import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tastegrid.llm import queries, terms
from tastegrid.sources.tables import table

SCHEMA = "review_id bigint, blind_assessment string, notes string"
ROWS = [
    (1, "Plum, plum & oak; an OAK finish", "washed lot"), (1, "Plum, plum & oak; an OAK finish", "washed lot"), (2, "plum cedar", None),
    (3, "", "washed washed"), (4, None, ""), (5, "NR 12 ab", "lot"), (6, "cedar oak", "x" * 300_000 + " lot"), (None, "plum ghost", "ghost"), (7, "cedar oak", "lot"),
]


def words(text):
    return re.findall("[a-z]{3,}", (text or "").lower())


def brute(rows, field):
    by_id = {r[0]: Counter(words(r[field])) for r in rows if r[0] is not None}
    uses, records = Counter(), Counter()
    for c in by_id.values():
        uses.update(c)
        records.update(c.keys())
    return by_id, uses, records, sum(bool(c) for c in by_id.values())


def test_frequencies(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"term": F.lit("x"), "record": F.lit(1), "f0": F.lit("clash"), "key": F.lit(2)})
    for partitions in (1, 3, None):
        got = {(r.field_name, r.term): r for r in terms.term_frequencies(df, ["blind_assessment", "notes"], "review_id", partitions).collect()}
        for k, field in enumerate(("blind_assessment", "notes"), 1):
            _, uses, records, n = brute(ROWS, k)
            assert {t for f, t in got if f == field} == set(uses)
            for t in uses:
                r = got[field, t]
                mark = "rare" if records[t] <= 2 else "common" if records[t] > n / 5 else None
                assert (r.uses, r.records, r.all_records, r.mark) == (uses[t], records[t], n, mark)


def test_frequencies_of_differing_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "oak oak", None), (1, "oak plum", None), (2, "oak", None)], SCHEMA)
    got = {r.term: (r.uses, r.records) for r in terms.term_frequencies(df, ["blind_assessment", "notes"], "review_id").collect()}
    assert got == {"oak": (3, 2), "plum": (1, 1)}
    assert terms.term_frequencies(df.limit(0), ["blind_assessment", "notes"], "review_id").count() == 0


def test_terms_with_the_same_first_letters_and_other_bounds(spark, monkeypatch):
    rows = [(i % 50, f"hot caramelized{'ab'[i % 2] * (i % 3)} caramelizing caramelizati{'on' * (i % 4)} {'zz' * (1 + i % 5)}a", "hot" if i % 3 else None) for i in range(120)] + [(1000 + i, "hot", None) for i in range(300)]
    expected = {}
    for k, field in enumerate(("blind_assessment", "notes"), 1):
        uses = defaultdict(Counter)
        for r in rows:
            for t, c in Counter(words(r[k])).items():
                uses[t][r[0]] = max(uses[t][r[0]], c)
        expected |= {(field, t): (sum(c.values()), len(c)) for t, c in uses.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for drawn, partitions in ((10**6, 5), (0.001, 5), (20, 16)):
            monkeypatch.setattr(terms, "BOUND_RECORDS", drawn)
            got = {(r.field_name, r.term): (r.uses, r.records) for r in terms.term_frequencies(spark.createDataFrame(rows, SCHEMA), ["blind_assessment", "notes"], "review_id", partitions).collect()}
            assert got == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbers_sort_as_terms_do_and_hot_ones_spread():
    import numpy as np
    import pyarrow as pa

    stock = sorted(["abc", "abcd", "zzz", "caramelizing", "caramelizer", "cab", "a" * 11, "a" * 12, "z" * 40])
    codes = terms._codes(3, pa.array(stock))
    assert list(codes) == sorted(codes) and [terms._decoded(int(c), t[terms.CODE_LETTERS :]) for c, t in zip(codes, stock)] == [f"3 {t}" for t in stock]
    known, first, several = terms._bounds(np.array([5, 1, 9]), np.array([80, 10, 10]), 10)
    assert known.tolist() == [1, 5, 9] and first.tolist() == [0, 1, 9] and several.tolist() == [1, 8, 1]


def test_runs_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame([(i % 7, "hot " * (1 + i % 7) + f"t{'abc'[i % 3] * 3}", None) for i in range(7)] * 2, SCHEMA)
        got = {r.term: (r.uses, r.records) for r in terms.term_frequencies(df, ["blind_assessment"], "review_id", 1).collect()}
        assert got["hot"] == (sum(range(1, 8)), 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def best(rows, k=3):
    by_id, _, d, n = brute(rows, 1)
    out = defaultdict(list)
    for i, c in by_id.items():
        scored = sorted((-u * (math.log((1 + n) / (1 + d[t])) + 1), t) for t, u in c.items() if d[t] >= 2)
        out[i] = [t for _, t in scored[:k]]
    return {(i, t) for i, ts in out.items() for t in ts}


def test_best_terms(spark, data):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"record": F.lit(1), "texts": F.lit("x"), "words": F.lit("y")})
    models = terms.record_models(df, "blind_assessment", "review_id")
    assert {tuple(r) for r in terms.best_terms(models, "score").collect()} == best(ROWS)
    rows = [tuple(r) for r in table(spark, data, "raw_reviews").select("review_id", "blind_assessment").collect()]
    assert {tuple(r) for r in queries.p2_found(spark, data).collect()} == best(rows)
    assert terms.best_terms(terms.record_models(df.limit(0), "blind_assessment", "review_id"), "score").count() == 0


def test_parsimonious_model(spark):
    rows = [(i, "the roast and the cup" + (" bergamot" if i < 3 else ""), None) for i in range(40)] + [(99, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    scored = {(r.record, r.term): r for r in terms.distinctive_terms(df, "blind_assessment", "review_id").collect()}
    assert math.isclose(sum(r.probability for (i, _), r in scored.items() if i == 1), 1.0)
    assert scored[1, "bergamot"].probability > 0.9 > scored[1, "the"].probability
    joined = terms.record_models(df, "blind_assessment", "review_id", broadcast_terms=0).select("record", F.inline("terms"))
    assert all(math.isclose(r.probability, scored[r.record, r.term].probability, abs_tol=1e-12) for r in joined.collect())
    assert joined.count() == len(scored)
