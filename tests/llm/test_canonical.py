import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastegrid.llm import canonical, queries
from tastegrid.llm.canonical import CanonicalMatcher, Trie, folded

COUNTRIES = ["Ethiopia", "Dominica", "Dominican Republic", "Niger", "Nigeria", "Guinea", "Equatorial Guinea", "Papua New Guinea", "Mali", "Malawi", "El Salvador", "Peru", "China", "Haiti"]
MATCHER = CanonicalMatcher("coffee_origin_country", [(i, c, None) for i, c in enumerate(COUNTRIES, 1)])
MONEY = CanonicalMatcher("price_currency", [(101, "USD", "United States dollar"), (102, "TWD", "New Taiwan dollar"), (109, "EUR", "Euro"), (110, "GBP", "Pound sterling")])


@pytest.mark.parametrize(("value", "entry"), [
    ("ethiopia", "Ethiopia"), ("Éthiopie", "Ethiopia"), ("Erhiopia", "Ethiopia"), ("Eteiopoa", "Ethiopia"), ("Sidama, Ethiopia", "Ethiopia"),
    ("Town, ETH", "Ethiopia"), ("Dominca", "Dominica"), ("Dom. Rep.", "Dominican Republic"), ("Nigerr", "Niger"), ("Nigera", "Nigeria"),
    ("Guinea-Conakry", "Guinea"), ("Eq. Guinea", "Equatorial Guinea"), ("New Guinea, Papua", "Papua New Guinea"), ("southern Papua New Guinea", "Papua New Guinea"),
    ("Mli", "Mali"), ("Mail", "Mali"), ("Malwi", "Malawi"), ("Salvador, El", "El Salvador"), ("PRC", "China"), ("Choma", "China"), ("Hiai", "Haiti"),
    ("per", "Peru"), ("USD per bag", None), ("secret", None), ("Finca Tidoku", None), ("blend no. 6", None), ("?", None), ("Peru and China", None), ("x" * 50_000, None),
])
def test_countries(value, entry):
    assert MATCHER.match(value) == (COUNTRIES.index(entry) + 1 if entry else 0)


@pytest.mark.parametrize(("value", "entry"), [
    ("U.S.D.", 101), ("US $", 101), ("dollars (US)", 101), ("USD - United States dollar", 101), ("Unitedd States dolar", 101), ("N.T. dollars", 102),
    ("Euor", 109), ("€", 109), ("stg", 110), ("card 3859", 0), ("12 points", 0), ("gift", 0),
])
def test_currencies(value, entry):
    assert MONEY.match(value) == entry


CONGO = CanonicalMatcher("coffee_origin_country", [(41, "Democratic Republic of the Congo", None), (42, "Republic of the Congo", None), (46, "Niger", None), (47, "Nigeria", None)])


@pytest.mark.parametrize(("value", "entry"), [
    ("Eqautoial Guinea", "Equatorial Guinea"), ("Equatoriial Guinea", "Equatorial Guinea"), ("Papua mew Guinea", "Papua New Guinea"), ("Paeua Nrw Guinea", "Papua New Guinea"),
    ("southern Papua mew Guinea", "Papua New Guinea"), ("Equaorial, Guinea", "Equatorial Guinea"), ("Town, Equatorrial Guinea", "Equatorial Guinea"), ("Dominica Republic", "Dominican Republic"),
    ("southern Guinea", "Guinea"), ("Guinea 1", "Guinea"), ("Town (Guinea)", "Guinea"), ("Niger, Town", "Niger"), ("Peru and Equatoriial Guinea", None),
])
def test_a_longer_misspelt_entry_beats_a_shorter_one_within(value, entry):
    assert MATCHER.match(value) == (COUNTRIES.index(entry) + 1 if entry else 0)


@pytest.mark.parametrize(("value", "entry"), [
    ("Demoocratic Republic of the Congo", 41), ("Democraric Republic of the Congo", 41), ("Town, Demoratic Republic of the Congo", 41),
    ("Republic of the Congo", 42), ("Town, Republic of the Congo", 42), ("the Republic of the Congo", 42), ("Niger ia", 47), ("Niger i", 46),
])
def test_the_two_congos(value, entry):
    assert CONGO.match(value) == entry


def test_a_word_besides_a_currency_makes_it_no_longer_one():
    money = CanonicalMatcher("price_currency", [(101, "USD", "United States dollar"), (105, "AUD", "Australian dollar")])
    assert money.match("a US dollar") == 101 and money.match("Aus dolar") == 105


def plain_distance(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=8, unique=True), st.text("abc", max_size=7), st.integers(0, 3))
def test_the_automaton_finds_all_within_the_distance(names, typed, most):
    trie = Trie()
    for i, name in enumerate(names):
        trie.add(name, i, 9)
    assert sorted((d, i) for d, i, _ in trie.search(typed, most)) == sorted((plain_distance(n, typed), i) for i, n in enumerate(names) if plain_distance(n, typed) <= most)


def test_rows(spark, data):
    reference = spark.createDataFrame([(1, "c", "Peru", None), (2, "c", "Mali", None), (3, "m", "EUR", "Euro"), (None, "c", "Cuba", None)], "ref_id bigint, field_name string, canonical string, full_name string")
    rows = [(1, "Peru", "euro"), (1, "Peru", "euro"), (2, " NR ", None), (3, "peru", ""), (4, "Atlantis", "EUR"), (None, "peru", "euro")]
    values = spark.createDataFrame(rows, "review_id bigint, c string, m string").withColumns({"value": F.lit(1), "record": F.lit(2), "ref_id": F.lit(3)})
    got = {tuple(r) for r in canonical.canonical_references(values, reference, ["c", "m"], "review_id").collect()}
    assert got == {(1, "m", "euro", 3), (3, "c", "peru", 1), (4, "c", "Atlantis", 0)}
    assert [tuple(r) for r in canonical.unmatched_values(canonical.canonical_references(values, reference, ["c", "m"], "review_id")).collect()] == [("c", "Atlantis", 1)]
    nothing = canonical.canonical_references(values, reference.limit(0), ["c", "m"], "review_id")
    assert {r.ref_id for r in nothing.collect()} == {0}
    assert canonical.canonical_references(values.limit(0), reference, ["c", "m"], "review_id").count() == 0
    found = queries.p6_found(spark, data)
    assert found.count() == found.distinct().count() > 0


def test_folding():
    assert folded(" Côte  d’Ivoire. ") == "cote divoire" and folded("NT$") == "nt $"
