import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastegrid.llm import names, queries, resolution
from tastegrid.sources.tables import table

SCHEMA = "name_id bigint, roaster string, roaster_location string"


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"record": F.lit(1), "form": F.lit("x"), "entity": F.lit(2), "key": F.lit(3)})
    return {tuple(r) for r in resolution.linked_pairs(resolution.resolve(df)).collect()}


def all_pairs(*groups):
    return {p for g in groups for p in itertools.combinations(sorted(g), 2)}


def test_spellings_initials_places(spark):
    rows = [
        (1, "Puporide Bridge Sisters Coffee Lab", "Bepokimar, Germany"), (2, "PUPORIDE BRIDGE SISTERS COFFEE LAB", "Bepokimar (Germany)"),
        (3, "P.B.S. Coffee Lab", "Bepokimar, DE"), (4, "Bridge Sisters Puporide", "NR"), (5, "Puporied Bridge Sisters, LLC", None), (6, "PuporideBridge Sisters Café", "Germany"),
        (7, "Puporide Bridge Brothers Roasters", "Bepokimar, Germany"), (8, "Michael Dofosuson Coffee", "Dazuzoport, UK"), (9, "Mike Dofosusn Roastery", "Dazuzoport"),
        (10, "Dofosuson, M. Coffee Works", "Dazuzoport (United Kingdom)"), (11, "Benjamin Dofosuson Coffee", "Dazuzoport"), (12, "Jokalemi Coffee", "Gitebiholm, Norway"),
        (13, "Jokalemi Coffee", "Difihifield, Norway"), (14, "Jokalemi Roasters", None), (15, None, "Gitebiholm"), (16, " ", None), (17, "Coffee Company", "Gitebiholm"), (19, "NR", "Gitebiholm"), (20, " NR ", "Gitebiholm"), (21, "NA", "Gitebiholm"),
        (18, "Café Jokalémi's", "gitebiholm, norway"), (None, "Jokalemi Coffee", "Gitebiholm, Norway"), (18, "Café Jokalémi's", "gitebiholm, norway"),
    ]
    assert pairs(spark, rows) == all_pairs((1, 2, 3, 4, 5, 6), (8, 9, 10), (12, 18))


def test_ambiguous_initials_and_empty_table(spark):
    rows = [(1, "Apoku Canyon Harbor", "Town, Norway"), (2, "Avize Creek Hill", "Town"), (3, "A.C.H. Coffee", "Town"), (4, "A. C. H. Roasters", "Town, NO")]
    assert pairs(spark, rows) == {(3, 4)}
    assert pairs(spark, []) == set()


@pytest.mark.parametrize(("a", "b", "near"), [
    ("Onyx Coffee Lab", "onyx", True), ("Tajaziko Brothers", "Tajaziko Bros. Coffee", True), ("Mabakuje Forest", "Mabakuje Frst", True),
    ("J. Vasuriran", "Charlotte Vasuriran", False), ("Hollow Lantern", "Hollow Lantetn", True), ("Red Bay", "Red Rooster", False),
])
def test_gap(a, b, near):
    assert (names.gap(names.spelling(a)[0], names.spelling(b)[0]) <= resolution.SAME_TOWN_GAP) == near


def test_blocks_miss_no_near_pair_of_a_town(spark, data):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "roaster_names").select("name_id", "roaster", "roaster_location").collect()]
    got = {tuple(r) for r in queries.p3_found(spark, "/root/testdata/sf0.01").collect()}
    read = [(i, names.spelling(n)[0], names.place(p)[0]) for i, n, p in rows if n]
    for (i, a, s), (j, b, t) in itertools.combinations(sorted(read), 2):
        if s and s == t and a and b and names.gap(a, b) <= 1:
            assert (i, j) in got


def turned(keys, long):
    """Keys with the turns in which a name asks (``long`` 2) or is met (1)."""
    return {(k, t) for k, how in keys for t in {resolution.ALL: (0,), resolution.SHORT: (1, 2), resolution.LONG: (long,)}[how]}


def meet(a, b, edits):
    """Whether a name that asks shares a block with the other, and one of the parts into which any such block may fall."""
    shared = turned(resolution.block_keys(list(a), edits), 2) & turned(resolution.block_keys(list(b), edits), 1)
    parts = lambda c, k, long: turned(resolution.finer_keys(list(c), k, edits), long)
    return any(parts(a, k, 2) & parts(b, k, 1) for k, _ in shared)


@pytest.mark.parametrize(("a", "b"), [
    (("pijuseno", "river"), ("piujseno", "river")), (("pijuseno", "river"), ("pijusneo", "rivre")), (("j", "pijuseno"), ("jane", "pijuseno")),
    (("pijuseno", "river"), ("pijusenoriver",)), (("pijusenno", "river"), ("pijusenoriver",)), (("pijuseno", "river"), ("pimuseto", "river")),
    (("j", "pijuseno"), ("jane", "pimuseto")), (("j", "rvr"), ("jane", "river")), (("river", "pijuseno", "j"), ("pijusenp", "jane", "river")), (("pijuseno",), ("pimuseto",)),
])
def test_near_names_meet_however_frequent_their_words_are(a, b):
    assert names.gap(a, b) <= resolution.SAME_TOWN_GAP
    assert meet(a, b, 2) and meet(b, a, 2)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.data())
def test_names_a_few_letters_apart_meet(data):
    letters = "aeioubcdrst"
    a = data.draw(st.lists(st.text(letters, min_size=1, max_size=9), min_size=1, max_size=3))
    b = list(data.draw(st.permutations(a)))
    for _ in range(data.draw(st.integers(1, 3))):
        k = data.draw(st.integers(0, len(b) - 1))
        i, new = data.draw(st.integers(0, len(b[k]))), data.draw(st.sampled_from(["", *letters]))
        b[k] = data.draw(st.sampled_from([b[k][:i] + new + b[k][i:], b[k][:i] + new + b[k][i + 1 :], b[k][:i] + b[k][i + 1 : i + 2] + b[k][i : i + 1] + b[k][i + 2 :], b[k][:1]])) or b[k]
    a, b = tuple(a), tuple(b)
    if a != b and names.gap(a, b) <= resolution.SAME_TOWN_GAP:
        assert meet(a, b, 2) and meet(b, a, 2)
    if a != b and names.gap(a, b) <= resolution.NO_TOWN_GAP and names.widest(a, b) <= resolution.LONE_WORD_GAP:
        assert meet(a, b, 1) and meet(b, a, 1)


def test_large_blocks_are_parted(spark, monkeypatch):
    rows = [(1, "Pijuseno River Coffee", "Town"), (2, "Piujseno River", "Town"), (3, "Pijuseno Hill", "Town"), (4, "Puporide River", "Town"), (5, "Pijuseno Hill", "Other"), (6, "Piujseno Lake", "Third"),
            (7, "Pijuseno Riverr", None), (8, "P. Lantern Mill", "Town"), (9, "Pamela Lantern Mill", "Town"), (10, "PamelaLantern Mill", None)]
    whole = pairs(spark, rows)
    monkeypatch.setattr(resolution, "BLOCK_PAIRS", 0)
    assert pairs(spark, rows) == whole == all_pairs((1, 2, 7), (8, 9, 10))


def test_a_merged_spelling_enters_the_blocks_of_its_town(spark):
    """The second has no town until it meets the first; the third is near the second only, and two letters apart."""
    rows = [(1, "Pijuseno Summit", "Town"), (2, "Pijusano Summit", None), (3, "Pitusaro Summit", "Town"), (4, "Pitusaro Summit", "Other")]
    assert names.gap(("pijuseno", "summit"), ("pitusaro", "summit")) > resolution.SAME_TOWN_GAP
    assert pairs(spark, rows) == all_pairs((1, 2, 3))


def test_without_a_town_no_word_is_two_letters_apart(spark):
    rows = [(1, "Pipemoki Summit", "Town"), (2, "Rizemoki Summit", None), (3, "Pipemoky Summit", None)]
    assert pairs(spark, rows) == {(1, 3)}
