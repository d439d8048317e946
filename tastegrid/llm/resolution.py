"""Spellings of the same company linked by merging and matching again.

A spelling is a form: its telling words, or its initials, and the town and country it was seen with. Equal forms are
one profile. In each round, profiles meet others in blocks, matching ones merge, and the merged profile has all
their spellings, initials and places. So enriched, it enters the blocks again: its spellings without a town enter
those of the town it now has, where names may be further apart; a form without a place, which could not be told
apart before, may now meet one place only; and a form of initials one company that has them. The rounds end when
nothing merges any more. What two spellings are apart doesn't change, so it is measured when they first meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastegrid.functions.blanks import is_blank
from tastegrid.functions.runtime import checkpointed
from tastegrid.llm import names
from tastegrid.operators.graph import components

#: Spellings in the same town whose words are at most so far apart are one company.
SAME_TOWN_GAP = 2.5
#: The same where a place is unknown, and for each word there, as many words lie near each other.
NO_TOWN_GAP = 2.0
LONE_WORD_GAP = 1.0
#: A block of more pairs is parted by the words that its names have besides the one that opened it.
BLOCK_PAIRS = 2_500

_FORM = "form string, core array<string>, initials string, town string, country string"


def forms(rows: DataFrame, id_column: str, name_column: str, place_column: str) -> DataFrame:
    """record, form, core, initials, town, country of each row with an id and a name that is not blank."""
    texts = rows.where(F.col(id_column).isNotNull() & ~is_blank(F.col(name_column))).select(
        F.col(id_column).alias("record"), F.col(name_column).alias("name"), F.col(place_column).alias("place")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, (name, place) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                core, initials = names.spelling(name)
                if core or initials:
                    town, country = names.place(place)
                    keep.append(k)
                    form = "|".join((" ".join(core), initials or "", town or "", country or ""))
                    out.append({"form": form, "core": list(core), "initials": initials, "town": town, "country": country})
            schema = pa.schema([("form", pa.string()), ("core", pa.list_(pa.string())), ("initials", pa.string()), ("town", pa.string()), ("country", pa.string())])
            table = pa.Table.from_pylist(out, schema).combine_chunks()
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["record", *schema.names])

    kind = texts.schema["record"].dataType.simpleString()
    return texts.mapInArrow(read, f"record {kind}, {_FORM}").distinct()


def _variants(word: str, most: int) -> set[str]:
    """The word and what is left of it without a letter, or without two where ``most`` is 2 and the word long enough
    for two typos: words so many letters apart share one of them."""
    if len(word) < 4:
        return {word}
    one = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    return one | {v[:i] + v[i + 1 :] for v in one for i in range(len(v)) if len(v) < len(word)} if most == 2 and len(word) >= 7 else one


def _abbreviated(word: str) -> bool:
    return not set(word[1:]) & set("aeiou")


#: How names in a block meet: all of them, or only such as may hold an abbreviation with all.
ALL, SHORT, LONG = 0, 1, 2


def block_keys(core: list[str], edits: int) -> list[tuple[str, int]]:
    """Keys of a name, of which two names within SAME_TOWN_GAP share one, and how they meet in its block.

    Names of one word share what is left of it without ``edits`` letters, or it may be short for the other's. Two of
    two words share what is left of one without a letter, or one is short for the other; two of more words have an
    equal word, or one is short for the other. Short words meet by their first letter. Names of other numbers of
    words are run together: one letter changes either their start or their end.
    """
    n, joined = len(core), "".join(core)
    ends = {f"=< {joined[:5]}", f"=> {joined[-5:]}"} if len(joined) >= 11 else set()
    keys = dict.fromkeys(ends | ({f"= {v}" for v in _variants(joined, 1)} if len(joined) <= 11 else set()), ALL)
    if n == 1:
        bare = core[0][0] + "".join(c for c in core[0][1:] if c not in "aeiou")
        keys |= {f"1~{bare[:k]}": LONG for k in {*range(1, 5), len(bare)}}
        keys |= {f"1~{core[0]}": SHORT} if _abbreviated(core[0]) else {}
    for w in core:
        keys |= dict.fromkeys((f"{n} {v}" for v in (_variants(w, edits) if n == 1 else _variants(w, 1) if n == 2 else (w,))), ALL)
        if n > 1:
            keys[f"{n}~{w[0]}"] = SHORT if _abbreviated(w) else keys.get(f"{n}~{w[0]}", LONG)
    return sorted(keys.items())


def finer_keys(core: list[str], key: str, edits: int) -> list[tuple[str, int]]:
    """Keys of which two near names in the block of ``key`` share one: by the words that did not open it."""
    n, word = len(core), key.partition(" ")[2]
    if key[0] == "=":
        return [(v, ALL) for v in sorted(_variants("".join(core), 1))]
    if n == 1:
        return [("", ALL)]
    keys: dict[str, int] = {}
    for i, w in enumerate(core):
        if not (w == word or (n == 2 and word in _variants(w, 1)) if word else w[0] == key[-1]):
            continue
        for x in core[:i] + core[i + 1 :]:
            # Of two words, one may be two letters apart if the other is equal or short.
            keys |= dict.fromkeys(_variants(x, edits if n == 2 and (not word or w == word) else 1), ALL)
            keys[f"~{x[0]}"] = SHORT if _abbreviated(x) else keys.get(f"~{x[0]}", LONG)
    return sorted(keys.items())


def _keyed(met: DataFrame) -> DataFrame:
    """id, asks, edits, block, place, how, words: the blocks of forms with id, core, scope, asks and edits.

    ``place`` is that of the key among the form's; ``words`` their number where names must differ in it. Blocks are hashed.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, (core, edits) in enumerate(zip(batch.column("core").to_pylist(), batch.column("edits").to_pylist(), strict=True)):
                for place, (key, how) in enumerate(block_keys(core, edits)):
                    at.append(k)
                    out.append((key, place, how, len(core) if key[0] == "=" else 0))
            taken = batch.select(["id", "scope", "asks", "edits"]).take(pa.array(at, pa.int64()))
            columns = [pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *columns], [*taken.schema.names, "key", "place", "how", "words"])

    made = met.select("id", "scope", "asks", "edits", "core").mapInArrow(keys, "id bigint, scope string, asks boolean, edits int, key string, place int, how int, words int")
    return made.select("id", "asks", "edits", F.xxhash64("scope", "key").alias("block"), "place", "how", "words")


def _finer(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """id, asks, block, how, finer, words: the blocks that the forms of large blocks enter instead."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, (core, place, edits) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("core", "place", "edits")], strict=True)):
                for key in finer_keys(core, block_keys(core, edits)[place][0], edits):
                    at.append(k)
                    out.append(key)
            taken = batch.take(pa.array(at, pa.int64())).select(["id", "asks", "block", "how", "words"])
            columns = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *columns], [*taken.schema.names, "key", "finer"])

    with_core = keyed.join(known.select("id", "core").hint("merge"), "id").select("id", "asks", "block", "how", "words", "place", "edits", "core")
    made = with_core.mapInArrow(keys, "id bigint, asks boolean, block bigint, how int, words int, key string, finer int")
    return made.select("id", "asks", F.xxhash64("block", "key").alias("block"), "how", "finer", "words")


def _meeting(met: DataFrame, known: DataFrame) -> DataFrame:
    """id_a, id_b: every form that asks with those that share a block, once; ``met`` has id, core, scope, asks, edits.

    Blocks of more than BLOCK_PAIRS pairs are parted.
    """
    keyed = checkpointed(_keyed(met))
    short = F.col("how") == SHORT
    sizes = keyed.groupBy("block").agg(
        F.max("how").alias("how"), F.count("*").alias("met"), F.count_if("asks").alias("asking"), F.count_if(short).alias("short"), F.count_if(short & F.col("asks")).alias("short_asking")
    )
    pairs = F.when(F.col("how") == ALL, F.col("met") * F.col("asking")).otherwise(F.col("met") * F.col("short_asking") + F.col("short") * F.col("asking"))
    large = checkpointed(sizes.where(pairs > BLOCK_PAIRS).select("block"))
    whole = lambda df: df.select("id", "asks", "block", "how", F.lit(ALL).alias("finer"), "words")
    if large.isEmpty():
        rows = whole(keyed)
    else:
        rows = whole(keyed.hint("merge").join(large, "block", "left_anti")).union(_finer(keyed.hint("merge").join(large, "block", "left_semi"), known))

    def turns(how: str, long: int) -> Column:
        return F.when(F.col(how) == ALL, F.array(F.lit(0))).when(F.col(how) == SHORT, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(long)))

    def side(x: str, long: int) -> DataFrame:
        turned = rows.withColumn("turn", F.explode(turns("how", long))).withColumn("finer_turn", F.explode(turns("finer", long)))
        # One number to meet by and one for the flags keep what is shuffled and sorted short.
        flags = F.col("words") * 2 + F.col("asks").cast("int")
        return turned.select(F.xxhash64("block", "turn", "finer_turn").alias("block"), F.col("id").alias(f"id_{x}"), flags.alias(f"flags_{x}"))

    both = side("l", 2).where("flags_l % 2 = 1").hint("merge").join(side("r", 1), "block")
    both = both.where("(id_l < id_r or (id_l > id_r and flags_r % 2 = 0)) and (flags_l < 2 or flags_l div 2 <> flags_r div 2)")
    return both.select(F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b")).distinct()


def _scored(pairs: DataFrame) -> DataFrame:
    """Adds gap and widest, that of the words furthest apart, to rows with core_a and core_b."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("core_a").to_pylist(), batch.column("core_b").to_pylist()
            gaps = [names.gaps(tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)]
            columns = [pa.array([float(g[k]) for g in gaps], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "gap", "widest"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(score, f"{fields}, gap double, widest double")


def resolve(rows: DataFrame, id_column: str = "name_id", name_column: str = "roaster", place_column: str = "roaster_location") -> DataFrame:
    """record, entity: the company of each row, named by one of its forms.

    Rows without an id give no row; rows whose name is blank (null, empty, a missing marker), or has no letter or
    digit, are companies of their own that nothing is linked to and give no row either; equal rows count once; a row's id is
    taken to be unique; further columns are ignored.
    """
    read = checkpointed(forms(rows, id_column, name_column, place_column))
    known = read.select("form", "core", "initials", "town", "country").dropDuplicates(["form"]).withColumn("id", F.monotonically_increasing_id())
    known = checkpointed(known.withColumns({"entity": F.col("id"), "at_town": F.col("town"), "at_country": F.col("country"), "entered": F.col("town").isNotNull()}))
    here = _within(known.where("town is not null"), "town", F.lit(True))
    anywhere = known.where("initials is null").select("id", "core", F.lit(None).cast("string").alias("scope"), F.col("town").isNull().alias("asks"), F.lit(1).alias("edits"))
    measured = _measured(known, _meeting(here.union(anywhere), known))
    while True:
        roots = components(_edges(known, measured))
        if roots.isEmpty():
            break
        known = _merged(known, roots)
        fresh = known.where("initials is null and at_town is not null and not entered")
        if not fresh.isEmpty():
            placed = known.join(fresh.select("at_town").distinct(), "at_town", "left_semi")
            measured = measured.union(_measured(known, _meeting(_within(placed, "at_town", ~F.col("entered")), known)))
            known = known.withColumn("entered", F.col("at_town").isNotNull())
    names_ = known.groupBy("entity").agg(F.min("form").alias("name"))
    companies = known.select("form", "entity").join(names_, "entity").select("form", F.col("name").alias("entity"))
    return read.select("record", "form").join(companies, "form").select("record", "entity")


def _within(forms_: DataFrame, town: str, asks: Column) -> DataFrame:
    """id, core, scope, asks, edits: forms for the blocks of their towns."""
    return forms_.where("initials is null").select("id", "core", F.col(town).alias("scope"), asks.alias("asks"), F.lit(2).alias("edits"))


def _merged(known: DataFrame, roots: DataFrame) -> DataFrame:
    """The forms with the profiles that they belong to after theirs merged into ``roots``, and with their places."""
    moved = known.join(roots.withColumnsRenamed({"node": "entity"}), "entity", "left").withColumn("entity", F.coalesce("root", "entity"))
    places = moved.groupBy("entity").agg(F.max("town").alias("at_town"), F.max("country").alias("at_country"))
    return checkpointed(moved.drop("at_town", "at_country").join(places, "entity").select(*known.columns))


def _measured(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """id_a, id_b, gap, widest of the pairs within SAME_TOWN_GAP.

    They are measured where the second join leaves them, in as many parts as a shuffle has: few bytes, much to do.
    """
    cores, parts = known.select("id", "core"), int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.hint("merge").join(cores.withColumnsRenamed({"id": "id_a", "core": "core_a"}), "id_a").repartition(parts, "id_b")
    pairs = pairs.hint("merge").join(cores.withColumnsRenamed({"id": "id_b", "core": "core_b"}).repartition(parts, "id_b"), "id_b")
    near = _scored(pairs.select("id_a", "id_b", "core_a", "core_b")).where(F.col("gap") <= SAME_TOWN_GAP)
    return checkpointed(near.select("id_a", "id_b", "gap", "widest"))


def _edges(known: DataFrame, measured: DataFrame) -> DataFrame:
    """a, b: profiles that merge in this round."""
    side = lambda x: known.select(*[F.col(c).alias(f"{n}_{x}") for c, n in (("id", "id"), ("entity", "entity"), ("at_town", "town"), ("at_country", "country"))])
    pairs = measured.hint("merge").join(side("a"), "id_a").hint("merge").join(side("b"), "id_b").where("entity_a <> entity_b").drop("id_a", "id_b")
    pairs = checkpointed(pairs.groupBy(*[c for c in pairs.columns if c not in ("gap", "widest")]).agg(
        F.min("gap").alias("gap"), F.min(F.when((F.col("gap") <= NO_TOWN_GAP) & (F.col("widest") <= LONE_WORD_GAP), F.col("gap"))).alias("loose_gap")
    ))
    in_town = pairs.where("town_a = town_b").select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"))

    # A profile without a town goes to the nearest one with a town, if the nearest ones are all of one town.
    turned = pairs.where("loose_gap is not null and (country_a is null or country_b is null or country_a = country_b)").select(
        *[F.when(F.col("town_a").isNull(), F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{z}")
          for c in ("entity", "town") for x, y, z in (("a", "b", "a"), ("b", "a", "b"))],
        F.col("loose_gap").alias("gap"),
    )
    open_ = turned.where("town_a is null and town_b is not null")
    towns = open_.groupBy("entity_a", "gap").agg(F.min("town_b").alias("low"), F.max("town_b").alias("high"))
    towns = towns.groupBy("entity_a").agg(F.min(F.struct("gap", "low", "high")).alias("least")).select("entity_a", "least.*").where("low = high")
    nearest = open_.join(towns, ["entity_a", "gap"]).select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"))

    # Profiles without a town, none of which has a placed one near it, merge with each other.
    lost = turned.where("town_a is null and town_b is null").select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"))
    placed = open_.select(F.col("entity_a").alias("entity")).distinct()
    lost = lost.join(placed.withColumnRenamed("entity", "a"), "a", "left_anti").join(placed.withColumnRenamed("entity", "b"), "b", "left_anti").select("a", "b")

    # Initials go to the one profile of their town that has them: in this order, else in any.
    letters = F.array_join(F.transform(F.col("core"), lambda w: F.substring(w, 1, 1)), "")
    town = F.col("at_town").alias("town")
    full = known.where("initials is null and size(core) between 2 and 5 and at_town is not null").select("entity", letters.alias("letters"), town).distinct()
    short = known.where("initials is not null and at_town is not null").select("entity", F.col("initials").alias("letters"), town)
    met = _only_match(short, full, "letters")
    rest = short.join(full.select("letters", "town"), ["letters", "town"], "left_anti")
    met = met.union(_only_match(_sorted_letters(rest), _sorted_letters(full), "letters"))
    alike = short.groupBy("letters", "town").agg(F.min("entity").alias("b"))
    alike = short.join(alike, ["letters", "town"]).select(F.col("entity").alias("a"), "b").where("a <> b")
    return in_town.union(nearest).union(lost).union(met).union(alike)


def _sorted_letters(df: DataFrame) -> DataFrame:
    return df.withColumn("letters", F.array_join(F.array_sort(F.split("letters", "")), ""))


def _only_match(short: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """a, b: profiles of initials with the profile of their town that alone has the same key."""
    one = Window.partitionBy(key, "town")
    met = short.select(key, "town", F.col("entity").alias("a")).distinct().join(full.select(key, "town", F.col("entity").alias("b")).distinct(), [key, "town"])
    return met.withColumns({"low": F.min("b").over(one), "high": F.max("b").over(one)}).where("low = high and a <> b").select("a", "b")


def linked_pairs(resolved: DataFrame) -> DataFrame:
    """name_id_a, name_id_b: every two rows of one company, smaller id first.

    The result is defined as pairs; it has as many rows as there are pairs to report, and is joined by company.
    """
    side = lambda x: resolved.select(F.col("record").alias(f"name_id_{x}"), "entity")
    return side("a").join(side("b"), "entity").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
