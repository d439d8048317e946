"""Schemas that drift between files: one consistent table, and a report of every change.

The fields of each file are read off its records into a catalogue (feed, file_seq, field, type), which stands for
the footers of files that have one. A column's lifespans are the islands of consecutive files that have it with
one type; ``lag`` and ``lead`` over the catalogue log their starts and endings. A field that ends where another
starts is held against it by the reviews that both files carry. The consistent table takes its casts from a table
of aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastegrid.functions.blanks import BLANK_MARKERS, is_blank, utrim
from tastegrid.functions.runtime import checkpointed

#: The fields looked for in each file are broadcast for so many files, some tens of megabytes; beyond it records are joined with them.
BROADCAST_FILES = 100_000

# Canonical columns of a review, their types, and the names under which files carry them.
REVIEW_ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "url": ("string", ("url",)),
    "roaster": ("string", ("roaster",)),
    "title": ("string", ("title",)),
    "rating": ("double", ("rating",)),
    "acidity": ("double", ("acidity", "Acidity", "acid", "acidity.", "acidity_score", "acidity (1-10)")),
    "acidity_structure": (
        "double",
        ("acidity/structure", "Acidity / Structure", "acidity_structure", "acidity-structure", "acid/struct."),
    ),
    "with_milk": ("double", ("with milk", "With Milk", "with_milk", "withMilk", "in milk", "milk")),
    "aroma": ("double", ("aroma", "Aroma")),
    "body": ("double", ("body", "Body", "mouthfeel")),
    "flavor": ("double", ("flavor", "Flavor", "flavour")),
    "aftertaste": ("double", ("aftertaste", "Aftertaste", "after taste", "finish")),
    "agtron": ("string", ("agtron", "Agtron")),
    "est_price": ("string", ("est. price", "est_price", "price (est.)")),
    "roaster_location": ("string", ("roaster location", "roaster_location")),
}


def _fields(record: Column) -> Column:
    """MAP<STRING, VARIANT> of a JSON object, null for every other line."""
    return F.try_parse_json(record).try_cast("map<string,variant>")


def cells(records: DataFrame) -> DataFrame:
    """file_id, field, kind: one row per key of a JSON object; blanks have no kind.

    kind is 3 for text, 2 for numbers written with a point, 1 for whole numbers, 0 for true and false.
    """
    parsed = records.where("file_id is not null").select("file_id", F.explode(_fields(F.col("record"))).alias("field", "v"))
    return parsed.select("file_id", "field", _kind().alias("kind"))


def _kind() -> Column:
    schema, text = F.schema_of_variant("v"), F.col("v").cast("string")
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(schema == "STRING", F.when(~is_blank(text), F.lit(3)))
        .when(schema == "BOOLEAN", F.lit(0))
        .when(schema == "BIGINT", F.lit(1))
        .when(schema.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit(2))
        .otherwise(F.lit(3))
    )


def _filled(records: DataFrame, wanted: DataFrame, role: str) -> DataFrame:
    """file_id, url, and field, kind and value named by the role: the non-blank cells under the fields wanted in each file.

    ``wanted``: at_id, the file; file_id, whose change is looked into; fields. Only records of these files are parsed, and
    only these fields are unpacked.
    """
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_FILES else wanted
    lines = records.select(F.col("file_id").alias("at_id"), "record")
    of_files = lines.join(few, "at_id").select("file_id", "fields", _fields(F.col("record")).alias("all"))
    url = F.try_element_at("all", F.lit("url")).cast("string")
    rows = of_files.select("file_id", url.alias("url"), F.explode(F.map_filter("all", lambda k, _: F.array_contains("fields", k))).alias("field", "v"))
    number = F.col("kind").isin(1, 2)
    typed = rows.where("url is not null").select("file_id", "url", "field", _kind().alias("kind"), "v").where("kind is not null")
    value = F.when(number, F.col("v").try_cast("double").cast("string")).otherwise(F.col("v").cast("string"))
    return typed.select("file_id", "url", F.col("field").alias(f"{role}_field"), (F.col("kind") == 3).alias(f"{role}_text"), value.alias(f"{role}_value"))


def field_catalogue(files: DataFrame, records: DataFrame) -> DataFrame:
    """feed, file_seq, file_id, field, kind: which file has which field, and the type of its non-blank values.

    Fields are combined where the records lie; only the catalogue meets the table of files.
    """
    known = files.select("file_id", "feed", "file_seq").where("file_id is not null and feed is not null and file_seq is not null").distinct()
    return cells(records).groupBy("file_id", "field").agg(F.max("kind").alias("kind")).join(known, "file_id")


def _lifespans(catalogue: DataFrame) -> DataFrame:
    own = Window.partitionBy("feed", "field").orderBy("file_seq", "file_id")
    return catalogue.select(
        "*",
        F.lag("file_seq").over(own).alias("before_seq"),
        F.lag("kind").over(own).alias("before_kind"),
        F.lead("file_seq").over(own).alias("after_seq"),
    )


def lifespans(catalogue: DataFrame) -> DataFrame:
    """feed, field, kind, first_seq, last_seq: each island of consecutive files that have a field with one type."""
    own = Window.partitionBy("feed", "field").orderBy("file_seq", "file_id")
    fresh = F.col("before_seq").isNull() | (F.col("before_seq") < F.col("file_seq") - 1) | ~F.col("kind").eqNullSafe(F.col("before_kind"))
    islands = _lifespans(catalogue).select("feed", "field", "kind", "file_seq", F.sum(fresh.cast("int")).over(own).alias("island"))
    return (
        islands.groupBy("feed", "field", "kind", "island")
        .agg(F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq"))
        .drop("island")
    )


def schema_changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """file_id, change, old_field, new_field: each change of a file against the file before it in its feed.

    ``files``: file_id, feed, file_seq; ``records``: file_id, record (a JSON object as text). Changes are added
    (old_field ''), removed (new_field ''), renamed and retyped (both names equal). First files have none. Lines
    that are no JSON object, records of unknown files and files without feed or number are ignored; a field that
    has only blanks in a file is there, but has no type; repeated rows count once; further columns are ignored.
    """
    log = _lifespans(checkpointed(field_catalogue(files, records)))
    numbered = files.select("file_id", "feed", "file_seq").where("file_id is not null").distinct()
    pairs = numbered.alias("now").join(
        numbered.alias("old"),
        (F.col("now.feed") == F.col("old.feed")) & (F.col("now.file_seq") == F.col("old.file_seq") + 1),
    ).select(F.col("now.file_id").alias("file_id"), F.col("old.file_id").alias("old_id"))
    retyped = log.where("before_seq = file_seq - 1 and kind <> before_kind").select(
        "file_id", F.lit("retyped").alias("change"), F.col("field").alias("old_field"), F.col("field").alias("new_field")
    )
    came = log.where("before_seq is null or before_seq < file_seq - 1").select("file_id", F.col("field").alias("new_field"))
    came = came.join(pairs, "file_id")
    went = log.where("after_seq is null or after_seq > file_seq + 1").select(F.col("file_id").alias("old_id"), F.col("field").alias("old_field"))
    went = went.join(pairs, "old_id")
    renamed = checkpointed(_renamed(records, came, went))
    added = came.join(renamed, ["file_id", "new_field"], "left_anti").select(
        "file_id", F.lit("added").alias("change"), F.lit("").alias("old_field"), "new_field"
    )
    removed = went.join(renamed, ["file_id", "old_field"], "left_anti").select(
        "file_id", F.lit("removed").alias("change"), "old_field", F.lit("").alias("new_field")
    )
    named = renamed.select("file_id", F.lit("renamed").alias("change"), "old_field", "new_field")
    return retyped.unionByName(named).unionByName(added).unionByName(removed).distinct()


def _renamed(records: DataFrame, came: DataFrame, went: DataFrame) -> DataFrame:
    """file_id, old_field, new_field: a field that went and one that came, equal in every review that both files carry.

    Where a field that went equals several that came, or the other way round, each of them is one.
    """
    new = came.groupBy("file_id").agg(F.collect_set("new_field").alias("fields"))  # no more than a file has fields
    old = went.groupBy("file_id", F.col("old_id").alias("at_id")).agg(F.collect_set("old_field").alias("fields"))
    wanted = new.join(old.select("file_id").distinct(), "file_id", "left_semi").select(F.col("file_id").alias("at_id"), "file_id", "fields", F.lit("new").alias("role"))
    wanted = checkpointed(wanted.union(old.join(new, "file_id", "left_semi").select("at_id", "file_id", "fields", F.lit("old"))))
    had, has = (_filled(records, wanted.where(F.col("role") == role).drop("role"), role) for role in ("old", "new"))
    met = had.join(has, ["file_id", "url"]).groupBy("file_id", "old_field", "new_field")
    same = (F.col("new_value") == F.col("old_value")) & (F.col("new_text") == F.col("old_text"))
    return met.agg(F.bool_and(same).alias("all_equal")).where("all_equal").drop("all_equal")


def consistent_table(files: DataFrame, records: DataFrame, aliases: dict[str, tuple[str, tuple[str, ...]]] = REVIEW_ALIASES) -> DataFrame:
    """All records as one table: feed, file_seq, file_id, line_no, a column for each canonical name, and ``extras``.

    Each column is the first non-blank value under one of its aliases, cast to its type; a value that cannot be cast
    is null there and stays in ``extras``, as do the fields that no alias names. Lines that are no JSON object give
    no row, whole-row duplicates one. No shuffle but for the duplicates.
    """
    known = files.select("file_id", "feed", "file_seq")
    parsed = records.select("file_id", "line_no", _fields(F.col("record")).alias("v")).where("v is not null")
    texts = parsed.select("file_id", "line_no", F.transform_values("v", lambda _, x: x.cast("string")).alias("m"))
    kept = texts.select(
        "file_id", "line_no", F.map_filter("m", lambda _, x: ~F.coalesce(utrim(x).isin(*BLANK_MARKERS), F.lit(True))).alias("m")
    )
    columns = [
        F.coalesce(*[F.try_element_at("m", F.lit(a)).try_cast(kind) for a in names]).alias(name) for name, (kind, names) in aliases.items()
    ]
    castable = {a: kind for kind, names in aliases.values() for a in names}
    extras = F.map_filter("m", lambda k, x: ~(k.isin(*castable) & (k.isin(*[a for a, t in castable.items() if t == "string"]) | x.try_cast("double").isNotNull())))
    table = kept.select("file_id", "line_no", *columns, F.to_json(extras).alias("extras"))
    return table.join(known, "file_id").distinct()
