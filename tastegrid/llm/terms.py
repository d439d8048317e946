"""Terms of texts: how often each occurs in the collection, and how much each marks its own record.

A term is a longest run of at least three letters a-z in the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.runtime import checkpointed

#: A term in at most so many records is rare.
RARE_RECORDS = 2
#: A term in more than this share of the records that have any term is common.
COMMON_SHARE = 0.2
#: A term in more than this share of the records is broadcast with its counts. If a record has at most t different
#: terms on average, no more than t / HOT_SHARE terms can be so frequent; the others are joined.
HOT_SHARE = 0.001
#: So many counts of terms, some tens of megabytes, are broadcast as they are.
BROADCAST_TERMS = 500_000
#: Records drawn for the bounds of range partitions.
BOUND_RECORDS = 20_000
#: Letters of a term, of five bits each, in the number that is sorted by, and fields for which there is room before them.
CODE_LETTERS = 11
MOST_FIELDS = 128
#: Parsimonious model: weight of the record against the background, and rounds of expectation-maximisation.
RECORD_WEIGHT = 0.1
EM_ROUNDS = 30


def terms(text: Column) -> Column:
    """ARRAY<STRING> of the terms of a text in order; null for null."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: F.length(t) >= 3)


def term_frequencies(df: DataFrame, fields: list[str], id_column: str, partitions: int | None = None) -> DataFrame:
    """field_name, term, uses, records, all_records, mark: every distinct term of each field over all records.

    An external sort: pairs of term and record are range-partitioned and sorted, so that a term of any frequency is
    spread over as many partitions as its pairs need; runs of equal terms are then counted where they lie and the
    partial counts of a term met in several partitions are added up. all_records is the number of records with any
    term in the field. mark is ``rare`` (in at most RARE_RECORDS records), ``common`` (in more than COMMON_SHARE of
    all_records), else null; a term that would be both is rare.

    The bounds of the partitions come from the terms of BOUND_RECORDS records drawn at random; they decide where pairs
    are counted, not what is. What is sorted by is a number that holds the field and the first letters of the term.

    A record is an id. Repeated rows count once; where rows of one id differ, a term counts with its most uses in one
    of them. Rows without an id are no record and are left out; null, empty and term-free texts have no terms;
    further columns are ignored.
    """
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"there are more than {MOST_FIELDS} fields")
    context, session = df.sparkSession.sparkContext, df.sparkSession
    named = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("record"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)])
    kind = named.schema["record"].dataType.simpleString()
    words = lambda rows: rows.select("record", F.hash("record").alias("h"), *[terms(F.col(f"f{k}")).alias(f"f{k}") for k in range(len(fields))])
    parts = partitions or int(session.conf.get("spark.sql.shuffle.partitions"))
    drawn = named.sample(min(1.0, BOUND_RECORDS / max(1, named.count())), seed=0)
    weights = words(drawn).mapInArrow(_weights_of_rows, "code bigint, pairs bigint").groupBy("code").agg(F.sum("pairs").alias("pairs")).toArrow()
    bounds = context.broadcast(_bounds(weights["code"].to_numpy(), weights["pairs"].to_numpy(), parts))
    pairs = words(named).mapInArrow(_pairs_of_rows(bounds), f"part int, code bigint, record {kind}, tail string, uses int")
    ordered = pairs.repartitionById(parts, F.col("part")).select("code", "record", "tail", "uses").sortWithinPartitions("code", "record", "tail")
    runs = ordered.mapInArrow(_count_runs, "key string, uses bigint, records bigint")
    split = F.create_map(*[F.lit(x) for k, f in enumerate(fields) for x in (str(k), f)])
    counted = (
        runs.groupBy("key")
        .agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"))
        .select(F.substring_index("key", " ", 1).alias("number"), F.substring_index("key", " ", -1).alias("term"), "uses", "records")
        .select(F.try_element_at(split, "number").alias("field_name"), "term", "uses", "records")
    )
    any_term = [F.count_distinct(F.when(F.lower(f"f{k}").rlike("[a-z]{3}"), F.col("record"))).alias(f) for k, f in enumerate(fields)]
    whole = named.agg(*any_term).unpivot([], fields, "field_name", "all_records")
    mark = F.when(F.col("records") <= RARE_RECORDS, F.lit("rare")).when(
        F.col("records") > F.col("all_records") * COMMON_SHARE, F.lit("common")
    )
    return counted.join(F.broadcast(whole), "field_name").withColumn("mark", mark)  # one row a field


def _codes(field: int, dictionary: pa.Array) -> np.ndarray:
    """A number for each term: the field's, then five bits for each of the first CODE_LETTERS letters; it sorts as they do."""
    head = np.array(dictionary.to_pylist(), dtype=f"S{CODE_LETTERS}") if len(dictionary) else np.zeros(0, f"S{CODE_LETTERS}")
    letters = head.view(np.uint8).reshape(len(head), CODE_LETTERS).astype(np.int64)
    letters = np.where(letters > 0, letters - 96, 0)
    return (field << 5 * CODE_LETTERS) + (letters << 5 * np.arange(CODE_LETTERS - 1, -1, -1)).sum(axis=1)


def _decoded(code: int, tail: str) -> str:
    """The field's number and the term."""
    letters = [(code >> 5 * k) & 31 for k in range(CODE_LETTERS - 1, -1, -1)]
    return f"{code >> 5 * CODE_LETTERS} " + "".join(chr(96 + x) for x in letters if x) + tail


def _weights_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs of term and record each batch has by the number of the term."""
    for batch in batches:
        for k in range(2, batch.num_columns):
            dictionary, _, term, _ = _row_terms(batch.column(k))
            yield pa.RecordBatch.from_arrays([pa.array(_codes(k - 2, dictionary)), pa.array(np.bincount(term, minlength=len(dictionary)).astype(np.int64))], ["code", "pairs"])


def _bounds(codes: np.ndarray, pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in order, the first of the partitions that pairs from each on go to, and how many these are.

    A number of more pairs than a partition's share has several, by record; those that were not drawn go with the one before.
    """
    order = np.argsort(codes)
    codes, pairs = codes[order], pairs[order].astype(np.float64)
    share = max(pairs.sum() / parts, 1.0)
    several = np.maximum(1, np.round(pairs / share)).astype(np.int64)
    first = np.minimum((np.cumsum(pairs) - pairs) // share, parts - 1).astype(np.int64)
    return codes, first, np.minimum(several, parts - first)


def _row_terms(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of a batch, and owner, term and uses of each term of each row."""
    flat = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets)
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    n = max(len(flat.dictionary), 1)
    pair, uses = np.unique(owner * n + flat.indices.to_numpy(), return_counts=True)
    return flat.dictionary, pair // n, pair % n, uses


def _pairs_of_rows(bounds):
    """Rows of a record, a hash of it, and its terms in each field to pairs of term and record, and the partition of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, several = bounds.value
        for batch in batches:
            spread_ = batch.column(1).to_numpy().astype(np.int64)
            for k in range(2, batch.num_columns):
                dictionary, owner, term, uses = _row_terms(batch.column(k))
                codes = _codes(k - 2, dictionary)
                place = np.maximum(np.searchsorted(known, codes, "right") - 1, 0)
                at, n = (first[place], several[place]) if len(known) else (np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64))
                part = at[term] + spread_[owner] % n[term]
                tail = pc.utf8_slice_codeunits(dictionary.cast(pa.string()), CODE_LETTERS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(codes[term]), batch.column(0).take(pa.array(owner)), tail.take(pa.array(term)), pa.array(uses.astype(np.int32))],
                    ["part", "code", "record", "tail", "uses"],
                )

    return run


def _as_before(column: pa.Array) -> np.ndarray:
    """Whether each value equals the one before it; the first doesn't."""
    return np.concatenate([[False], pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)])


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs to counts of uses and records of each run of a term; equal pairs are one with their most uses.

    Terms whose first letters are equal take turns by record; each turn is a run of its own.
    """
    open_: tuple | None = None  # the last pair, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        code, record, tail = batch.column(0), batch.column(1), batch.column(2)
        uses = batch.column(3).to_numpy().astype(np.int64)
        same_key = _as_before(code) & _as_before(tail)
        same_pair = _as_before(record) & same_key
        firsts = np.flatnonzero(~same_pair)
        most = np.maximum.reduceat(uses, firsts)
        starts = np.flatnonzero(~same_key[firsts])
        used = np.add.reduceat(most, starts)
        records = np.diff(np.append(starts, len(firsts)))
        first = code[0].as_py(), tail[0].as_py(), record[0].as_py()
        if open_ is not None and open_[:3] == first:  # one record across two batches
            records[0] -= 1
            used[0] += max(most[0], open_[3]) - open_[3] - most[0]
            most[0] = max(most[0], open_[3])
        open_ = code[-1].as_py(), tail[-1].as_py(), record[-1].as_py(), int(most[-1])
        at = pa.array(firsts[starts])
        keys = [_decoded(c, t) for c, t in zip(code.take(at).to_pylist(), tail.take(at).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(used), pa.array(records.astype(np.int64))], ["key", "uses", "records"])


def record_models(df: DataFrame, text_column: str, id_column: str, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """record, terms ARRAY of term, uses, records, score, probability: how much each term marks its record among all.

    ``probability`` is the converged share of the term in the record's parsimonious language model: in each round of
    expectation-maximisation, the uses of a term are split between the record's own model and the background (the
    term's share of all uses in the collection), and the own model is estimated anew from its part, so that mass
    moves away from what the background explains. ``score`` is uses * (ln((1+n)/(1+records)) + 1) with the number n
    of records that have any term.

    The text is shuffled once, by record. The counts of the terms are materialised, so that their number is known: up
    to BROADCAST_TERMS of them are broadcast to where the records lie. Beyond that, those of the frequent terms
    (HOT_SHARE) are broadcast, whose number is bounded, and the others are joined by term, which keeps frequent terms
    out of that shuffle. Either way gives the same rows.

    A record is an id; equal rows count once, different texts of one id are one record. Rows without an id are left
    out; null, empty and term-free texts give no rows; further columns are ignored.
    """
    texts = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("record"), F.col(text_column).alias("text"))
    whole = texts.groupBy("record").agg(F.collect_set("text").alias("texts"))
    words = whole.select("record", F.flatten(F.transform("texts", terms)).alias("words"))
    partial = words.mapInArrow(_partial_counts, "term string, all_uses bigint, records bigint")
    counts = checkpointed(partial.groupBy("term").agg(F.sum("all_uses").alias("all_uses"), F.sum("records").alias("records")))
    sizes = counts.agg(F.count("*").alias("terms"), F.sum("all_uses").alias("total"), F.max(F.when(F.col("term") == "", F.col("records"))).alias("n")).first()
    n, total = sizes["n"] or 0, sizes["total"] or 1
    kind = texts.schema["record"].dataType.simpleString()
    schema = f"record {kind}, term array<string>, uses array<bigint>, records array<bigint>, probability array<double>"
    if sizes["terms"] <= broadcast_terms:
        rows = counts.where("term <> ''").toArrow()
        modelled = words.mapInArrow(_known_terms(df.sparkSession.sparkContext.broadcast(rows), total), schema)
    else:
        modelled = _joined_entries(words, counts.where("term <> ''"), n).mapInArrow(_parsimonious(total), schema)

    def scored(e: Column) -> Column:
        score = e["uses"] * (F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + e["records"])) + F.lit(1.0))
        return F.struct(e["term"].alias("term"), e["uses"].alias("uses"), e["records"].alias("records"), score.alias("score"), e["probability"].alias("probability"))

    return modelled.select("record", F.transform(F.arrays_zip("term", "uses", "records", "probability"), scored).alias("terms"))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with their words to uses and records of each term of a batch; the empty term counts the records."""
    for batch in batches:
        dictionary, owner, term, uses = _row_terms(batch.column(1))
        n = len(dictionary)
        names = pa.concat_arrays([dictionary.cast(pa.string()), pa.array([""])])
        used = np.append(np.bincount(term, uses, n).astype(np.int64), 0)
        records = np.append(np.bincount(term, minlength=n), len(np.unique(owner)))
        yield pa.RecordBatch.from_arrays([names, pa.array(used), pa.array(records)], ["term", "all_uses", "records"])


def _joined_entries(words: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """record, entries: each record's terms with their uses and counts, by joins with the counts of all terms."""
    pairs = words.select("record", F.explode("words").alias("term")).groupBy("record", "term").agg(F.count("*").alias("uses"))
    hot, cold = counts.where(F.col("records") > n * HOT_SHARE), counts.where(F.col("records") <= n * HOT_SHARE)
    entry = F.collect_list(F.struct("term", "uses", "records", "all_uses"))
    frequent = pairs.join(F.broadcast(hot), "term").groupBy("record").agg(entry.alias("frequent"))
    seldom = pairs.join(F.broadcast(hot.select("term")), "term", "left_anti").join(cold, "term").groupBy("record").agg(entry.alias("seldom"))
    empty = F.array().cast("array<struct<term:string,uses:bigint,records:bigint,all_uses:bigint>>")
    return frequent.join(seldom, "record", "full").select(
        "record", F.concat(F.coalesce("frequent", empty), F.coalesce("seldom", empty)).alias("entries")
    )


def _converged(owner: np.ndarray, n: int, uses: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Each entry's share in the own model of its record after expectation-maximisation."""
    own = uses / np.maximum(np.bincount(owner, uses, n), 1.0)[owner]
    for _ in range(EM_ROUNDS):
        inner = RECORD_WEIGHT * own
        part = uses * inner / (inner + (1.0 - RECORD_WEIGHT) * background)
        own = part / np.maximum(np.bincount(owner, part, n), 1e-300)[owner]
    return own


_ENTRY = ["record", "term", "uses", "records", "probability"]


def _known_terms(shared, total: int):
    """Batches of records with their words to batches with each term's converged probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.combine_chunks()
        column = lambda name: table[name].chunk(0) if table[name].num_chunks else table[name].combine_chunks()
        names, all_uses, all_records = column("term").cast(pa.string()), column("all_uses").to_numpy(), column("records").to_numpy()
        for batch in batches:
            dictionary, owner, term, uses = _row_terms(batch.column(1))
            place = pc.index_in(dictionary.cast(pa.string()), names).to_numpy(zero_copy_only=False).astype(np.int64)[term] if len(term) else term
            background = all_uses[place].astype(np.float64) / total
            own = _converged(owner, batch.num_rows, uses.astype(np.float64), background)
            bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            as_list = lambda values: pa.ListArray.from_arrays(bounds, values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), as_list(dictionary.cast(pa.string()).take(pa.array(term))), as_list(pa.array(uses.astype(np.int64))),
                 as_list(pa.array(all_records[place])), as_list(pa.array(own))], _ENTRY
            )

    return run


def _parsimonious(total: int):
    """Batches of records with their entries to batches with each term's converged probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
            background = np.asarray(flat.field("all_uses"), dtype=np.float64) / total
            own = _converged(owner, len(lists), np.asarray(flat.field("uses"), dtype=np.float64), background)
            bounds = pa.array(offsets, pa.int32())
            as_list = lambda values: pa.ListArray.from_arrays(bounds, values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), as_list(flat.field("term").cast(pa.string())), as_list(flat.field("uses")),
                 as_list(flat.field("records")), as_list(pa.array(own))], _ENTRY
            )

    return run


def distinctive_terms(df: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """record, term, uses, records, score, probability: the rows of :func:`record_models`."""
    return record_models(df, text_column, id_column).select("record", F.inline("terms"))


def best_terms(models: DataFrame, by: str, k: int = 3, least_records: int = 2) -> DataFrame:
    """record, term: the ``k`` best terms of each record by ``score`` or ``probability``, ties by term ascending.

    Only terms found in at least ``least_records`` records; a record with fewer gives fewer rows. No shuffle.
    """
    able = F.filter("terms", lambda e: e["records"] >= least_records)
    keys = F.array_sort(F.transform(able, lambda e: F.struct((-e[by]).alias("minus"), e["term"].alias("term"))))
    return models.select("record", F.explode(F.slice(keys, 1, k)["term"]).alias("term"))
