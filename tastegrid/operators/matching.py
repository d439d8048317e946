"""Crosswalk of company names: exact keys, fuzzy scores of the keys, components, canonical names, a review queue."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tastegrid.functions.numeric import ranked
from tastegrid.functions.runtime import checkpointed, sliced
from tastegrid.functions.strings import lookup, strip_accents
from tastegrid.operators.graph import components
from tastegrid.operators.lettering import SLICE, Lettered, near, pair_scores

AUTO, REVIEW = 92.0, 82.0
#: Keys of a chunk whose pairs one task looks at: a tenth of all within these.
LEAST_KEYS, MOST_KEYS = 1024, 8192

# Words that say little about which company it is, and abbreviations written out before.
STOP_WORDS = (
    "coffee", "coffees", "coffe", "cofee", "roaster", "roasters", "roasting", "roastery", "roasterie", "cafe", "caffe", "kaffee",
    "espresso", "bean", "beans", "co", "company", "inc", "incorporated", "llc", "ltd", "limited", "corp", "the", "and",
)
ABBREVIATIONS = {"bros": "brothers", "bro": "brothers", "mfg": "manufacturing", "intl": "international", "st": "saint", "mt": "mount"}


def name_tokens(name: Column) -> Column:
    """ARRAY of a name's words: no accents, case, apostrophes or punctuation; runs of single letters are one word."""
    text = F.replace(F.lower(strip_accents(name)), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, "['’]", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]", " "), r"\s+", " "))
    words = F.transform(F.split(text, " "), lambda w: lookup(ABBREVIATIONS, w, keep=True))
    # Single letters are put in brackets; brackets that meet fall away, and with them what parts a run.
    marked = F.regexp_replace(F.array_join(words, " "), r"\b([a-z])\b", "<$1>")
    return F.filter(F.split(F.translate(F.replace(marked, F.lit("> <"), F.lit("")), "<>", ""), " "), lambda w: w != "")


def fingerprint(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def core_key(tokens: Column) -> Column:
    """The fingerprint without stop words; with them where nothing else is left."""
    kept = F.array_except(tokens, F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.when(F.size(kept) == 0, fingerprint(tokens)).otherwise(fingerprint(kept))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one big integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & masks.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - bin(open_).count("1")


def _share(insertions: int, length: int) -> float:
    return 100.0 if length == 0 else 100.0 * (1 - insertions / length)


def _indel(a: str, b: str) -> int:
    return len(a) + len(b) - 2 * _common_subsequence(a, b)


def sorted_ratio(a: str, b: str) -> float:
    """Similarity of the sorted words by letters put in and left out, 0 to 100."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return _share(_indel(x, y), len(x) + len(y))


def set_ratio(a: str, b: str) -> float:
    """Similarity of word sets by what they share and what is left of each; 100 where one holds the other."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = left & right
    x, y = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not x or not y):
        return 100.0
    s = len(" ".join(sorted(both)))
    gap = 1 if s else 0
    whole = _share(_indel(x, y), 2 * (s + gap) + len(x) + len(y))
    if not s:
        return whole
    return max(whole, _share(gap + len(x), 2 * s + gap + len(x)), _share(gap + len(y), 2 * s + gap + len(y)))


def key_score(a: str, b: str) -> float:
    return max(set_ratio(a, b), sorted_ratio(a, b))


def exact_clusters(names: DataFrame, column: str) -> DataFrame:
    """raw_name, n_records, core_key of each distinct name that is not null."""
    counts = names.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("raw_name")).agg(F.count("*").alias("n_records"))
    return counts.withColumn("tokens", name_tokens(F.col("raw_name"))).withColumn("core_key", core_key(F.col("tokens"))).drop("tokens")


def _chunks(sizes: dict[int, int], least: float) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """Chunks of keys by size: (first chunk, number of chunks) of each size, and the pairs of chunks whose sizes can meet.

    A chunk holds a run of sizes, or a part of one size, so none is much larger than the others.
    """
    most = min(MOST_KEYS, max(LEAST_KEYS, sum(sizes.values()) // 10))
    chunks, held, of = [], most, {}
    for size, n in sorted(sizes.items()):
        parts = -(-n // most)
        if parts == 1 and held + n <= most:
            chunks[-1] = (chunks[-1][0], size)
            held += n
            of[size] = (len(chunks) - 1, 1)
        else:
            of[size] = (len(chunks), parts)
            chunks += [(size, size)] * parts
            held = n if parts == 1 else most
    ratio = (200.0 - least) / least
    return of, [(p, q) for p in range(len(chunks)) for q in range(p, len(chunks)) if chunks[q][0] <= chunks[p][1] * ratio + 1e-9]


def _near_pairs(keys: DataFrame, least: float) -> DataFrame:
    """core_a, core_b, score of the pairs whose letters alone score at least ``least``; every chunk meets every other that it can."""
    sizes = {r["size"]: r["n"] for r in keys.groupBy(F.length("core_key").alias("size")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    of, pairs = _chunks(sizes, least)
    meets: dict[int, list[tuple[int, bool]]] = {}
    for k, (p, q) in enumerate(pairs):
        meets.setdefault(p, []).append((k, False))
        if p != q:
            meets.setdefault(q, []).append((k, True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            rows = []
            for key in batch.column(0).to_pylist():
                first, parts = of[len(key)]
                rows += [(pair, second, key) for pair, second in meets[first + zlib.crc32(key.encode()) % parts]]
            if rows:
                pair, second, key = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(second, pa.bool_()), pa.array(key, pa.string())], ["pair", "second", "core_key"])

    def score(group: pa.Table) -> pa.Table:
        known: dict[str, int] = {}
        second = group.column("second").to_pylist()
        texts = group.column("core_key").to_pylist()
        sides = [Lettered(sorted((k for k, s in zip(texts, second, strict=True) if s == side), key=lambda k: (len(k), k)), known) for side in (False, True)]
        a, b = sides[0], sides[1] if sides[1].keys else sides[0]
        out: list[tuple[list[str], list[str], list[float]]] = []
        # One side alone is a chunk with itself; chunks that are not met have nothing on one side.
        p, q = pairs[group.column("pair")[0].as_py()]
        for i, j in near(a, b, least, p == q) if a.keys and (p == q or sides[1].keys) else ():
            scores = pair_scores(a, b, i, j, key_score, contained=False)
            kept = scores >= least
            out.append(([a.keys[k] for k in i[kept]], [b.keys[k] for k in j[kept]], scores[kept].tolist()))
        left, right, scores = ([x for part in out for x in part[k]] for k in range(3))
        ordered = [(x, y) if x < y else (y, x) for x, y in zip(left, right, strict=True)]
        return pa.table({"core_a": pa.array([x for x, _ in ordered], pa.string()), "core_b": pa.array([y for _, y in ordered], pa.string()), "score": pa.array(scores, pa.float64())})

    dealt = keys.select("core_key").mapInArrow(deal, "pair int, second boolean, core_key string")
    # Few bytes, but much to compare: as many parts as there are pairs of chunks for the cores, whatever their size.
    spark = keys.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(pairs), 8 * spark.sparkContext.defaultParallelism))
    return dealt.repartition(parts, "pair").groupBy("pair").applyInArrow(score, "core_a string, core_b string, score double")


def _held_pairs(keys: DataFrame, least: float) -> DataFrame:
    """core_a, core_b, score of the pairs whose common words cover so much of one that it scores at least ``least``."""
    part = least / (200.0 - least)
    size, words = F.length("core_key"), F.array_distinct(F.split("core_key", " "))
    # How many words of a key may be missing in the other at most: its shortest ones, as long as the rest covers enough.
    lengths = F.array_sort(F.transform("words", lambda w: F.length(w) + 1))
    missing = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda k: F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda x, y: x + y)), lambda x: x <= (size + 1) - (size * part) + 1e-9))
    bits = F.aggregate("words", F.lit(0).cast("bigint"), lambda x, w: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(w), F.lit(64)))))
    sized = keys.select("core_key", size.alias("size"), words.alias("words")).withColumns({"missing": missing, "bits": bits})
    spread_ = sized.select("core_key", "size", "missing", "bits", F.explode("words").alias("word"))
    counted = spread_.join(spread_.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "word")
    onwards = Window.partitionBy("core_key").orderBy(F.desc("n"), F.desc("word")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of one key's words
    covered = F.sum(F.length("word") + 1).over(onwards) - 1
    rarest = counted.withColumn("covered", covered).where(F.col("covered") >= F.col("size") * part - 1e-9)
    a = rarest.select("word", F.col("core_key").alias("core_a"), F.col("missing").alias("missing_a"), F.col("bits").alias("bits_a"))
    b = counted.select("word", F.col("core_key").alias("core_b"), F.col("bits").alias("bits_b"))
    met = a.join(b, "word").where("core_a <> core_b and bit_count(bits_a & ~bits_b) <= missing_a")
    candidates = met.select(F.least("core_a", "core_b").alias("core_a"), F.greatest("core_a", "core_b").alias("core_b")).distinct()
    return scored_pairs(candidates).where(F.col("score") >= least)


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` of core_a and core_b with their score."""
    names = pairs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced([whole], SLICE):
                known: dict[str, int] = {}
                sides = []
                for side in ("core_a", "core_b"):
                    place = batch.column(names.index(side)).dictionary_encode()
                    sides.append((Lettered(place.dictionary.to_pylist(), known), place.indices.to_numpy().astype("int64")))
                (a, i), (b, j) = sides
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair_scores(a, b, i, j, key_score))], [*names, "score"])

    return pairs.mapInArrow(score, T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())]))


def key_pairs(keys: DataFrame, least: float = REVIEW) -> DataFrame:
    """core_a, core_b, score of every two distinct keys that score at least ``least``; core_a < core_b.

    No pair is missed. Two keys score by the words that they share, which then cover a share of one of them: so at least
    one of its rarest words, without which the rest covers less, is in the other. Or they score by letters: all pairs of
    keys whose lengths allow it are held against each other in arrays, by how often each has which letter, whatever
    the order; what this leaves is few, and its common subsequences are worked out.
    """
    found = _near_pairs(keys, least).union(_held_pairs(keys, least))
    return found.groupBy("core_a", "core_b").agg(F.max("score").alias("score"))


def _clusters(keyed: DataFrame) -> DataFrame:
    """Adds cluster_size, cluster_id and canonical_name to raw_name, n_records and root."""
    # The most frequent, then the longest, then the first name is the least of these.
    best = F.min(F.struct((-F.col("n_records")).alias("n"), (-F.length("raw_name")).alias("len"), F.col("raw_name").alias("canonical_name")))
    own = keyed.groupBy("root").agg(F.min("raw_name").alias("least_name"), F.count("*").alias("cluster_size"), best.alias("best"))
    numbered = ranked(own, "least_name", name="place")
    return keyed.join(numbered.select("root", "cluster_size", "best.canonical_name", (F.col("place") - 1).cast("int").alias("cluster_id")), "root")


def exact_crosswalk(names: DataFrame, column: str) -> DataFrame:
    """raw_name, n_records, core_key, cluster_size, canonical_name, cluster_id by equal keys alone."""
    return _clusters(exact_clusters(names, column).withColumn("root", F.col("core_key"))).drop("root")


def crosswalk(names: DataFrame, column: str, auto: float = AUTO, review: float = REVIEW) -> tuple[DataFrame, DataFrame]:
    """(crosswalk, review queue) of a column of names.

    Crosswalk: raw_name, n_records, cluster_id, canonical_name, cluster_size, min_internal_score, chain_risk. Names with
    equal keys, and keys that score at least ``auto``, are one cluster; clusters are numbered by their least name, the
    canonical name is the most frequent, then the longest, then the first. chain_risk marks clusters whose weakest
    pair is below ``auto``. Review queue: name_a, name_b, core_a, core_b, score, merge for keys that score between
    ``review`` and ``auto``. Null names are left out; empty input gives empty results.
    """
    exact, firsts, scored = _scored_keys(names, column, review)
    keyed, worst = _rooted(exact, scored, auto)
    score = _internal_score()
    table = _clusters(keyed).join(worst, "root", "left").select(
        "raw_name", "n_records", "cluster_id", "canonical_name", "cluster_size",
        F.bround(score, 1).alias("min_internal_score"), (score < auto).alias("chain_risk"),
    )
    return table, _queue(firsts, scored, auto)


def cluster_diagnostics(names: DataFrame, column: str, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """``diagnostics`` of ``crosswalk``, without the numbers and canonical names of clusters, which it does not need."""
    exact, _, scored = _scored_keys(names, column, review)
    keyed, worst = _rooted(exact, scored, auto)
    sizes = keyed.groupBy("root").agg(F.count("*").alias("cluster_size")).join(worst, "root", "left")
    return sizes.agg(F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("names"), F.count("*").alias("companies"), F.count_if(_internal_score() < auto).alias("at_risk"))


def review_queue(names: DataFrame, column: str, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """The review queue of ``crosswalk`` without the clusters, which it does not need."""
    _, firsts, scored = _scored_keys(names, column, review)
    return _queue(firsts, scored, auto)


def _scored_keys(names: DataFrame, column: str, review: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    exact = checkpointed(exact_clusters(names, column))
    firsts = exact.groupBy("core_key").agg(F.min("raw_name").alias("first_name"))
    return exact, firsts, checkpointed(key_pairs(firsts.select("core_key"), review))


def _rooted(exact: DataFrame, scored: DataFrame, auto: float) -> tuple[DataFrame, DataFrame]:
    """``exact`` with the root of each name's cluster; root, worst: the least score of any two keys of a cluster."""
    roots = components(scored.where(F.col("score") >= auto).select(F.col("core_a").alias("a"), F.col("core_b").alias("b")))
    keyed = exact.join(roots.withColumnRenamed("node", "core_key"), "core_key", "left").withColumn("root", F.coalesce("root", "core_key"))
    inner = roots.alias("x").join(roots.alias("y"), "root").where("x.node < y.node")
    inner = inner.select("root", F.col("x.node").alias("core_a"), F.col("y.node").alias("core_b"))
    return keyed, scored_pairs(inner).groupBy("root").agg(F.min("score").alias("worst"))


def _internal_score() -> Column:
    return F.when(F.col("cluster_size") > 2, F.coalesce("worst", F.lit(100.0))).otherwise(F.lit(100.0))


def _queue(firsts: DataFrame, scored: DataFrame, auto: float) -> DataFrame:
    open_ = scored.where(F.col("score") < auto)
    open_ = open_.join(firsts.select(F.col("core_key").alias("core_a"), F.col("first_name").alias("name_a")), "core_a")
    open_ = open_.join(firsts.select(F.col("core_key").alias("core_b"), F.col("first_name").alias("name_b")), "core_b")
    return open_.select("name_a", "name_b", "core_a", "core_b", F.bround("score", 1).alias("score"), F.lit("").alias("merge"))


def new_names(names: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """raw_name: distinct names that a crosswalk does not have yet."""
    seen = names.where(F.col(column).isNotNull()).select(F.col(column).alias("raw_name")).distinct()
    return seen.join(known.select("raw_name"), "raw_name", "left_anti")


def diagnostics(table: DataFrame) -> DataFrame:
    """names, companies, at_risk: numbers of a crosswalk, in one aggregate."""
    return table.agg(
        F.count_distinct("raw_name").alias("names"), F.count_distinct("cluster_id").alias("companies"), F.count_distinct(F.when(F.col("chain_risk"), F.col("cluster_id"))).alias("at_risk")
    )


def ordered_crosswalk(table: DataFrame) -> DataFrame:
    """Largest clusters first, then by number, then by records, then by name."""
    return table.orderBy(F.desc("cluster_size"), "cluster_id", F.desc("n_records"), "raw_name")


