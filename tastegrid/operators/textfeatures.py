"""Text features in long form: (document, term, weight) rows instead of matrices."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastegrid.functions.numeric import ranked
from tastegrid.functions.porter import stem_all

#: Turns an array of words into the words to count.
Analyzer = Callable[[Column], Column]


def identity(words: Column) -> Column:
    return words


def porter(words: Column) -> Column:
    return stem_all(words)


# First letters of part-of-speech tags and the word classes that a lexicon of lemmas is kept by.
WORD_CLASSES = {"J": "a", "V": "v", "N": "n", "R": "r"}


def word_class(tag: str | None) -> str:
    """The class of a part-of-speech tag; everything else is a noun."""
    return WORD_CLASSES.get((tag or "")[:1], "n")


def lexicon(lemmas: Mapping[tuple[str, str], str], tagger: Callable[[list[str]], list[str]] | None = None, adverbs: bool = True) -> Analyzer:
    """An analyzer that gives each word the lemma kept for it and its class; words without one stay.

    ``tagger`` gives the tags of a text's words in order, without it all are nouns; without ``adverbs``, words tagged
    R... are left out. Both are shipped with the function, so a lexicon should be of moderate size.
    """

    def lemma_all(texts: pd.Series) -> pd.Series:
        def of(tokens):
            tags = tagger(list(tokens)) if tagger else ["N"] * len(tokens)
            return [lemmas.get((w, word_class(t)), w) for w, t in zip(tokens, tags, strict=True) if adverbs or not t.startswith("R")]

        return texts.map(of, na_action="ignore")

    return F.pandas_udf(lemma_all, "array<string>")


def analyzer(kind: str | Mapping[tuple[str, str], str] | Callable[[Column], Column]) -> Analyzer:
    """``identity`` or ``porter`` by name, a lexicon of lemmas, or an analyzer itself; anything else is an error."""
    named = {"identity": identity, "porter": porter}
    if isinstance(kind, str) and kind in named:
        return named[kind]
    if isinstance(kind, Mapping):
        return lexicon(kind)
    if callable(kind):
        return kind
    raise TypeError(f"no analyzer: {kind!r}")


def words(text: Column) -> Column:
    """Words of a text: lower case, everything but a-z is blank; an empty array for an empty text, null for null."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def english_stop_words(spark: SparkSession) -> list[str]:
    """The stop words that Spark ML brings; another list can be passed wherever this one is the default."""
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def prepared(df: DataFrame, text: str, analyzer: Analyzer, stop: list[str], least_letters: int = 2) -> Column:
    """The terms of a text after the analyzer, without stop words and too short ones."""
    listed = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(analyzer(words(F.col(text))), lambda w: (F.length(w) >= least_letters) & ~F.array_contains(listed, w))


def tf_idf(df: DataFrame, doc: str, text: str, analyzer: Analyzer = identity, stop: list[str] | None = None) -> DataFrame:
    """doc, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), each document's weights of length 1.

    n is the number of documents, those without terms too. Documents without an id or text count as documents but
    have no rows; repeated rows of one document add up. Counts are combined before the shuffle by term.
    """
    stop = english_stop_words(df.sparkSession) if stop is None else stop
    n = df.agg(F.count_distinct(doc).alias("n")).first()["n"]
    terms = df.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.explode(prepared(df, text, analyzer, stop)).alias("term"))
    counts = terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    spread_ = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.join(spread_, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / length).alias("weight"))


def term_scores(weights: DataFrame, documents: int | None = None) -> DataFrame:
    """term, score: the sum of its weights, or their mean over a number of documents."""
    total = F.sum("weight")
    return weights.groupBy("term").agg((total / F.lit(documents) if documents else total).alias("score"))


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    return term_scores(weights).orderBy(F.desc("score"), "term").limit(k)


def density(weights: DataFrame, documents: int) -> DataFrame:
    """documents, terms, percent of the matrix's cells that are not zero."""
    return weights.agg(F.count("*").alias("cells"), F.count_distinct("term").alias("terms")).select(
        F.lit(documents).cast("bigint").alias("documents"), "terms", (F.col("cells") / (F.lit(documents) * F.col("terms")) * 100).alias("percent")
    )


def compared_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """rank, term_a, score_a, term_b, score_b, is_same: two rankings of (term, score) side by side.

    The longer one's tail stands beside nulls. Scores are compared to ten digits, ties by term, so that the order of
    sums doesn't decide.
    """
    by = lambda df, x: ranked(df.withColumn("_s", -F.round("score", 10)), "_s", "term").select("rank", F.col("term").alias(f"term_{x}"), F.col("score").alias(f"score_{x}"))
    both = by(a, "a").join(by(b, "b"), "rank", "full")
    return both.withColumn("is_same", F.coalesce((F.col("term_a") == F.col("term_b")).cast("int"), F.lit(0)))


def jaccard_curve(ranks: DataFrame, start: int = 10, stop: int = 4200, step: int = 100) -> DataFrame:
    """top_n, jaccard of the first n terms of both rankings for n from ``start`` below ``stop``; 0 for empty sets.

    Each term counts from the later of its two ranks on, so no sets are built: one row per term and cut-off is
    aggregated, and terms beyond the last cut-off are left out before.
    """
    cuts = ranks.sparkSession.range(start, stop, step).select(F.col("id").cast("int").alias("top_n"))
    a = ranks.where(F.col("term_a").isNotNull()).select(F.col("term_a").alias("term"), F.col("rank").alias("rank_a"))
    b = ranks.where(F.col("term_b").isNotNull()).select(F.col("term_b").alias("term"), F.col("rank").alias("rank_b"))
    met = a.join(b, "term", "full").where(F.least("rank_a", "rank_b") < stop)
    steps = F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step))
    each = met.select("rank_a", "rank_b", F.explode(F.filter(steps, lambda n: n >= F.least("rank_a", "rank_b"))).alias("top_n"))
    both = (F.col("rank_a") <= F.col("top_n")) & (F.col("rank_b") <= F.col("top_n"))
    counts = each.groupBy("top_n").agg(F.count("*").alias("any"), F.count_if(F.coalesce(both, F.lit(False))).alias("both"))
    return cuts.join(counts, "top_n", "left").select("top_n", F.coalesce(F.col("both") / F.col("any"), F.lit(0.0)).alias("jaccard"))


def expanding_mean(ranks: DataFrame, column: str = "is_same", first: int = 1000, least: int = 5) -> DataFrame:
    """rank, mean of ``column`` over all ranks so far, null before ``least`` of them; the first ranks only."""
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    head = ranks.where(F.col("rank") <= first)  # bounded, so that one task may see it
    return head.select("rank", F.when(F.count(column).over(so_far) >= least, F.avg(column).over(so_far)).alias("mean"))


def _dot(column: str, axis) -> Column:
    products = F.zip_with(column, F.lit([float(x) for x in axis]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, e: s + e)


def truncated_svd(vectors: DataFrame, column: str, k: int) -> DataFrame:
    """component, singular_value, explained: singular values of the uncentred rows, and each component's share of the
    rows' total variance. Rows with a null vector are left out; all vectors have one length."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    matrix = RowMatrix(rows.rdd.map(lambda r: Vectors.dense(r.v)))
    svd = matrix.computeSVD(k)
    each = rows.select(F.posexplode("v").alias("place", "e"))
    total = each.groupBy("place").agg(F.var_pop("e").alias("v")).agg(F.sum("v").alias("v")).first()["v"]
    projected = rows.select(F.array(*[_dot("v", axis) for axis in svd.V.toArray().T]).alias("p"))
    variances = projected.select(F.posexplode("p").alias("component", "e")).groupBy("component").agg(F.var_pop("e").alias("v"))
    values = vectors.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(svd.s)], "component int, singular_value double")
    return values.join(variances, "component").select("component", "singular_value", (F.col("v") / F.lit(total)).alias("explained"))


def projection(vectors: DataFrame, key: str, column: str, k: int = 2) -> DataFrame:
    """key and p ARRAY<DOUBLE>: coordinates of each row on the first ``k`` right singular vectors."""
    rows = vectors.where(F.col(column).isNotNull()).select(key, F.col(column).cast("array<double>").alias("v"))
    axes = RowMatrix(rows.rdd.map(lambda r: Vectors.dense(r.v))).computeSVD(k).V.toArray().T
    return rows.select(key, F.array(*[_dot("v", axis) for axis in axes]).alias("p"))

