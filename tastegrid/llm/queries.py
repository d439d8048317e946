"""Queries of the problems tagged llm over the tables of a folder, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import canonical, contamination, resolution, subjects, terms, tokenization
from tastegrid.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = terms.record_models(table(spark, sf_dir, "raw_reviews"), "blind_assessment", "review_id")
    return terms.best_terms(scored, "score").withColumnRenamed("record", "review_id")


def p2_parsimonious(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = terms.record_models(table(spark, sf_dir, "raw_reviews"), "blind_assessment", "review_id")
    return terms.best_terms(scored, "probability").withColumnRenamed("record", "review_id")


def p3_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve(table(spark, sf_dir, "roaster_names"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.linked_pairs(p3_companies(spark, sf_dir))


def p5_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf_dir, "raw_reviews"), ["blind_assessment", "notes"], "review_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_frequencies(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_references(
        table(spark, sf_dir, "processed_reviews"),
        table(spark, sf_dir, "canonical_values"),
        ["coffee_origin_country", "price_currency"],
        "review_id",
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _p6(spark, sf_dir).select(F.col("record").alias("review_id"), "field_name", "ref_id")
    return found.distinct()


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unmatched_values(_p6(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leak_report(p8_found(spark, sf_dir))


def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.reparameterised_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects")
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_parsimonious": p2_parsimonious,
    "p3_found": p3_found,
    "p3_companies": p3_companies,
    "p5_found": p5_found,
    "p5_frequencies": p5_frequencies,
    "p6_found": p6_found,
    "p6_unmatched": p6_unmatched,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_reparameterised": p8_reparameterised,
    "p9_found": p9_found,
}

_TERMS = """
texts AS (
    SELECT DISTINCT 'blind_assessment' AS field_name, review_id, blind_assessment AS text FROM raw_reviews
    UNION ALL SELECT DISTINCT 'notes', review_id, notes FROM raw_reviews
),
uses AS (
    SELECT field_name, review_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM texts
),
alls AS (SELECT field_name, count(DISTINCT review_id) AS all_records FROM uses GROUP BY 1),
counted AS (
    SELECT field_name, term, count(*) AS uses, count(DISTINCT review_id) AS records FROM uses GROUP BY 1, 2
)"""

_MARK = "CASE WHEN records <= 2 THEN 'rare' WHEN records > all_records * 0.2 THEN 'common' END"

ORACLE_SQL = {
    "p2_found": f"""WITH {_TERMS},
own AS (SELECT review_id, term, count(*) AS c FROM uses WHERE field_name = 'blind_assessment' GROUP BY 1, 2),
ranked AS (
    SELECT review_id, term, row_number() OVER (
        PARTITION BY review_id ORDER BY c * (ln((1.0 + all_records) / (1.0 + records)) + 1.0) DESC, term) AS place
    FROM own JOIN counted USING (term) JOIN alls USING (field_name)
    WHERE field_name = 'blind_assessment' AND records >= 2
)
SELECT review_id, term FROM ranked WHERE place <= 3""",
    "p5_found": f"""WITH {_TERMS}, marked AS (SELECT field_name, term, {_MARK} AS mark FROM counted JOIN alls USING (field_name))
SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL""",
    "p5_frequencies": f"""WITH {_TERMS}
SELECT field_name, term, uses, records, all_records, {_MARK} AS mark FROM counted JOIN alls USING (field_name)""",
}
