import pytest
from pyspark.sql import functions as F

from tastegrid.llm import queries, subjects
from tastegrid.sources.tables import table


def scores(rows, model):
    x = model.features([r[0] for r in rows], [r[1] for r in rows])
    got = [{model.subjects[j] for j, on in enumerate(p) if on} for p in model.decode(x)]
    hit = sum(len(g & r[2]) for g, r in zip(got, rows, strict=True))
    return hit / max(1, sum(map(len, got))), hit / max(1, sum(len(r[2]) for r in rows))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = subjects.training_rows(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))
    names = [r.subject for r in table(spark, folder, "subjects").collect()]
    held = [r for k, r in enumerate(rows) if k % 4 == 0]
    precision, recall = scores(held, subjects.train([r for k, r in enumerate(rows) if k % 4], names))
    assert precision > 0.95 and recall > 0.95


def test_defined_results(spark, data):
    docs = table(spark, data, "documents").withColumns({"subject": F.lit("clash"), "subjects": F.lit(1)})
    labels, names = table(spark, data, "doc_labels"), table(spark, data, "subjects")
    known = {r.doc_id for r in labels.collect()}
    got = subjects.document_subjects(docs, labels, names).collect()
    assert len(got) == len(set(got)) and not {r.doc_id for r in got} & known
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "s"), (-3, "word " * 100_000, None), (None, "text here now.", "s")], "doc_id bigint, text string, source string")
    more = subjects.document_subjects(docs.select("doc_id", "text", "source").union(odd).union(docs.select("doc_id", "text", "source")), labels, names).collect()
    assert {tuple(r) for r in more if r.doc_id is not None and r.doc_id > 0} == {tuple(r) for r in got}
    assert not {r.doc_id for r in more} & {-1, -2, -3, None}
    assert subjects.document_subjects(docs, labels.limit(0), names).count() == 0
    assert subjects.document_subjects(docs.limit(0), labels, names).count() == 0
    assert subjects.document_subjects(docs, labels, names.limit(0)).count() == 0
    assert queries.p9_found(spark, data).columns == ["doc_id", "subject"]


def test_one_label_and_sentences(spark):
    rows = spark.createDataFrame([(1, "The drum is hot. The drum is loud. The drum runs on.", "s"), (2, "The drum is hot.", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, "roasting"), (1, "roasting")], "doc_id bigint, subject string")
    assert subjects.document_subjects(rows, labels, spark.createDataFrame([("roasting",)], "subject string")).count() <= 1
    assert subjects.sentences("<p>One two three.</p>Four five six! https://a.b/c No.\n\nSeven eight nine") == [["one", "two", "three"], ["four", "five", "six"], ["seven", "eight", "nine"]]


def test_too_many_subjects_are_refused(spark, data, monkeypatch):
    monkeypatch.setattr(subjects, "MOST_SUBJECTS", 2)
    with pytest.raises(ValueError, match="more than 2 subjects"):
        subjects.document_subjects(table(spark, data, "documents"), table(spark, data, "doc_labels"), table(spark, data, "subjects"))
