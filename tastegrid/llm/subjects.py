"""Subject areas of documents: classifier chains over term, source and structure features.

Labels are known for whole documents, but a subject is dealt with by sentences. So the term features come from a
mixture that is fitted first: every sentence belongs to one of its document's subjects, in passing to another one,
or to none, and expectation-maximisation finds the terms by which. A document's features are then, for each
subject, how many of its sentences deal with it, how surely, and in which share (structure), and how the source
leans. A chain of logistic classifiers, each of which sees the labels before it, models which subjects occur
together; its probabilities are calibrated on held-out documents, and the label set is decoded by beam search.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.runtime import sliced, spread

#: Documents with labels on which the model is fitted, drawn by a hash of their id; all documents are classified.
TRAINING_DOCUMENTS = 5_000
#: Features that the sentence model keeps: those of the most training sentences.
MOST_FEATURES = 60_000
EM_ROUNDS = 12
#: Features whose shares are summed up at once, some tens of megabytes, however long texts are.
FEATURES_AT_ONCE = 100_000
#: Topics for sentences that deal with no subject: small talk, quoted matter and the like have different words.
OTHER_TOPICS = 5
#: Prior of a sentence in passing on a subject that its document is not labelled with, against 1 for a labelled one.
IN_PASSING = 0.02
BEAM = 8
#: Each subject is a link of the chain; more of them are refused.
MOST_SUBJECTS = 1_000
NONE = "none"

_TAG = re.compile(r"<[^<>]{0,300}>")
_LINK = re.compile(r"https?://\S+")
_END = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of a text, without markup and links; sentences of under three words are left out."""
    plain = _LINK.sub(" ", _TAG.sub("\n", html.unescape(text)))
    out = []
    for s in _END.split(plain):
        w = _WORD.findall(s.lower())
        if len(w) >= 3:
            out.append(w)
    return out


def sentence_features(words: list[str]) -> set[str]:
    """Words and pairs of neighbours."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class SubjectModel:
    """What classification needs; its size is bounded by MOST_FEATURES and the number of subjects."""

    subjects: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    log_share: np.ndarray | None = None  # features x (subjects + other topics)
    log_prior: np.ndarray | None = None
    source_lean: dict[str, np.ndarray] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)  # of each link of the chain
    calibration: list[tuple[float, float]] = field(default_factory=list)

    def sentence_posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of every sentence over the subjects and the other topics, and the document it is in."""
        ids, ends, owner, parts = [], [], [], []
        known = self.vocabulary
        for d, text in enumerate(texts):
            for w in sentences(text) if text else ():
                ids += [i for i in map(known.get, sentence_features(w)) if i is not None]
                ends.append(len(ids))
                owner.append(d)
                if len(ids) >= FEATURES_AT_ONCE:
                    parts.append(self._posteriors(ids, ends))
                    ids, ends = [], []
        parts.append(self._posteriors(ids, ends))
        return np.concatenate(parts), np.array(owner, dtype=np.int64)

    def _posteriors(self, ids: list[int], ends: list[int]) -> np.ndarray:
        """Posterior of sentences whose features end at ``ends`` of ``ids``."""
        k = len(self.subjects) + OTHER_TOPICS
        if not ends:
            return np.zeros((0, k))
        running = np.zeros((len(ids) + 1, k))
        np.cumsum(self.log_share[np.array(ids, dtype=np.int64)], axis=0, out=running[1:])
        ends = np.array(ends)
        total = running[ends] - running[np.concatenate([[0], ends[:-1]])] + self.log_prior
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True)

    def features(self, texts: list[str | None], sources: list[str | None]) -> np.ndarray:
        """documents x subjects x features."""
        n, k = len(texts), len(self.subjects)
        p, owner = self.sentence_posteriors(texts)
        sure = np.zeros((n, k))
        soft = np.zeros((n, k))
        np.add.at(sure, owner, p[:, :k] > 0.5)
        np.add.at(soft, owner, p[:, :k])
        length = np.bincount(owner, minlength=n).astype(float)[:, None] * np.ones((1, k))
        flat = np.zeros(k)
        lean = np.array([self.source_lean.get(s, flat) for s in sources]).reshape(n, k)
        steps = [(sure >= c).astype(float) for c in (1, 2, 3, 4, 5)] + [np.clip(soft - c, 0, 1) for c in (0.5, 1.5, 2, 2.5, 3.5)]
        share = soft / np.maximum(length, 1)
        return np.stack([np.ones((n, k)), *steps, share, np.log1p(length), lean], axis=2)

    def decode(self, features: np.ndarray) -> np.ndarray:
        """documents x subjects: the most probable label set of the chain by beam search."""
        n, k, _ = features.shape
        labels = np.zeros((n, 1, k))
        score = np.zeros((n, 1))
        for j in range(k):
            # A subject needs three sentences; with fewer than two likely ones it isn't considered.
            z = np.where(features[:, j, 2:3] > 0, self._link(features[:, j], labels, j), -50.0)
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            both = np.concatenate([labels, labels], axis=1)
            both[:, labels.shape[1] :, j] = 1
            total = np.concatenate([score + no, score + yes], axis=1)
            best = np.argsort(-total, axis=1, kind="stable")[:, :BEAM]
            labels = np.take_along_axis(both, best[:, :, None], axis=1)
            score = np.take_along_axis(total, best, axis=1)
        return labels[:, 0] > 0.5

    def _link(self, own: np.ndarray, labels: np.ndarray, j: int) -> np.ndarray:
        """Calibrated log-odds of subject j for each beam's labels so far."""
        w = self.weights[j]
        f = own.shape[1]
        z = (own @ w[:f])[:, None] + labels[:, :, :j] @ w[f : f + j] + labels[:, :, :j].sum(axis=2) * w[f + j]
        a, b = self.calibration[j]
        return a * z + b


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Newton steps of a logistic regression with a ridge."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: list[tuple[str | None, str | None, frozenset[str]]], subjects: list[str]) -> SubjectModel:
    """Fit the model on (text, source, subjects) of labelled documents."""
    model = SubjectModel(sorted(subjects))
    where = {s: j for j, s in enumerate(model.subjects)}
    y = np.array([[s in labels for s in model.subjects] for _, _, labels in rows], dtype=float).reshape(len(rows), len(where))
    _fit_sentences(model, [t for t, _, _ in rows], y)
    by_source: dict[str, list[int]] = {}
    for d, (_, source, _) in enumerate(rows):
        if source is not None:
            by_source.setdefault(source, []).append(d)
    mean = (y.sum(axis=0) + 1) / (len(rows) + 2)
    for source, at in by_source.items():
        model.source_lean[source] = np.log((y[at].sum(axis=0) + 10 * mean) / (len(at) + 10)) - np.log(mean)
    x = model.features([t for t, _, _ in rows], [s for _, s, _ in rows])
    held = np.arange(len(rows)) % 5 == 0
    for j in range(len(where)):
        links = np.concatenate([x[:, j], y[:, :j], y[:, :j].sum(axis=1, keepdims=True)], axis=1)
        w = _logistic(links[~held], y[~held, j], ridge=1.0)
        z = links[held] @ w
        b, a = _logistic(np.stack([np.ones(len(z)), z], axis=1), y[held, j], ridge=0.1) if 0 < y[held, j].sum() < held.sum() else (0.0, 1.0)
        model.weights.append(w)
        model.calibration.append((max(a, 0.1), b))
    return model


def _fit_sentences(model: SubjectModel, texts: list[str | None], y: np.ndarray) -> None:
    """The mixture of sentences by expectation-maximisation."""
    number: dict[str, int] = {}
    sets, owner = [], []
    for d, text in enumerate(texts):
        for w in sentences(text) if text else ():
            sets.append(np.array([number.setdefault(f, len(number)) for f in sorted(sentence_features(w))], dtype=np.int32))
            owner.append(d)
    counts = np.bincount(np.concatenate(sets), minlength=len(number)) if sets else np.zeros(0, dtype=np.int64)
    kept = sorted((f for f, i in number.items() if counts[i] >= 2), key=lambda f: (-counts[number[f]], f))[:MOST_FEATURES]
    model.vocabulary = {f: i for i, f in enumerate(kept)}
    k = len(model.subjects) + OTHER_TOPICS
    v = len(kept)
    if not sets or not v:
        model.log_share, model.log_prior = np.zeros((max(v, 1), k)), np.log(np.full(k, 1 / k))
        return
    renumbered = np.full(len(number), -1, dtype=np.int32)
    renumbered[[number[f] for f in kept]] = np.arange(v)
    del number
    ids = [i[i >= 0] for i in (renumbered[s] for s in sets)]
    sizes = np.array([len(i) for i in ids])
    flat = np.concatenate(ids)
    of = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    owner = np.array(owner)
    other = np.full((len(y), OTHER_TOPICS), 0.5)
    first = np.concatenate([np.where(y > 0, 1.0, 1e-30), other], axis=1)[owner]
    later = np.concatenate([np.where(y > 0, 1.0, IN_PASSING), other], axis=1)[owner]
    p = first * np.random.default_rng(0).uniform(0.2, 1.0, first.shape)
    p /= p.sum(axis=1, keepdims=True)
    prior = np.full(k, 1 / k)
    for turn in range(EM_ROUNDS):
        allowed = first if turn < EM_ROUNDS - 3 else later
        share = np.stack([np.bincount(flat, p[of, j], v) for j in range(k)], axis=1) + 0.02
        # A feature is there or not in a sentence; its share is that of a topic's sentences.
        model.log_share = np.log(share / (p.sum(axis=0) + 1.0))
        prior = (p.sum(axis=0) + 0.01) / (len(p) + 0.01 * k)
        log_p = np.stack([np.bincount(of, model.log_share[flat, j], len(p)) for j in range(k)], axis=1)
        log_p += np.log(np.maximum(allowed, 1e-30)) + np.log(prior)
        log_p -= log_p.max(axis=1, keepdims=True)
        p = np.exp(log_p)
        p /= p.sum(axis=1, keepdims=True)
    model.log_prior = np.log(prior)


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple[str | None, str | None, frozenset[str]]]:
    """The bounded sample of labelled documents on which the model is fitted."""
    named = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    drawn = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCUMENTS)
    texts = documents.select("doc_id", "text", "source").join(F.broadcast(drawn), "doc_id")  # at most TRAINING_DOCUMENTS ids
    rows = texts.dropDuplicates(["doc_id"]).select("doc_id", "text", "source", "subjects").collect()
    rows.sort(key=lambda r: str(r.doc_id))
    return [(r.text, r.source, frozenset(r.subjects) - {NONE}) for r in rows]


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject: the subjects of each document that has no row in ``labels``.

    ``documents``: doc_id, text, source; ``labels``: doc_id, subject (``none`` for none); ``subjects``: subject.
    The model is fitted on at most TRAINING_DOCUMENTS labelled documents; every document is classified by its whole
    text where it lies, and only the result meets the labels. Documents of no subject, null and empty texts and rows
    without an id give no row; without any labelled document nothing is found; equal rows count once; further
    columns are ignored.
    """
    names = [r.subject for r in subjects.where("subject is not null").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect()]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"there are more than {MOST_SUBJECTS} subjects")
    rows = training_rows(documents, labels)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(rows, names) if rows and names else None)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches, 1_000):
            if model is None or not batch.num_rows:
                continue
            x = model.features(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            at, which = np.nonzero(model.decode(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([model.subjects[j] for j in which], pa.string())], ["doc_id", "subject"]
            )

    texts = documents.where("doc_id is not null").select("doc_id", "text", "source")
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = spread(texts).mapInArrow(classify, f"doc_id {kind}, subject string")
    return found.join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
