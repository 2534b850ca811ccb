"""Quality classifier by co-training.

Two classifiers see two different views of a document.  The text view is its content: hashed byte
trigrams.  The metadata view knows no words: language, source, declared length and the figures of
the layout (lines, letters, capitals, digits, marks, how often words repeat).  Both start from
labelled documents.  In each round each classifier labels the documents of an unlabelled pool that
it is surest of, as many good and bad ones as the labels suggest, and the *other* one learns from
them.  In the end both are calibrated on labelled documents that neither learned from, and a
document's score is the mean of the calibrated log-odds, as a probability of good quality.

Fitting uses at most ``LABELLED`` labelled and ``POOL`` unlabelled documents, those with the
smallest hash of their id: bounded samples and parameters of the operator.  Scoring reads every
text of every document as a whole.

Rules: labels of a document that disagree, and null labels, are not used.  Without labels of both
kinds nothing can be learned and every document keeps score 1.  Null and empty texts are scored as
texts without trigrams; a null language or source is a value of its own.  Repeated rows repeat.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, small_batches, span_hashes, text_steps, word_spans

LABELLED, POOL = 4000, 4000
ROUNDS, SURE = 4, 0.05
TEXT_SIZE, NAME_SIZE = 2048, 64

_CLASS = np.zeros(256, np.int64)  # 0 marks and others, 1 space, 2 small, 3 capital, 4 digit, 5 beyond ASCII
_CLASS[[32, 9, 10, 11, 12, 13]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 5


def _text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of hashed trigram counts, of length one."""
    wide = data.astype(np.uint32)
    n = max(len(wide) - 2, 0)
    place = ((wide[:n] * 40503 + wide[1 : n + 1] * 9973 + wide[2 : n + 2] * 101) * np.uint32(2654435761)) >> np.uint32(21)
    out = np.zeros((len(offsets) - 1, TEXT_SIZE), np.float32)
    for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if end - begin > 2:
            out[i] = np.sqrt(np.bincount(place[begin : end - 2], minlength=TEXT_SIZE))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def _layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of the kinds of characters, lengths of words and lines, how many words are distinct."""
    texts = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    kinds = np.bincount(owner * 6 + _CLASS[data], minlength=6 * texts).reshape(texts, 6) / size[:, None]
    lines = np.bincount(owner[data == 10], minlength=texts) + 1
    starts, ends, bounds = word_spans(data, offsets)
    words = np.diff(bounds)
    hashes = span_hashes(data, starts, ends)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    repeats = np.bincount(np.repeat(np.arange(texts), words)[again], minlength=texts)
    many = np.maximum(words, 1)
    figures = [kinds, np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 8, np.log1p(words) / 8, distinct / many, repeats / many]
    return np.column_stack(figures)


def _name_view(values: list, salt: str) -> np.ndarray:
    out = np.zeros((len(values), NAME_SIZE), np.float32)
    places = [zlib.crc32(f"{salt}{v!r}".encode()) % NAME_SIZE for v in values]
    out[np.arange(len(values)), places] = 0.3
    return out


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text view and metadata view of the rows (text, lang, source, n_chars)."""
    text, layout = [np.zeros((0, TEXT_SIZE), np.float32)], [np.zeros((0, 12))]
    for _, _, data, offsets in text_steps(batch, "text"):
        text.append(_text_view(data, offsets))
        layout.append(_layout(data, offsets))
    length = np.array([[v is None, np.log1p(max(v or 0, 0)) / 10] for v in batch.column("n_chars").to_pylist()], float).reshape(-1, 2)
    names = [_name_view(batch.column(c).to_pylist(), c) for c in ("lang", "source")]
    return np.concatenate(text), np.column_stack([np.concatenate(layout), length, *names]).astype(np.float32)


def fitted(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, steps: int = 150, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression with classes of equal weight."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_odds(x, w), -30, 30)))
        off = (weight * (p - y)).astype(np.float32)
        g = np.append(off @ x, off.sum()) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class CoTrained:
    """Weights and calibrations (slope, constant) of the two views."""

    weights: list[np.ndarray]
    calibration: list[np.ndarray]

    def score(self, seen: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Combined probability, and those of the two views."""
        odds = [np.clip(_odds(x, w) * c[0] + c[1], -30, 30) for x, w, c in zip(seen, self.weights, self.calibration, strict=True)]
        chance = lambda o: 1 / (1 + np.exp(-o))
        return chance((odds[0] + odds[1]) / 2), [chance(o) for o in odds]


def co_train(known: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """Train on the views of labelled documents and a pool of unlabelled ones."""
    hold = np.arange(len(y)) % 4 == 3
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
    base = [x[~hold] for x in known]
    truth = y[~hold]
    taught: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0))] * 2
    weights: list[np.ndarray | None] = [None, None]
    for turn in range(rounds + 1):
        for view in (0, 1):
            rows, labels = taught[view]
            weights[view] = fitted(np.concatenate([base[view], pool[view][rows]]), np.concatenate([truth, labels]), weights[view])
        if turn == rounds or not len(pool[0]):
            break
        for view in (0, 1):
            odds = _odds(pool[view], weights[view])
            free = np.setdiff1d(np.arange(len(odds)), taught[1 - view][0])
            order = free[np.argsort(odds[free], kind="stable")]
            good = min(int(np.ceil(sure * len(odds) * truth.mean())), len(order) // 2)
            bad = min(int(np.ceil(sure * len(odds) * (1 - truth.mean()))), len(order) // 2)
            pick = np.concatenate([order[:bad][odds[order[:bad]] < 0], order[len(order) - good :][odds[order[len(order) - good :]] > 0]])
            rows, labels = taught[1 - view]
            taught[1 - view] = np.concatenate([rows, pick]), np.concatenate([labels, (odds[pick] > 0).astype(float)])
    test = hold if hold.any() else ~hold
    calibration = []
    for x, w in zip(known, weights, strict=True):
        odds = _odds(x[test], w)
        scale = max(float(np.abs(odds).mean()), 1e-9)
        slope, constant = fitted((odds / scale)[:, None].astype(np.float32), y[test], np.array([1, 0], np.float32), decay=1e-3)
        calibration.append(np.array([max(slope, 0) / scale, constant]))
    return CoTrained(weights, calibration)


_INPUTS = ("text", "lang", "source", "n_chars")


def _sampled_views(rows: DataFrame) -> DataFrame:
    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = views(batch)
            yield pa.RecordBatch.from_pydict(
                {
                    "place": batch.column("place"),
                    "doc_id": batch.column("doc_id"),
                    "quality": batch.column("quality"),
                    "text": pa.array([x.astype(np.float16).tobytes() for x in text], pa.binary()),
                    "meta": pa.array([x.tobytes() for x in meta], pa.binary()),
                }
            )

    return rows.mapInArrow(see, "place bigint, doc_id bigint, quality int, text binary, meta binary")


def trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """A model from a bounded sample of ``docs`` with and without ``labels`` (doc_id, quality 0 or 1)."""
    agreed = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    agreed = agreed.where("lo = hi").select("doc_id", F.col("lo").cast("int").alias("quality"))
    first = F.xxhash64("doc_id")
    named = agreed.orderBy(first, "doc_id").limit(labelled)
    rest = docs.where("doc_id is not null").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
    rest = rest.distinct().orderBy(first, "doc_id").limit(pool).withColumn("quality", F.lit(None).cast("int"))
    sample = named.union(rest)  # at most labelled + pool ids
    rows = docs.select("doc_id", *_INPUTS).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", *_INPUTS)
    model = _trained_in_task(_sampled_views(rows.withColumn("place", F.monotonically_increasing_id()))).first()
    return None if model is None else pickle.loads(model["model"])


def _trained_in_task(found: DataFrame) -> DataFrame:
    """One row with the model, or none.  The sample is bounded and meets in one task, so the driver never holds it."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sample = pa.Table.from_batches(held).sort_by("place")
        del held
        places = {d: i for i, d in enumerate(sample.column("doc_id").to_pylist())}  # of rows with one id the last
        order = np.array([places[d] for d in sorted(places, key=lambda d: zlib.crc32(str(d).encode()))])
        quality = sample.column("quality").take(pa.array(order))
        is_told = quality.is_valid().to_numpy()
        y = quality.drop_null().to_numpy().astype(float)
        if len(set(y)) < 2:
            return
        known, unknown = [], []
        for name, kind in (("text", np.float16), ("meta", np.float32)):
            # all values of a view are of one size
            whole = sample.column(name).cast(pa.large_binary()).combine_chunks()
            whole = np.frombuffer(whole.buffers()[2], kind).reshape(len(whole), -1)
            known.append(whole[order[is_told]].astype(np.float32))
            unknown.append(whole[order[~is_told]].astype(np.float32))
        del sample, whole
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(co_train(known, y, unknown))], pa.binary())})

    return found.repartition(1).mapInArrow(train, "model binary")


def scored(docs: DataFrame, model: CoTrained | None) -> tuple[DataFrame, list[str]]:
    """All rows and columns of ``docs`` with the scores behind them; the names of score, text and metadata score."""
    small_batches(docs.sparkSession)
    names = [fresh(docs, n) for n in ("score", "text_score", "meta_score")]
    if model is None:
        return docs.withColumns({n: F.lit(1.0) for n in names}), names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in _INPUTS]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, (text, meta) = shared.value.score(views(pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=_INPUTS)))
            more = [pa.array(x.astype(np.float64)) for x in (both, text, meta)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return docs.mapInArrow(score, schema), names


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score, keep (score of at least ``least``)."""
    rows, (score, text, meta) = scored(docs.select("doc_id", *_INPUTS), trained(docs, labels))
    return rows.select("doc_id", F.col(text).alias("text_score"), F.col(meta).alias("meta_score"), F.col(score).alias("score"), (F.col(score) >= least).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, all columns as they were."""
    rows, (score, *_) = scored(docs, trained(docs, labels))
    return rows.where(F.col(score) >= least).select(*docs.columns)
