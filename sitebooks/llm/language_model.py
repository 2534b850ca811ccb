"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token's class from the two tokens before it.  Frequent training words and the
end of a text are classes by themselves; all other words are dealt to groups, each of them a class
with vectors of its own, and a word has its smoothed share of its group.  Both numbers grow with the
cube root of the distinct training words, so the tables of all contexts grow slower than the counts.
Listed words are grouped by their count, all rarer ones and unknown words by their hash, which needs
no look-up.  With word vectors r, position matrices C1 and C2, output vectors q and biases b, the
score of class w is (r1 C1 + r2 C2) q_w + b_w.

* Counting covers every training text: distinct word hashes per task, summed by a shuffle.
* Training runs where the texts are.  In each round every task starts from the same parameters,
  learns from every position of all its training texts against noise drawn from the class counts,
  and sends its parameters; the averages, weighted by positions, start the next round.
* Scoring needs no sampling: since the score is a sum of one term per context word, the
  normalisers of all contexts are one matrix product, and a token's log-probability is the product of
  its vectors less the normaliser of its context.  All probabilities of a context add up to one.
  The normalisers are a table of classes by classes, which every worker gets.

Word counts are looked up in the ``LISTED`` most frequent words at each task (a bounded broadcast);
all other words of a text are joined to the counts by their hash.

Rules: words are runs without ASCII white space, A-Z lowered, known by a 64-bit hash, and each text
ends with one end token.  A null text is empty and has the end token alone.  An unknown id is in
the training part.  Without training texts the base score is 0 and all classes are equally likely.
Repeated rows repeat in the result and count as often in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import in_fold
from .shared import small_batches, span_hashes, staged, text_steps, word_spans

#: Classes of single words at least; words and groups more for each unit of the cube root of all types.
WORDS, GROWTH, LISTED, SIZE = 1021, 4, 1 << 19, 32
ROUNDS, BATCH, NOISE, RATE = 2, 4096, 48, 0.02
#: Parts that the parameters of all tasks are summed in before they meet.
PARTS = 16
#: Rows of a block of normalisers, and tokens that are scored together.
NORM_ROWS, SCORE_ROWS = 256, 1 << 15


@dataclass
class Vocabulary:
    """Counts of the listed words, sorted by hash, with their classes, and the totals."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    words: int  # classes that are words; then come end, groups of listed words, groups by hash and, as context only, begin
    by_count: int
    by_hash: int
    tokens: int
    types: int
    ends: int
    class_counts: np.ndarray
    class_types: np.ndarray

    @property
    def end(self) -> int:
        return self.words

    @property
    def begin(self) -> int:
        return self.words + 1 + self.by_count + self.by_hash

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Is each word listed, its count, its class."""
        rest = self.words + 1 + self.by_count + hashes.view(np.int64) % self.by_hash
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), rest
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        listed = self.hashes[at] == hashes
        return listed, np.where(listed, self.counts[at], 0), np.where(listed, self.classes[at], rest)

    def log_shares(self) -> np.ndarray:
        """log10 of the denominator of a word's share of its class, 0 where the class is one word.

        Each listed word has its count plus one; a group by hash keeps one more for unknown words.
        """
        sums = (self.class_counts + self.class_types).astype(np.float64)
        sums[: self.words + 1] = 1
        sums[self.words + 1 + self.by_count :] += 1
        return np.log10(np.maximum(sums, 1))

    def log_base(self) -> float:
        return float(np.log10(self.tokens + self.types + 1))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): every distinct word hash of the texts with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            words, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
            return pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for _, _, data, offsets in text_steps(batch, "text"):
                starts, ends, _ = word_spans(data, offsets)
                held.append(np.unique(span_hashes(data, starts, ends), return_counts=True))
                size += len(held[-1][0])
            if size > 3_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    counted = texts.select("text").mapInArrow(count, "word bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int, words: int = WORDS, listed: int = LISTED) -> Vocabulary:
    """The bounded part of the counts that every task gets, and the classes of all words."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    more = int(np.ceil(GROWTH * np.cbrt(totals[1])))
    # words per sixteenth of a doubling of their count: a bounded table that gives the bound for listing
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    bins = counts.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    room, least = listed, None
    for row in bins:
        room -= row["held"]
        if room < 0:
            break
        least = row["least"]
    table = counts.where(F.col("n") >= least) if least is not None else counts.where("false")
    found = table.select("word", "n").toArrow()  # at most ``listed`` rows
    hashes = found.column("word").to_numpy().view(np.uint64)
    n = found.column("n").to_numpy()
    rank = np.lexsort((hashes, -n))
    words = min(words + more, len(n))
    # the other listed words by falling count, about the same number of tokens to each group
    behind = rank[words:]
    mass = np.cumsum(n[behind])
    by_count, by_hash = (more if len(behind) else 0), max(more, 1)
    classes = np.zeros(len(n), np.int64)
    classes[rank[:words]] = np.arange(words)
    if len(behind):
        classes[behind] = words + 1 + (mass - n[behind]) * by_count // int(mass[-1])
    out = words + 1 + by_count + by_hash
    class_counts = np.bincount(classes, weights=n, minlength=out).astype(np.int64)
    class_types = np.bincount(classes, minlength=out)
    class_counts[words] = ends
    # the rarer words by their hash
    rare = counts.where(F.col("n") < least) if least is not None else counts
    for row in rare.groupBy(F.pmod("word", F.lit(by_hash)).cast("int").alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        class_counts[words + 1 + by_count + row["g"]] = row["n"]
        class_types[words + 1 + by_count + row["g"]] = row["types"]
    order = np.argsort(hashes)
    tokens, types = int(totals[0]) + ends, int(totals[1]) + (ends > 0)
    return Vocabulary(hashes[order], n[order], classes[order], words, by_count, by_hash, tokens, types, ends, class_counts, class_types)


# -- the model ----------------------------------------------------------------


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the row of ``out`` it belongs to; equal places are summed first."""
    order = np.argsort(at.astype(np.uint16) if len(out) <= 1 << 16 else at, kind="stable")  # 16 bits are sorted by radix
    places = at[order]
    begins = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    out[places[begins]] += np.add.reduceat(rows[order], begins, axis=0)


class LogBilinear:
    """Parameters, noise-contrastive steps, and the normalised tables."""

    def __init__(self, class_counts: np.ndarray, size: int = SIZE, seed: int = 11):
        random = np.random.default_rng(seed)
        out = len(class_counts)
        self.noise = (class_counts + 1.0) / (class_counts + 1.0).sum()
        self.p = {
            "context": random.normal(0, 0.1, (out + 1, size)),
            "first": np.eye(size) * 0.5,
            "second": np.eye(size) * 0.25,
            "output": random.normal(0, 0.1, (out, size)),
            "bias": np.log(self.noise),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, value in self.p.items():
            self.p[name] = flat[at : at + value.size].reshape(value.shape).copy()
            at += value.size

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, seed: int, sums: dict[str, np.ndarray]) -> None:
        """One pass over samples (word before, word before that, class), in batches; ``sums`` keeps the step sizes."""
        random, p = np.random.default_rng(seed), {name: v.astype(np.float32) for name, v in self.p.items()}
        cumulated, level = np.cumsum(self.noise), np.log(NOISE * self.noise).astype(np.float32)
        for begin in range(0, len(target), BATCH):
            a, b, w = (x[begin : begin + BATCH] for x in (one, two, target))
            noise = np.minimum(np.searchsorted(cumulated, random.random(NOISE)), len(self.noise) - 1)
            ra, rb, qw, qn = p["context"][a], p["context"][b], p["output"][w], p["output"][noise]
            predicted = ra @ p["first"] + rb @ p["second"]
            own = np.einsum("ij,ij->i", predicted, qw) + (p["bias"] - level)[w]
            others = predicted @ qn.T + (p["bias"] - level)[noise]
            up = 1 / (1 + np.exp(np.clip(own, -30, 30)))  # pull the data up
            np.clip(others, -30, 30, out=others)
            np.exp(np.negative(others, out=others), out=others)
            others += 1
            down = np.divide(-1, others, out=others)  # push the noise down
            grad = {name: np.zeros_like(v) for name, v in p.items()}
            _add_rows(grad["output"], w, up[:, None] * predicted)
            np.add.at(grad["output"], noise, down.T @ predicted)
            grad["bias"] += np.bincount(w, weights=up, minlength=len(level)).astype(np.float32)
            np.add.at(grad["bias"], noise, down.sum(axis=0))
            back = up[:, None] * qw + down @ qn
            grad["first"], grad["second"] = ra.T @ back, rb.T @ back
            _add_rows(grad["context"], a, back @ p["first"].T)
            _add_rows(grad["context"], b, back @ p["second"].T)
            for name, g in grad.items():
                g /= len(w)
                sums[name] = sums.get(name, 0) + g * g
                p[name] += np.float32(RATE) * g / np.sqrt(sums[name] + np.float32(1e-8))
        self.p = {name: v.astype(np.float64) for name, v in p.items()}

    def tables(self) -> "Tables":
        """What scoring needs: the vectors of the two words before, and the normaliser of each such pair.

        The normalisers are one matrix product, made by blocks of rows: besides their own table one more of
        that size is held, whatever the block.
        """
        p = self.p
        one, two = p["context"] @ p["first"], p["context"] @ p["second"]
        late = two @ p["output"].T
        top2 = late.max(axis=1)
        late -= top2[:, None]
        np.exp(late, out=late)
        norm = np.empty((len(one), len(two)), np.float32)
        for begin in range(0, len(one), NORM_ROWS):
            rows = slice(begin, begin + NORM_ROWS)
            early = one[rows] @ p["output"].T + p["bias"]
            top1 = early.max(axis=1)
            early -= top1[:, None]
            np.exp(early, out=early)
            norm[rows] = (np.log(early @ late.T) + top1[:, None] + top2) / np.log(10)
        return Tables(*(x.astype(np.float32) for x in (one, two, p["output"], p["bias"])), norm)


class Tables(NamedTuple):
    """Vectors of the word before and the word before that, output vectors and biases; normalisers (log10)."""

    one: np.ndarray
    two: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    norm: np.ndarray

    def log_chance(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probability of each class after the two classes before it."""
        out = np.empty(len(target))
        for begin in range(0, len(target), SCORE_ROWS):
            a, b, w = (x[begin : begin + SCORE_ROWS] for x in (one, two, target))
            terms = np.einsum("ij,ij->i", self.one[a] + self.two[b], self.output[w]) + self.bias[w]
            out[begin : begin + SCORE_ROWS] = terms / np.log(10) - self.norm[a, b]
        return out


def _sequences(data: np.ndarray, offsets: np.ndarray, v: Vocabulary):
    """Classes with the two classes before each token, ends included, and per word its hash and look-up."""
    starts, ends, bounds = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    listed, counts, classes = v.look_up(hashes)
    texts = len(bounds) - 1
    word_at = np.arange(len(hashes)) + np.repeat(np.arange(texts), np.diff(bounds))
    begins = bounds[:-1] + np.arange(texts)
    target = np.full(len(hashes) + texts, v.end)
    target[word_at] = classes
    one = np.concatenate([[v.begin], target[:-1]])
    one[begins] = v.begin
    two = np.concatenate([[v.begin], one[:-1]])
    two[begins] = v.begin
    return target, one, two, begins, bounds, word_at, hashes, listed, counts


def trained(texts: DataFrame, v: Vocabulary) -> LogBilinear:
    model = LogBilinear(v.class_counts)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(v)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.flat())

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, start=start) -> Iterator[pa.RecordBatch]:
            v, own, sums, seen = shared.value, LogBilinear(shared.value.class_counts), {}, 0
            own.load(start.value)
            for batch in batches:
                for _, _, data, offsets in text_steps(batch, "text"):
                    target, one, two, *_ = _sequences(data, offsets, v)
                    pick = np.random.default_rng(seen + turn).permutation(len(target))
                    own.train(one[pick], two[pick], target[pick], seen, sums)
                    seen += len(target)
            if seen:
                part = TaskContext.get().partitionId() % PARTS
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "weight": pa.array([float(seen)]), "sums": pa.array([(own.flat() * seen).tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, total = 0.0, None
            for batch in batches:
                for w, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    values = np.frombuffer(raw)
                    weight, total = weight + w, values.copy() if total is None else total + values
            if total is not None:
                yield pa.RecordBatch.from_pydict({"weight": pa.array([weight]), "sums": pa.array([total.tobytes()], pa.binary())})

        sent = texts.select("text").mapInArrow(learn, "part int, weight double, sums binary")
        rows = sent.repartition(PARTS, "part").mapInArrow(add, "weight double, sums binary").collect()  # PARTS rows at most
        if rows:
            model.load(sum(np.frombuffer(r["sums"]) for r in rows) / sum(r["weight"] for r in rows))
    return model


def scores(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    train = rows.where("not held_out")
    counts = staged(word_counts(train))
    v = vocabulary(counts, train.count())
    shared = spark.sparkContext.broadcast((v, trained(train, v).tables()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tables = shared.value
        key = TaskContext.get().partitionId() << 33
        log_base, log_shares = v.log_base(), v.log_shares()
        for batch in batches:
            parts: dict[str, list] = {name: [] for name in ("n_tokens", "n_known", "base", "score", "tail")}
            for _, _, data, offsets in text_steps(batch, "text"):
                target, one, two, begins, bounds, word_at, hashes, listed, count = _sequences(data, offsets, v)
                model = tables.log_chance(one, two, target)
                base = np.full(len(target), np.log10(v.ends + 1) - log_base)
                known = np.full(len(target), v.ends > 0)
                log_count = np.log10(count + 1.0)  # 0 where the count is joined later
                base[word_at] = log_count - log_base
                known[word_at] = listed
                model[word_at] += np.where(target[word_at] > v.end, log_count - log_shares[target[word_at]], 0)
                parts["n_tokens"].append(np.diff(np.append(begins, len(target))))
                for name, values in (("n_known", known.astype(np.int64)), ("base", base), ("score", model)):
                    parts[name].append(np.add.reduceat(values, begins))
                tail = np.concatenate([[0], np.cumsum(~listed)])[bounds]
                parts["tail"].append(pa.LargeListArray.from_arrays(pa.array(tail), pa.array(hashes[~listed].view(np.int64))))
            joined = {name: np.concatenate(x) if x and name != "tail" else x for name, x in parts.items()}
            n = len(batch)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(np.arange(key, key + n)),
                    "doc_id": batch.column(0),
                    "held_out": batch.column(1),
                    **{name: pa.array(joined[name]) for name in ("n_tokens", "n_known", "base", "score")},
                    "tail": pa.concat_arrays(joined["tail"]).cast(pa.list_(pa.int64())),
                }
            )
            key += n

    schema = "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, tail array<bigint>"
    scored = staged(rows.mapInArrow(score, schema))
    # what is left of each text: words that are not listed, with their counts from the whole table
    rest = scored.select("key", F.explode("tail").alias("word")).join(counts, "word").groupBy("key").agg(
        F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more")
    )
    out = scored.drop("tail").join(rest, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
