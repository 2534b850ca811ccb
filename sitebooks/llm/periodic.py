"""Periodic runs: stretches of words that repeat a block at least four times, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q, of ``least_words`` words and
``least_powers`` periods or more, that no neighbouring word extends with that period.

Periods up to ``SHORT`` are found by direct lag scans: words that equal the word q places on.  Longer
ones are found at scales: the scale of ``low`` covers periods above ``low`` up to twice that.  It
hashes grams of 2 * low words and keeps the minima of windows of ``low`` grams.  Inside a run of
four periods two windows lie whole at the distance of the period, so both keep the same minimum; a
gram no shorter than the period cannot occur at a smaller distance, as the run would then have a
smaller period.  So neighbours among equal minima seed every run.  A seed is extended by comparing
words, which decides; the hashes only propose.  ``least_powers`` must be 4 or more for that.

Tasks work on many texts at once: the words of a group of texts are one numpy array of numbers, no
two texts share a number, so no run crosses a border.  A very long text is a group of its own.

Rules: words are runs without ASCII white space.  Null and empty texts have no words and no runs.
Repeated rows repeat in the result, a null id stays null, an empty table gives an empty result.  Of runs with
the same words the smallest period counts.  Other columns do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mixed, small_batches

LEAST_WORDS, LEAST_POWERS = 6, 4
#: Longest period of the direct lag scans; a power of two.
SHORT = 8
#: Words of a group of texts.
GROUP_WORDS = 1 << 17

SCHEMA = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_BASE = 0x9E3779B97F4A7C15

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _short_runs(x: np.ndarray, least_words: int, powers: int) -> Iterator[tuple[int, int, int]]:
    for q in range(1, SHORT + 1):
        same = np.flatnonzero(x[:-q] == x[q:])
        if not len(same):
            continue
        breaks = np.flatnonzero(np.diff(same) != 1)
        first = same[np.concatenate(([0], breaks + 1))]
        length = same[np.concatenate((breaks, [len(same) - 1]))] - first + 1 + q
        for k in np.flatnonzero(length >= max(least_words, powers * q)).tolist():
            yield int(first[k]), int(length[k]), q


def _window(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each window of ``size`` values, a power of two."""
    step = 1
    while step < size:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _seeds(x: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (low < distance <= 2 * low) of neighbours among equal window minima of grams."""
    size, n = 2 * low, len(x)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    inverse = np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(x.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    grams = mixed((sums[size:] - sums[:-size]) * inverse[: n - size + 1])
    if len(grams) < low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _window(grams, low, np.minimum)
    edge = np.zeros(low - 1, np.uint64)
    kept = np.flatnonzero(_window(np.concatenate((edge, least, edge)), low, np.maximum) == grams)
    order = kept[np.argsort(grams[kept], kind="stable")]
    distance = np.diff(order)
    wanted = (grams[order[1:]] == grams[order[:-1]]) & (distance > low) & (distance <= size)
    return order[:-1][wanted], distance[wanted]


def _reach(x: np.ndarray, place: int, q: int, step: int) -> int:
    """First place from ``place`` on, in the direction ``step``, whose word differs from the one q places on."""
    size, last = 64, len(x) - q if step > 0 else -1
    while place != last:
        if step > 0:
            end = min(place + size, last)
            differ = x[place:end] != x[place + q : end + q]
        else:
            end = max(place - size, last)
            differ = (x[end + 1 : place + 1] != x[end + 1 + q : place + 1 + q])[::-1]
        if differ.any():
            return place + step * int(np.argmax(differ))
        place, size = end, size * 2
    return last


def _long_runs(x: np.ndarray, low: int, least_words: int, powers: int) -> Iterator[tuple[int, int, int]]:
    places, distances = _seeds(x, low)
    order = np.lexsort((places, distances))
    covered, period = -1, 0
    for p, q in zip(places[order].tolist(), distances[order].tolist(), strict=True):
        if q == period and p < covered:
            continue  # the stretch of an earlier seed
        end, start = _reach(x, p, q, 1), _reach(x, p, q, -1) + 1
        covered, period = max(end, p + 1), q
        if end + q - start >= max(least_words, powers * q):
            yield start, end + q - start, q


def runs_of(texts: list[np.ndarray], least_words: int = LEAST_WORDS, powers: int = LEAST_POWERS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each array of word numbers; no two arrays share a number."""
    if powers < 4:
        raise ValueError("runs of fewer than four periods are not certain to be found")
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]

    def note(members: list[int], runs: Iterator[tuple[int, int, int]], ends: np.ndarray) -> None:
        for start, length, q in runs:
            k = int(np.searchsorted(ends, start, "right"))
            own = found[members[k]]
            key = (start - (int(ends[k - 1]) if k else 0), length)
            own[key] = min(own.get(key, q), q)

    members = [i for i, t in enumerate(texts) if len(t)]
    low = 0
    while members:
        x = np.concatenate([texts[i] for i in members])
        ends = np.cumsum([len(texts[i]) for i in members])
        note(members, _long_runs(x, low, least_words, powers) if low else _short_runs(x, least_words, powers), ends)
        low = low * 2 or SHORT
        members = [i for i in members if len(texts[i]) > powers * low]
    return [sorted((s, n, q) for (s, n), q in own.items()) for own in found]


def _without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(
    documents: DataFrame, least_words: int = LEAST_WORDS, powers: int = LEAST_POWERS, rewrite: Rewrite | None = None
) -> DataFrame:
    """doc_id, its runs (sorted by start, then period) and its words without repeats, joined by one space.

    A word goes if a run holds it behind the run's first period.  ``rewrite`` may change the words of
    a document, given its id, before they are searched.
    """
    small_batches(documents.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(ids: list, texts: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
            runs = runs_of(numbers, least_words, powers)
            spans = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(own, key=lambda r: (r[0], r[2]))] for own in runs]
            texts_left = [_without_repeats(w, own).decode() for w, own in zip(texts, runs, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(spans, _RUNS), pa.array(texts_left, pa.string())], ["doc_id", "runs", "collapsed"]
            )

        for batch in batches:
            ids, texts, numbers, held = [], [], [], 0
            number = count()
            rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            for doc_id, text in rows:
                words = (text.as_py() or "").encode().split()
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                if held and held + len(words) > GROUP_WORDS:
                    yield finished(ids, texts, numbers)
                    ids, texts, numbers, held = [], [], [], 0
                own = defaultdict(number.__next__)
                ids.append(doc_id)
                texts.append(words)
                numbers.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                held += len(words)
            if ids:
                yield finished(ids, texts, numbers)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(search, SCHEMA)


def most_repeated(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period."""

    def better(best: Column, run: Column) -> Column:
        mine, other = run["length"] * best["period"], best["length"] * run["period"]
        # the runs come sorted by start, then period, so a tie leaves the earlier one
        return F.when(mine > other, run).otherwise(best)

    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), better)


def run_report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the most repeated one, and digests of all runs and of the words left."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    placed = found.withColumn("most", most_repeated())
    return placed.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "most.start",
        "most.length",
        "most.period",
        F.expr("most.length * 1000 div most.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
