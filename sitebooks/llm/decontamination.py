"""Benchmark decontamination: documents that hold a whole window of a benchmark item.

A prefix-filtered set join, all of it DataFrame functions.  A window (``width`` consecutive item
words, or a shorter item as a whole) can only occur in a document that holds all its shingles, so
one necessary shingle is enough to find it: its rarest one in the corpus.

1. count every benchmark shingle over all documents (grouped per task before the shuffle);
2. give each window its rarest shingle; a window with a shingle that occurs nowhere is done;
3. meet documents and windows by that shingle, keep places where the window fits by position and
   length, and compare the words of the item-sized stretch exactly.

A window that is shorter than a shingle is found by its rarest word instead.  The benchmark side is
broadcast only if its measured size is under ``BROADCAST_BYTES``; otherwise it is a shuffle join
whose hot keys Spark splits.

Rules: A-Z lowered, words are runs of 0-9, a-z and anything beyond ASCII.  A null or empty text has
no words; so has an item, which then has no window.  A null document id stays null, rows that
repeat give repeated result rows, items that repeat an id are one item, items without an id count
under the text "null".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, checkpointed

#: Item words in a window, and words in a shingle.
WIDTH, SHINGLE = 10, 3
#: Measured size under which the windows are sent to every executor.
BROADCAST_BYTES = 64 << 20

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; a leading or trailing break leaves an empty first or last piece."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD_ANY_CASE)).cast("bigint")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, window): every distinct window of an item as an array of words."""
    item = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.array_remove(words(F.col("text")), "").alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return item.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("window")).distinct()


def shingles_at(array: Column, place: Column, k: int) -> Column:
    """Hash of the k words from ``place`` (from 0) on; null where fewer are left."""
    whole = F.get(array, place + (k - 1)).isNotNull()
    return F.when(whole, F.xxhash64(*[F.get(array, place + i) for i in range(k)]))


def _window_tokens(windows: DataFrame, k: int) -> DataFrame:
    places = F.sequence(F.lit(0), F.size("window") - k)
    return windows.select("window", F.explode(F.transform(places, lambda p: F.struct(p.alias("off"), shingles_at(F.col("window"), p, k).alias("token")))).alias("t")).select("window", "t.off", "t.token")


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the rows, measured now, are small enough; else the frame as it is.

    ``df`` should be staged or cheap: measuring it is a job.
    """
    row_bytes = F.length(F.to_json(F.struct(*df.columns))) + 64
    size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def _occurrences(docs: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(id, digest, start, window): exact occurrences of windows that are found by k-word shingles."""
    tokens = _window_tokens(windows, k)
    listed = tokens.select("token").distinct()
    placed = docs.select("id", "digest", words(F.col("text")).alias("words")).select("id", "digest", "words", F.posexplode("words").alias("pos", "word"))
    placed = placed.withColumn("token", shingles_at(F.col("words"), F.col("pos"), k))
    counts = placed.select("token").join(sized_broadcast(listed), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # rarest shingle of each window; windows with a shingle that no document has cannot occur
    ranked = tokens.join(counts, "token", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"), F.col("off"))).alias("rarest")
    )
    prefix = ranked.where("rarest.n > 0").select("window", "rarest.token", "rarest.off")
    prefix = checkpointed(prefix)
    start = F.col("pos") - F.col("off")
    length = F.size("window")
    met = placed.join(sized_broadcast(prefix), "token")
    met = met.where((start >= 0) & (start + length <= F.size("words")))
    met = met.where(F.slice("words", start + 1, length) == F.col("window"))
    return met.select("id", "digest", start.alias("start"), "window")


def contamination(
    documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window; ``n_items`` counts items with occurring
    windows, ``items_sha256`` digests their sorted, comma-joined ids.
    """
    return _contamination(documents, benchmark, width, shingle).drop("digest")


def _contamination(documents: DataFrame, benchmark: DataFrame, width: int, shingle: int) -> DataFrame:
    """The rows of ``contamination`` with the digest of each text."""
    docs = documents.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    windows = checkpointed(item_windows(benchmark, width))
    distinct = windows.select("window").distinct()
    long, short = distinct.where(F.size("window") >= shingle), distinct.where(F.size("window") < shingle)
    found = _occurrences(docs, long, shingle)
    if shingle > 1 and not short.isEmpty():
        found = found.unionByName(_occurrences(docs, short, 1))
    found = checkpointed(found.distinct())
    key = ["id", "digest"]
    items = found.select(*key, "window").distinct().join(windows, "window").select(*key, "item").distinct()
    items = items.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")
    )
    # covered words: what each stretch adds to the furthest end before it, within one document
    spans = found.select(*key, "start", (F.col("start") + F.size("window")).alias("end"))
    spans = spans.groupBy(*key, "start").agg(F.max("end").alias("end"))
    spans = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
    )
    hits = _joined_hits(items, spans.select(*key, merged["n"].alias("n_hit")))
    rows = docs.select("id", "digest", word_count(F.col("text")).alias("n_words"))
    out = rows.join(hits, rows["id"].eqNullSafe(hits["h_id"]) & (rows["digest"] == hits["h_digest"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        F.col("id").alias("doc_id"),
        "digest",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _joined_hits(items: DataFrame, covered: DataFrame) -> DataFrame:
    covered = covered.toDF("h_id", "h_digest", "n_hit")
    on = items["id"].eqNullSafe(covered["h_id"]) & (items["digest"] == covered["h_digest"])
    return covered.join(items, on).select("h_id", "h_digest", "n_hit", "n_items", "items")


def clean_documents(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """The documents without a benchmark window, all columns kept."""
    hit = _contamination(documents.select("doc_id", "text"), benchmark, width, shingle).where("contaminated")
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct()
    # rows of one id can have several texts
    digest = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    same = documents["doc_id"].eqNullSafe(hit["hit_id"]) & (digest == hit["hit_digest"])
    return documents.join(hit, same, "left_anti")
