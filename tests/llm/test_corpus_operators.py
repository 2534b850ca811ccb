"""The corpus operators against brute force, on the small tables and on awkward rows."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitebooks.llm import (
    byte_bpe,
    decontamination,
    language_id,
    language_model,
    licenses,
    line_dedup,
    nearest,
    ngram_join,
    quality,
    queries,
    token_counts,
)
from sitebooks.llm.shared import shared_folder

FOLDER = "/root/testdata/sf0.001"
TILES = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id string, token int, component bigint, digest string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names operators use inside."""
    queries.workers_find_package(spark)
    texts = [
        (1, "The quick brown fox\njumps over the lazy dog again\nShort", "en", "a"),
        (2, "  JUMPS over the lazy dog AGAIN \t\nÉté à la plage", "fr", "a"),
        (2, "  JUMPS over the lazy dog AGAIN \t\nÉté à la plage", "fr", "a"),
        (3, None, None, None),
        (4, "", "en", None),
        (5, LONG, "en", "b"),
        (6, LONG + " tail", "en", "b"),
        (None, "jumps over the lazy dog again", None, "c"),
        (7, f"before {PASSAGE.upper()} after", "en", "c"),
        (8, "!!! \x00 ... 12", "en", "c"),
        (9, "Licensed under the Apache License, Version 2.0.\nwith more words behind it", "en", "c"),
        (10, "x" * 3000 + " <|endoftext|> 😀", "de", "c"),
        (11, "one two", "en", "c"),
        (12, "ONE  TWO", "en", "c"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, "z", 1, 7, "d") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


def by_id(df, *columns):
    found = collections.defaultdict(set)
    for row in df.collect():
        found[row["doc_id"]].add(tuple(row[c] for c in columns))
    assert all(len(x) == 1 for x in found.values())
    return {k: next(iter(v)) for k, v in found.items()}


def real_texts(spark):
    return {r.doc_id: r.text or "" for r in queries.table(spark, FOLDER, "documents").collect()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- 1 ------------------------------------------------------------------------


def hit_words(text, windows):
    own, hit, items = words(text), set(), set()
    for size in {len(w) for w in windows}:
        for s in range(len(own) - size + 1):
            found = windows.get(tuple(own[s : s + size]))
            if found:
                hit.update(range(s, s + size))
                items |= found
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(own), len(hit), len(items), digest, bool(hit)


def all_windows(items):
    windows = collections.defaultdict(set)
    for item, text in items:
        own = words(text)
        for s in range(max(len(own) - 9, 1) if own else 0):
            windows[tuple(own[s : s + 10])].add("null" if item is None else str(item))
    return windows


HITS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, docs, none):
    items = [(1, PASSAGE), (1, PASSAGE), (2, "Short"), (3, None), (4, ""), (None, "lazy dog"), (10, "fox jumps")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, pos int")
    got = by_id(decontamination.contamination(docs, bench), *HITS)
    windows = all_windows(items)
    assert got == {r.doc_id: hit_words(r.text, windows) for r in docs.collect()}
    assert got[7][1] == 12 and got[3][:2] == (0, 0)
    assert decontamination.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontamination.contamination(none, bench).count() == 0
    kept = decontamination.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in got.items() for _ in range(1 + (i == 2)) if not x[-1])


def test_decontamination_of_the_tables(spark):
    items = [(r.item_id, r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    windows = all_windows(items)
    got = by_id(queries.decontamination(spark, FOLDER), *HITS)
    assert got == {i: hit_words(t, windows) for i, t in real_texts(spark).items()}


# -- 2 ------------------------------------------------------------------------


def shingle_set(text, k=3):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())


def linked_components(sets, percent=90):
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join(spark, docs, none):
    far = 2**63 - 1
    sets = {far if r.doc_id is None else r.doc_id: shingle_set(r.text) for r in docs.collect()}
    want = {None if i == far else i: (n, None if c == far else c) for i, (n, c) in linked_components(sets).items()}
    assert by_id(ngram_join.ngram_components(docs), "n_shingles", "component_id") == want
    assert want[6][1] == 5 and want[12][1] == 11
    assert ngram_join.ngram_components(none).count() == 0
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def test_rows_of_one_id_with_several_texts(spark):
    """Rows without an id, and a repeated id: one text links, one is contaminated, the others stay."""
    near = [f"n{i}" for i in range(60)]
    other = [f"o{i}" for i in range(60)]
    rows = [(1, " ".join(near)), (None, " ".join([*near, "more"])), (None, f"some {PASSAGE} text"), (None, "quite another text"), (None, "quite another text"), (None, None)]
    rows += [(4, " ".join([*near, "words"])), (4, " ".join(other)), (6, " ".join([*other, "more"])), (7, "stands all alone here")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, id string, own_key int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()), key=repr)
    want = [(1, 58, 1), (None, 59, 1), (None, 12, None), (None, 1, None), (None, 1, None), (None, 0, None), (4, 59, 1), (4, 58, 4), (6, 59, 4), (7, 2, 7)]
    assert got == sorted(want, key=repr)
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    stay = [rows[0], *rows[2:6], rows[7], rows[9]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(stay, key=repr)
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted((r for r in rows if r[1] is None or PASSAGE not in r[1]), key=repr)


def test_ngram_join_of_chains_and_hubs(spark):
    """Near copies of one text, links that only chain, and one passage in many unlike texts."""
    rng = np.random.default_rng(5)
    base = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(120):
        copy = list(base)
        for place in rng.choice(120, rng.integers(0, 6), replace=False):
            copy[place] = f"e{i}x{place}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join([f"c{j}" for j in range(i, i + 60)])) for i in range(40)]
    shared = " ".join(f"p{j}" for j in range(20))
    rows += [(2000 + i, shared + " " + " ".join(f"q{i}y{j}" for j in range(rng.integers(1, 30)))) for i in range(100)]
    got = by_id(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string")), "n_shingles", "component_id")
    assert got == linked_components({i: shingle_set(t) for i, t in rows})


def test_ngram_join_of_the_tables(spark):
    got = by_id(queries.ngram_jaccard(spark, FOLDER), "n_shingles", "component_id")
    assert got == linked_components({i: shingle_set(t) for i, t in real_texts(spark).items()})


def test_ngram_join_in_many_chunks_and_blocks(spark, monkeypatch):
    """Small chunks, blocks and hot buckets: same result, and counts that tell rare from shared at any size."""
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(ngram_join, "BLOCK_BITS", 8)
    monkeypatch.setattr(ngram_join, "HOT", 5)
    rng = np.random.default_rng(8)
    passages = [[f"p{i}x{j}" for j in range(12)] for i in range(8)]
    rows, at = [], 0
    for size in (200, 1000):
        while len(rows) < size:
            own = [f"d{at}w{j}" for j in range(50)]
            at += 1
            rows.append((len(rows), " ".join(own[:25] + passages[rng.integers(8)] + own[25:])))
            if at % 10 == 0:
                rows.append((len(rows), " ".join(own[:25] + passages[rng.integers(8)] + [*own[25:-1], "end"])))
        rows += [rows[3]] * 30  # a repeated row
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        join = ngram_join._Join(ngram_join._keyed(docs, "id"), 3, 90)
        chunks = join.docs.groupBy("chunk").agg({"bytes": "sum"}).collect()
        assert len(chunks) > size / 6 and max(r[1] for r in chunks) <= 2000
        # only near copies share rare tokens: their number does not depend on how many others there are
        assert join.shared.select("id").distinct().count() < 0.35 * size
    got = by_id(ngram_join.ngram_components(docs), "n_shingles", "component_id")
    assert got == linked_components({i: shingle_set(t) for i, t in rows})


def test_packed_numbers_are_read_back():
    for numbers in ([], [0], [5, 6, 2**22 - 1], sorted(np.random.default_rng(1).choice(2**22, 5000, replace=False).tolist())):
        own = np.array(numbers, np.uint32)
        assert ngram_join._unpacked(ngram_join._packed(own)).tolist() == numbers


# -- 3 ------------------------------------------------------------------------


def exact_nearest(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, v, n in zip(ids, x, norm, strict=True):
        if i % every == 0:
            score = (x * v).sum(axis=1) / (norm * n)
            other = np.flatnonzero(ids != i)
            out[i] = [(int(ids[j]), score[j]) for j in other[np.lexsort((ids[other], -score[other]))][:k]]
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_nearest_recall(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, folder, "embeddings").collect()]
    want = exact_nearest(rows)
    got = collections.defaultdict(list)
    for r in queries.nearest_vectors(spark, folder).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit >= 0.93 * 5 * len(want)
    assert all(dict(got[q])[i] == pytest.approx(s, abs=1e-12) for q in want for i, s in want[q] if i in dict(got[q]))


def test_nearest_on_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0])]
    rows += [(7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0]), (10, [1.0, 2.0, 3.0]), (50, [0.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, block int, score int")
    got = [tuple(r) for r in nearest.nearest(df).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 9), (0, 3, 2), (0, 4, 50), (50, 1, 0), (50, 2, 1), (50, 3, 9), (50, 4, 2)]
    assert nearest.nearest(df.where("false")).count() == 0


# -- 4 ------------------------------------------------------------------------


def test_quality(spark, docs, none):
    documents, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    model = quality.trained(documents, labels.where("doc_id % 3 <> 0"))
    scored, (score, *_) = quality.scored(documents, model)
    held = [(truth[r.doc_id], r[score] >= 0.5) for r in scored.collect() if r.doc_id in truth and r.doc_id % 3 == 0]
    assert sum(bool(q) == keep for q, keep in held) >= 0.95 * len(held)
    clean = [keep for q, keep in held if q]
    assert sum(clean) >= 0.98 * len(clean)
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (5, 0, 1), (None, 0, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_scores(docs, few).count() == docs.count()
    assert quality.good_documents(docs, few).columns == docs.columns
    assert quality.quality_scores(docs, few.where("quality = 1")).where("not keep").count() == 0
    assert quality.quality_scores(none, few).count() == 0


# -- 5 and 7 ------------------------------------------------------------------


def test_token_counts_and_cache(spark, docs, none):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), shared_folder(spark)
    library = Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs, path, cache), "n_bytes", "n_tokens", "over_limit")
    sizes = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()}
    assert got == {i: (b, n, n > 512) for i, (b, n) in sizes.items()}
    stored = spark.read.parquet(cache)
    before = stored.count()
    assert before == len({r.text or "" for r in docs.collect()})
    # a stored count is used, not computed again, and only misses are appended
    forged = stored.limit(1).first()
    assert token_counts.token_counts(docs, path, cache).count() == docs.count()
    assert spark.read.parquet(cache).count() == before and forged.n_tokens >= 0
    assert token_counts.token_counts(none, path, cache).count() == 0
    other = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert other.count() == docs.count() and spark.read.parquet(cache).count() == 2 * before


def tiles():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TILES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def coded(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe(spark, docs, none):
    encoding = tiles()
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    got = by_id(byte_bpe.round_trip(docs, TILES, public_tokenizers.PATTERN), *columns)
    assert got == {r.doc_id: coded(encoding, r.text) for r in docs.collect()}
    assert byte_bpe.round_trip(none, TILES, public_tokenizers.PATTERN).count() == 0
    full = byte_bpe.round_trip(docs.where("doc_id = 10"), TILES, public_tokenizers.PATTERN, texts=True).first()
    assert full.decoded == docs.where("doc_id = 10").first().text and full.ids == encoding.encode_ordinary(full.decoded)
    assert by_id(queries.bpe_round_trip(spark, FOLDER), *columns) == {i: coded(encoding, t) for i, t in real_texts(spark).items()}


def test_long_and_odd_pieces_encode_as_the_library_does():
    encoding, rng = tiles(), np.random.default_rng(3)
    bpe = byte_bpe.RecursiveBpe(open(TILES, "rb").read(), public_tokenizers.PATTERN)
    texts = ["a" * n for n in (1, 199, 200, 201, 1001)] + ["".join(map(chr, rng.integers(97, 105, 700))) for _ in range(5)]
    texts += ["".join(map(chr, rng.integers(1, 0x2FFF, 60))) for _ in range(20)]
    for text, (n, ids, raw) in zip(texts, bpe.texts(texts), strict=True):
        assert ids == " ".join(map(str, encoding.encode_ordinary(text))) and raw == text.encode() and n == len(ids.split())


# -- 6 ------------------------------------------------------------------------


def check_scores(df, texts):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter()
    for i, text in texts:
        if not held(i):
            counts.update((text or "").encode().lower().split())
            counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    want = collections.defaultdict(set)
    for i, text in texts:
        own = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own)
        want[i].add((held(i), len(own), sum(counts[w] > 0 for w in own), total, round(base, 4)))
    rows = df.collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)))
        assert r.score < 0
    assert got == want and len(rows) == len(texts)
    return rows


def test_language_model_scores(spark, docs, none, monkeypatch):
    check_scores(language_model.scores(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert language_model.scores(none).count() == 0
    rows = check_scores(queries.lm_scores(spark, "/root/testdata/sf0.01"), [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()])
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_listed_and_joined_counts_agree(spark, monkeypatch):
    docs = queries.table(spark, FOLDER, "documents")
    whole = language_model.vocabulary
    monkeypatch.setattr(language_model, "vocabulary", lambda counts, ends: whole(counts, ends, words=50, listed=60))
    check_scores(language_model.scores(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_model_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    model = language_model.LogBilinear(rng.integers(1, 100, 30))
    target = rng.integers(0, 30, 4000)
    before = model.flat()
    model.train(rng.integers(0, 31, 4000), rng.integers(0, 31, 4000), target, 1, {})
    assert not np.allclose(before, model.flat())
    tables = model.tables()
    one, two, target = (x.ravel() for x in np.meshgrid(np.arange(31), np.arange(31), np.arange(30), indexing="ij"))
    chance = 10.0 ** tables.log_chance(one, two, target).reshape(31, 31, 30)
    assert np.allclose(chance.sum(axis=2), 1, atol=1e-4)


def test_language_model_learns_from_every_position_of_every_round(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a{i} b{i % 7} c{i % 3}",) for i in range(400)], "text string")
    v = language_model.vocabulary(language_model.word_counts(docs).persist(), 400, words=5, listed=40)
    assert v.by_hash > 1 and v.class_counts.sum() == v.tokens == 1600 and v.class_types.sum() + 1 == v.types
    shared = spark.sparkContext.accumulator(0)
    train = language_model.LogBilinear.train

    def counting(self, one, two, target, *rest):
        shared.add(len(target))
        train(self, one, two, target, *rest)

    monkeypatch.setattr(language_model.LogBilinear, "train", counting)
    from pyspark import cloudpickle as own

    own.register_pickle_by_value(language_model)
    try:
        language_model.trained(docs, v)
    finally:
        own.unregister_pickle_by_value(language_model)
    assert shared.value == language_model.ROUNDS * v.tokens


def test_rarer_words_are_classes_that_grow_with_the_counts(spark):
    few, many = (spark.range(1, n).selectExpr("id * 1000003 as word", "1 + 100000 div id as n") for n in (4_000, 40_000))
    small, large = (language_model.vocabulary(c, 10) for c in (few, many))
    assert len(large.class_counts) > len(small.class_counts) > language_model.WORDS + 10
    assert np.count_nonzero(large.class_counts[large.words + 1 :]) > 100
    shares = large.log_shares()
    listed, counts, classes = large.look_up(large.hashes)
    inside = np.bincount(classes, weights=(counts + 1) / 10 ** shares[classes], minlength=len(shares))
    groups = slice(large.words + 1, large.words + 1 + large.by_count)
    assert listed.all() and np.allclose(inside[groups], 1)


# -- 8 ------------------------------------------------------------------------


def test_language_id(spark, docs, none):
    table = queries.table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in table.collect()}
    rows = language_id.languages(table).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    got = by_id(language_id.languages(docs), "lang_pred", "score")
    assert got[3] == got[4] == got[8] == ("und", 0.0) and None in got
    assert language_id.languages(none).count() == 0
    blank = language_id.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in blank.collect()} == {"und"}


def test_many_languages_and_languages_with_few_texts(spark):
    """70 languages, one short text each but one with many: each is found again."""
    rng = np.random.default_rng(7)
    words_of = [["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(12)] for _ in range(70)]
    rows = [(i, " ".join(w), f"l{i:02}") for i, w in enumerate(words_of)]
    rows += [(100 + i, " ".join(rng.permutation(words_of[0])), "l00") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = language_id.learned_filters(df.select("lang", "text"))
    assert len(filters.languages) == 70 and filters.masks.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in language_id.predicted(df, filters).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_sliced_filters_hold_every_member():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**32, 5000).astype(np.uint64)
    owner = rng.integers(0, 3, 5000)
    masks = np.zeros(language_id.POSITIONS, np.uint64)
    for places in language_id._places(values):
        np.bitwise_or.at(masks, places, np.uint64(1) << owner.astype(np.uint64))
    held = language_id.SlicedFilters(["a", "b", "c"], masks).holders(values)
    assert ((held >> owner.astype(np.uint64)) & np.uint64(1)).all()


# -- 9 ------------------------------------------------------------------------


def best_containment(text, notice, k=5):
    own, template = words(text), words(notice)
    shingles = lambda w: {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
    step = max(len(template) // 4, 1)
    target = shingles(template)
    grid = range(0, max(len(own), 1), step)
    return max((len(target & shingles(own[s : s + len(template) + step - 1])) / len(target) for s in grid), default=0)


def expected_report(text, texts):
    found = {name: best_containment(text, notice) for name, notice in texts.items()}
    found = {n: c for n, c in found.items() if c >= 0.8}
    return len(words(text)), len(found), ",".join(sorted(found)), max(found.values(), default=0.0)


REPORT = ("n_words", "n_licenses", "licenses", "containment")


def test_license_scan(spark, docs, none):
    got = by_id(licenses.license_report(docs, licenses.notices(spark)), *REPORT)
    assert got == {r.doc_id: expected_report(r.text, licenses.NOTICES) for r in docs.collect()}
    assert got[9][2] == "apache-2.0"
    short = {"tiny": "one two", "empty": "..."}
    assert by_id(licenses.license_report(docs, licenses.notices(spark, short)), *REPORT)[11][2] == "tiny"
    assert licenses.license_report(none, licenses.notices(spark)).count() == 0
    empty = licenses.notices(spark).where("false")
    assert licenses.license_report(docs, empty).where("n_licenses > 0").count() == 0
    near = licenses.NOTICES["mit-permission"].replace("charge", "cost")
    changed = spark.createDataFrame([(1, f"some words before {near} and after")], "doc_id bigint, text string")
    assert licenses.license_report(changed, licenses.notices(spark)).first().licenses == ""
    near = licenses.NOTICES["mit-permission"].replace("associated", "related")
    changed = spark.createDataFrame([(1, f"some words before {near} and after")], "doc_id bigint, text string")
    assert licenses.license_report(changed, licenses.notices(spark)).first().licenses == "mit-permission"


def test_whole_notices_with_edits_are_found(spark):
    whole = {n: t for n, t in licenses.NOTICES.items() if n.endswith("-text")}
    assert {"mit-text", "bsd-3-clause-text", "isc-text", "gpl-3.0-text", "lgpl-3.0-text", "mpl-2.0-text", "cc0-1.0-text", "unlicense-text", "apache-2.0-text"} <= set(whole)
    rows = [
        (1, "x y " + whole["mit-text"].replace("charge", "cost") + " z", "mit-text"),
        (2, "x y " + whole["bsd-3-clause-text"].replace("modification", "change") + " z", "bsd-3-clause-text"),
        (3, "x y " + whole["isc-text"].replace("distribute", "share") + " z", "isc-text"),
        (4, whole["gpl-3.0-text"].replace("Definitions", "Terms"), "gpl-3.0-text"),
    ]
    got = by_id(licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string, want string"), licenses.notices(spark)), "licenses")
    assert all(want in got[i][0].split(",") for i, _, want in rows), got


def test_license_scan_of_the_tables(spark):
    got = by_id(queries.license_scan(spark, FOLDER), *REPORT)
    assert got == {i: expected_report(t, licenses.NOTICES) for i, t in real_texts(spark).items()}


# -- 10 -----------------------------------------------------------------------


def line_key(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()


def kept_lines(texts):
    holders = collections.defaultdict(set)
    for i, text in texts:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 10:
                holders[line_key(line)].add(2**63 if i is None else i)
    out = {}
    for i, text in texts:
        lines = (text or "").split("\n")
        own = 2**63 if i is None else i
        stay = [x for x in lines if not (len(holders.get(line_key(x), ())) > 1 and min(holders[line_key(x)]) != own)]
        out[i] = len(lines), len(lines) - len(stay), "\n".join(stay)
    return out


@pytest.mark.parametrize("increments", [1, 3])
def test_line_dedup(spark, docs, none, increments):
    got = by_id(line_dedup.deduplicated_lines(docs.drop("score"), increments), "n_lines", "n_dropped", "text")
    assert got == kept_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert got[None][1] == 1
    assert line_dedup.deduplicated_lines(none, increments).count() == 0


def test_line_dedup_is_reversible(spark):
    docs = queries.table(spark, FOLDER, "documents")
    state = line_dedup.LineDedup(spark, shards=4)
    counts = lambda: {r.key: (r.refs, r.first_id) for r in state._table("counts").collect()}
    state.insert(docs.where("doc_id % 2 = 0"))
    before = counts()
    state.insert(docs.where("doc_id % 2 = 1"))
    everything = counts()
    state.delete(docs.where("doc_id % 2 = 1").select("doc_id"))
    assert counts() == before
    gone = docs.where("doc_id % 2 = 1").select(docs["text"].alias("line")).where("length(line) > 20 and line not like '%\\n%'")
    assert state.maybe_held(gone).count() <= gone.count()
    # the smallest holder goes: the next one takes over
    state.insert(docs.where("doc_id % 2 = 1"))
    assert counts() == everything
    state.delete(docs.where("doc_id < 50").select("doc_id"))
    rest = docs.where("doc_id >= 50")
    texts = [(r.doc_id, r.text) for r in rest.collect()]
    assert by_id(state.apply(rest.select("doc_id", "text")), "n_lines", "n_dropped", "text") == kept_lines(texts)


def test_new_lines_that_the_filter_takes_for_known_ones_can_be_deleted(spark):
    """Two lines whose keys share fingerprint and buckets, through insert, insert, delete, insert."""
    first, second = "this is line number 110", "this is line number 4879"
    one, two = (line_dedup.mixed(np.frombuffer(hashlib.md5(x.encode()).digest()[:8], np.uint64)) for x in (first, second))
    alike = line_dedup.CuckooFilter()
    alike.add(one)
    assert alike.contains(two).all() and one != two
    rows = spark.createDataFrame([(1, first), (2, second), (3, first)], "doc_id bigint, text string")
    state = line_dedup.LineDedup(spark, shards=1)
    state.insert(rows.where("doc_id = 1"))
    state.insert(rows.where("doc_id = 2"))
    state.delete(rows.where("doc_id = 2").select("doc_id"))
    assert state.maybe_held(rows.where("doc_id = 1").select(F.col("text").alias("line"))).count() == 1
    state.insert(rows.where("doc_id = 3"))
    counts = [(r.refs, r.first_id) for r in state._table("counts").collect()]
    assert counts == [(2, 1)]
    assert [r.doc_id for r in state.decisions().collect()] == [3]


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    members = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    own = line_dedup.CuckooFilter(1000)
    own.add(members[:5000])
    own.add(members[5000:])
    own = line_dedup.CuckooFilter.from_bytes(own.to_bytes())
    assert own.contains(members).all()
    strangers = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
    assert own.contains(strangers).mean() < 0.01
    own.remove(members[:3000])
    assert own.contains(members[3000:]).all() and own.contains(members[:3000]).mean() < 0.05
    assert own.held == len(members) - 3000


# -- pipeline -----------------------------------------------------------------


def test_pipeline(spark, docs):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES][-1] == "encode"
    documents = queries.table(spark, FOLDER, "documents")
    for (_, stage), at in zip(corpus_pipeline.STAGES[:-1], range(4), strict=False):
        out = stage(spark, documents, FOLDER)
        assert out.schema.names == documents.schema.names, at
        documents = out
    last = corpus_pipeline.run(spark, FOLDER)
    assert 0 < last.count() == len({r.doc_id for r in last.collect()})
    good = {r.doc_id for r in corpus_pipeline.drop_bad_quality(spark, queries.table(spark, FOLDER, "documents"), FOLDER).collect()}
    assert {r.doc_id for r in last.collect()} <= good


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    numbers = sorted(int(k[2:].split("_")[0]) for k in entry.queries() if re.match(r"op\d+_", k))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
