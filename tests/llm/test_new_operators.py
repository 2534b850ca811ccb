"""URL filters, spelling variants and periodic runs against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitebooks.llm import periodic, queries, spelling, url_filter
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# -- 11 -----------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return lower(host), re.match("[^?#]*", rest[len(host) :])[0]


def rule_for(host, path, rules):
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.host + r.path), default=None)
    return best and best.host + best.path, best and best.verdict


def domain_of(host):
    bare = re.sub("^[^@]*@", "", host).split(":")[0].rstrip(".")
    labels = bare.split(".")
    if len(labels) == 1 or re.fullmatch("[0-9.]+", bare):
        return bare, bare
    k = 2 if len(labels) > 2 and ".".join(labels[-2:]) in url_filter.TWO_LABELS else 1
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def reputations(pages, outcomes):
    """Lower bound of the bad rate of each host, by plain loops."""
    n, k = collections.Counter(), collections.Counter()
    for page, url in pages:
        host = split_url(url)[0]
        n[host] += page in outcomes
        k[host] += outcomes.get(page, 0)
    levels = [{h: domain_of(h)[1] for h in n}, {h: domain_of(h)[0] for h in n}, {h: h for h in n}]
    prior = {h: (sum(k.values()) + 0.5) / (sum(n.values()) + 1) for h in n}
    for level in levels:
        ln, lk = collections.Counter(), collections.Counter()
        for h in n:
            ln[level[h]] += n[h]
            lk[level[h]] += k[h]
        mean = {level[h]: prior[h] for h in n}
        excess = sum((lk[g] - ln[g] * m) ** 2 - ln[g] * m * (1 - m) for g, m in mean.items())
        pairs = sum(ln[g] * (ln[g] - 1) * m * (1 - m) for g, m in mean.items())
        weight = 1000 if not pairs or excess <= 0 else min(max(pairs / excess - 1, 1), 1000)
        rate = {g: (lk[g] + weight * m) / (ln[g] + weight) for g, m in mean.items()}
        size = {g: ln[g] + weight + 1 for g in mean}
        prior = {h: rate[level[h]] for h in n}
    return {h: p - math.sqrt(p * (1 - p) / size[h] * 19) for h, p in prior.items()}


def expected_verdicts(pages, outcomes, rules):
    bound = reputations(pages, outcomes)
    out = []
    for page, url in pages:
        host, path = split_url(url)
        rule, verdict = rule_for(host, path, rules)
        out.append((page, host, path, rule, verdict or ("block" if bound[host] > 0.5 else "allow")))
    return sorted(out, key=repr)


AWKWARD_URLS = [
    None, "", "no scheme", "http://", "http://COM/x", "https://a.com", "https://a.com?x=/y", "HTTP://Ä.Example.COM/en/#f",
    "http://x.net/es/", "http://x.net/ES/", "http://www.example.com/en/1", "http://m.www.example.com/en/", "http://example.com/en/a?b://c",
    "http://u:p@h.example.org:80/a", "http://10.0.0.1/a", "http://localhost/a", "http://shop.co.uk/a", "http://a.shop.co.uk./a",
    "a://b://c/d", "x://h/" + "p" * 5000, "http://xexample.com/en/", "http://com", "http://h.org/line\nbreak?x",
]


def test_url_rules_and_awkward_urls(spark):
    pages = [(i, u) for i, u in enumerate(AWKWARD_URLS)] + [(None, "http://good.org/a"), (3, "http://com/"), (3, "http://com/")]
    df = spark.createDataFrame([(i, u, "host", 1, "x") for i, u in pages], "page_id bigint, url string, host string, n int, rule string")
    outcomes = {3: 1, 13: 0}
    labels = spark.createDataFrame([(3, 0, None), (3, 1, 0), (13, 1, 0), (14, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = url_filter.url_verdicts(df, url_filter.page_outcomes(labels), queries.URL_RULES)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_verdicts(pages, outcomes, queries.URL_RULES)
    assert url_filter.url_verdicts(df.where("false"), url_filter.page_outcomes(labels), queries.URL_RULES).count() == 0
    plain = url_filter.url_verdicts(df, url_filter.page_outcomes(labels.where("false")), [])
    assert plain.where("verdict = 'allow' and rule is null").count() == len(pages)


def test_reputation_blocks_bad_hosts_only(spark):
    """A bad host with a third of all pages, many small hosts, and hosts that only their domain speaks for."""
    random.seed(5)
    pages, outcomes = [], {}
    for i in range(6000):
        bad = 0.05
        if i % 3 == 0:
            host, bad = "hot.bad.org", 0.97
        elif i % 3 == 1:
            host = f"h{random.randrange(300)}.good{random.randrange(20)}.org"
        else:
            host, bad = f"s{random.randrange(200)}.farm.net", 0.99
        pages.append((i, f"http://{host}/{i}"))
        if random.random() < 0.4:
            outcomes[i] = int(random.random() < bad)
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    known = spark.createDataFrame(list(outcomes.items()), "page_id bigint, bad int")
    got = sorted(map(tuple, url_filter.url_verdicts(df, known, []).collect()), key=repr)
    assert got == expected_verdicts(pages, outcomes, [])
    blocked = collections.Counter((h.split(".", 1)[1], v) for _, h, _, _, v in got)
    assert blocked["bad.org", "allow"] == 0 and blocked["farm.net", "allow"] == 0
    assert not any(v == "block" and d.startswith("good") for d, v in blocked)


def test_url_filter_equals_its_sql(spark):
    got = queries.url_filter(spark, FOLDER)
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    assert compare(got, con, queries.SQL["op11_url_filter"]).startswith("ok")
    assert got.count() == 50


def test_url_filter_has_no_python_and_no_nested_loop(spark):
    plan = queries.url_filter(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Cartesian", "NestedLoop", "Python", "Arrow"):
        assert bad not in plan


# -- 12 -----------------------------------------------------------------------


def brute_words(rows, least=7, noise=31):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower(run)
            crc = zlib.crc32(f"{doc_id}:{run}".encode())
            if noise and doc_id is not None and crc % noise == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_forms(counts, factor=10):
    masks = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):
            masks[w[:i] + "\0" + w[i:]].add(w)
            if i < len(w):
                masks[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in masks.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_corpus_words(spark):
    texts = [(1, "Étoile ÉTOILES étoiles STRASSE_straßen x" * 3), (2, None), (3, ""), (None, "wordsandwords " * 40), (2**40, "Wordsandwords " * 40), (5, "a" * 40000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id bigint, text string, word string, n int")
    got = {r.word: r.n for r in spelling.corpus_words(df).collect()}
    assert got == dict(brute_words(texts))
    assert spelling.corpus_words(df.where("false")).count() == 0


def test_forms_of_planted_chains(spark):
    random.seed(3)
    counts = {"": 4, "a": 50, "ab": 3, "é": 2, "abcdefgh": 1, "abcdefghi": 10, "abcdefghij": 100, "abcdefghik": 100, "abcdefghijk": 1000,
              "abcdefghijkl": 10**7, "zzzzzzzz": 5, "zzzzzzzzz": 50, "x" * 5000: 3, "x" * 5001: 30, "x" * 4999 + "y": 30}
    for _ in range(300):
        counts["".join(random.choice("abc") for _ in range(random.randrange(3, 7)))] = random.choice([1, 2, 30, 400, 5000])
    rows = [(w, n - 1, 0, "f") for w, n in counts.items()] + [(w, 1, 0, "f") for w in counts] + [(None, 3, 0, "f"), ("null", None, 0, "f")]
    df = spark.createDataFrame(rows, "word string, n bigint, id int, form string")
    got = spelling.spelling_forms(df)
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == brute_forms(counts)
    assert spelling.spelling_forms(df.where("false")).count() == 0


def test_doublings_cover_the_longest_chain():
    for least, most, steps in ((1, 9, 0), (1, 10, 1), (1, 100, 2), (2, 1999, 2), (2, 2000, 3), (1, 10**5, 5), (1, 10**18, 18)):
        assert 2 ** spelling.doublings(least, most, 10) >= max(steps, 1)


@given(st.lists(st.text("abcdé", max_size=8), min_size=1, max_size=12), st.integers(4, 7))
@settings(max_examples=60, deadline=None)
def test_neighbourhoods_meet_every_near_word(words, symbols):
    words = sorted(set(words))
    cells = spelling.reduced_keys(words, symbols)
    met = {frozenset((w, words[j])) for at, keys in spelling.neighbour_keys(words, symbols) for w, key in ((words[a], k) for a, k in zip(at, keys)) for j in np.flatnonzero(cells == key)}
    assert {frozenset(p) for p in ((a, b) for a in words for b in words) if one_edit(*p)} <= met


def test_spelling_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect()]
    counts = {w: n for w, n in brute_words(rows).items() if n >= 2}
    got = {tuple(r[c] for c in COLUMNS) for r in queries.spelling_variants(spark, FOLDER).collect()}
    assert got == brute_forms(counts)


# -- 13 -----------------------------------------------------------------------


def brute_runs(words, least=6, powers=4):
    """Every lag from one word to a quarter of the text."""
    known, found = {}, {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    for q in range(1, len(words) // powers + 1):
        same = np.concatenate(([0], (ids[:-q] == ids[q:]).astype(np.int8), [0]))
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for start, end in zip(starts.tolist(), ends.tolist()):
            if end + q - start >= max(least, powers * q):
                found.setdefault((start, end + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def numbered(texts):
    offset, out = 0, []
    for words in texts:
        own = {}
        out.append(np.array([offset + own.setdefault(w, len(own)) for w in words], np.int64))
        offset += len(own)
    return out


@given(st.lists(st.lists(st.integers(0, 1), max_size=120), max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs_of_two_words(texts):
    assert periodic.runs_of(numbered(texts)) == [brute_runs(t) for t in texts]


@given(st.integers(1, 90), st.integers(0, 40), st.integers(4, 6), st.integers(0, 30), st.integers(2, 40), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_planted_runs_of_any_period(period, before, times, more, letters, seed):
    rng = random.Random(seed)
    block = [rng.randrange(letters) for _ in range(period)]
    text = [rng.randrange(letters) for _ in range(before)] + (block * (times + 1))[: times * period + more % period]
    text += [rng.randrange(letters) for _ in range(before // 2)]
    assert periodic.runs_of(numbered([text, text[::-1]])) == [brute_runs(text), brute_runs(text[::-1])]


def test_period_with_repeats_inside():
    """Periods that themselves hold shorter runs and equal stretches, around the borders of scales."""
    texts = []
    for q in (8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129):
        block = ["a"] * (q - 1) + ["b"]
        texts += [block * 4, block * 4 + ["a"] * 3, (["x", "y"] * q)[: q - 1] + block * 5]
    assert periodic.runs_of(numbered(texts)) == [brute_runs(t) for t in texts]


def test_too_few_powers_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of([], powers=3)


def test_periodic_of_awkward_rows(spark):
    line = "one two three four five six seven eight nine ten "
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, "go " * 9), (4, "go " * 9), (4, "go " * 9), (5, line * 700), (6, "a\u00a0b a\x1cb " * 6),
             (7, " ".join(f"w{i % 977}" for i in range(30_000))), (8, "x y " * 4 + "z " * 6), (9, "é😀 " * 6), (10, "z" * 100_000)]
    texts += [(i, f"{line} tail {i} " * 2 + "la " * (i % 9)) for i in range(11, 40)]
    df = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in texts], "doc_id bigint, text string, start int, length int, runs string")
    got = periodic.run_report(periodic.periodic_runs(df, rewrite=queries.repeated_tail)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_report(i, t)) for i, t in texts), key=repr)
    assert next(r for r in got if r.doc_id == 7).period == 977
    assert periodic.run_report(periodic.periodic_runs(df.where("false"))).count() == 0


def test_periodic_of_the_tables(spark):
    rows = queries.table(spark, FOLDER, "documents")
    got = queries.periodic(spark, FOLDER)
    want = {(r.doc_id, *brute_report(r.doc_id, r.text)) for r in rows.collect()}
    assert {tuple(r) for r in got.collect()} == want
    assert any(w[1] for w in want)
