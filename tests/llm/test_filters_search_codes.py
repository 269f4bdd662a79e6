"""URL filters, lexical search and vector codes against brute force, with nulls, ties, repeated rows, odd columns and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import lexical_search, url_filter, vector_codes

from .test_operators import corpus, frame

# ---------------------------------------------------------------- URL filters

PAGES = "page_id long, url string, rule string, verdict string, host string, path string, key string, id string"


def parts_of(url):
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest[2]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def judge(url, rules, default="allow"):
    host, path = parts_of(url)
    best = None
    for rule, verdict in rules:
        h, slash, p = (rule or "").partition("/")
        if h and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (len(rule), len(h), rule, verdict == "block")
            best = max(best, key) if best else key
    return (host, path, best[2] if best else None, ("block" if best[3] else "allow") if best else default)


URLS = [
    None, "", "example.org/es/", "http://", "://", "http://EXAMPLE.Org/es/1", "http://a.b.example.org/en/17?x=/es/#y", "https://example.org", "https://example.org/ES/",
    "ftp://notexample.org/es/", "http://x.com/fr/://y.org/", "http://x.com/de/\nz", "http://com/de/", "http://é.org/é", "http://org./es/", "http://..org/", "http://user@x.org:80/", "a://b://org/",
]


def made_urls(seed, n):
    rnd = random.Random(seed)
    host = lambda: ".".join(rnd.choice(["a", "b", "www", "M"]) for _ in range(rnd.randrange(0, 4))) + rnd.choice([".x.org", ".y.org", ".com", "net"])
    path = lambda: "".join(rnd.choice(["/", "/en", "/e", "é", "1", ""]) for _ in range(rnd.randrange(0, 6)))
    return [f"{rnd.choice(['http', 'https'])}://{host()}{rnd.choice(['', '/' + path()])}{rnd.choice(['', '?q=/en', '#/e'])}" for _ in range(n)]


def pages_frame(spark, urls):
    return spark.createDataFrame([(i, u, "r", "v", "h", "p", "k", "i") for i, u in enumerate(urls)], PAGES).coalesce(2)


@pytest.mark.parametrize("block_keys", [1 << 20, 7])
def test_url_filter(spark, block_keys):
    rnd = random.Random(5)
    urls = URLS + made_urls(1, 400) + ["http://a.x.org/en"] * 3
    hosts = [parts_of(u)[0].split(".") for u in made_urls(2, 60)]
    rules = [(".".join(h[rnd.randrange(len(h)) :]) + parts_of(u)[1][: rnd.randrange(6)], rnd.choice(["allow", "block"])) for h, u in zip(hosts, made_urls(3, 60))]
    rules += [("org/", "allow"), ("org/", "block"), (None, "block"), ("", "block"), ("/en", "block"), ("x.org", None), ("net/", "allow")]
    merged = {}
    for r, v in rules:
        merged[r] = "block" if v == "block" or merged.get(r) == "block" else "allow"
    rows = url_filter.filter_urls(pages_frame(spark, urls), url_filter.rule_table(spark, rules), block_keys=block_keys).collect()
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls)
    assert got == {i: judge(u, list(merged.items())) for i, u in enumerate(urls)}
    assert {v[3] for v in got.values() if v[2]} == {"allow", "block"}


def test_url_filter_default_and_empty(spark):
    none = url_filter.filter_urls(pages_frame(spark, URLS), url_filter.rule_table(spark, []), default="block").collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "block")] * len(URLS)
    assert url_filter.filter_urls(pages_frame(spark, []), url_filter.rule_table(spark, [("org/", "block")])).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    """With few bits a level lets many keys pass, so several levels are needed; then each key is told right."""
    keys = spark.range(6000).selectExpr("concat('k', id) AS key", "id % 3 = 0 AS listed").cache()
    others = keys.filter("NOT listed").select("key")
    levels = url_filter.build_cascade(keys.filter("listed").select("key"), lambda test: others.filter(test(others["key"])), 1)
    assert len(levels) > 4
    assert keys.filter(url_filter.member(levels, keys["key"]) != keys["listed"]).count() == 0


# ---------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """(item_id, rank, id, score) by the formula, for docs (id, text) in file order."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for at, (i, c, size) in enumerate(held):
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, at, i))
        out += [(item_id, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "w1 w2 W3 w1 é7"), (2, "w5"), (3, None), (4, ""), (5, "unheard"), (6, " ".join(f"w{i}" for i in range(60))), (None, "w9 w10 one two"), (2, "w5"), (8, "same copy text")]


def items_frame(spark, items):
    return spark.createDataFrame([(*x, "a", "b", "c") for x in items], "item_id long, text string, item string, term string, rid string").coalesce(1)


def copies():
    """Documents of one text, more than k, and one that stands above them."""
    return [(1000 + i, "Same copy text", "s1") for i in range(40)] + [(2000, "same same copy copy text text", "s1")]


@pytest.mark.parametrize("how", [{}, {"max_terms": 0}, {"small_ranges": True}])
def test_rank_documents(spark, monkeypatch, how):
    how = dict(how)
    if how.pop("small_ranges", False):  # patched functions go to the workers by value only where they are closures
        monkeypatch.setattr(lexical_search, "ITEMS", 2)
        monkeypatch.setattr(lexical_search, "PART_POSTINGS", 50)
    rows = corpus(n=120) + copies()
    got = lexical_search.rank_documents(frame(spark, rows), items_frame(spark, ITEMS), k=5, **how)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked([r[:2] for r in rows], ITEMS, 5)


def test_rank_documents_in_blocks(spark):
    rows = corpus(n=60)
    index = lexical_search.Postings(frame(spark, rows))
    pairs = spark.createDataFrame([(i, t) for i, (_, x) in enumerate(ITEMS) for t in sorted(set(terms(x)))], "item long, term string")
    found = [sorted(map(tuple, lexical_search.search(index, pairs, 4, block=b).collect())) for b in (1, 3, 100)]
    assert found[0] == found[1] == found[2] and found[0]


def test_rank_documents_without_rows(spark):
    docs, items = frame(spark, corpus(n=5)), items_frame(spark, ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text = ''"), items)):
        assert lexical_search.rank_documents(d, i).count() == 0


def test_term_counts_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 50}-Ü{i % 7}" for i in range(5000))
    monkeypatch.setattr(lexical_search, "TEXT_BYTES", 64)
    assert {t.decode(): n for t, n in lexical_search.term_counts(text).items()} == Counter(terms(text))


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_term_counts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert {t.decode(): n for t, n in lexical_search.term_counts(text).items()} == Counter(terms(text))


def test_thresholds_prune(spark):
    """Long lists of common terms are not looked through for items that rare terms decide."""
    rows = [(i, f"common word{i % 50} " + ("rare gem " if i % 100 == 0 else "") + f"tail{i}", "s") for i in range(2000)]
    index = lexical_search.Postings(frame(spark, rows))
    pairs = spark.createDataFrame([(0, t) for t in ("common", "rare", "gem")], "item long, term string")
    found = lexical_search.search(index, pairs, 5)
    assert found.count() == 20  # those with rare terms, not the 2000 with the common one


# ---------------------------------------------------------------- vector codes


def brute(vectors, parts, entries, rounds):
    """(codes, errors, books) of kept vectors in order of their ids."""
    x = np.array([[math.floor(1024 * float(v)) for v in vec] for vec in vectors], np.int64)
    width = x.shape[1] // parts
    codes, errors, books = [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        book = own[:entries].copy()
        for _ in range(rounds + 1):
            far = ((own[:, None, :] - book[None]) ** 2).sum(axis=2)
            near = far.argmin(axis=1)
            last = book.copy()
            for e in set(near.tolist()):
                some = own[near == e]
                book[e] = [int(s) // len(some) for s in some.sum(axis=0)]
        codes.append(near)
        errors += far.min(axis=1)
        books.append(last)
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))], errors.tolist(), np.array(books)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, n string, vector string, label_key string"


@pytest.mark.parametrize("n, entries", [(700, 256), (20, 256), (90, 3)])
def test_compress(spark, n, entries):
    rnd = np.random.default_rng(n)
    rows = [(i, [float(v) for v in np.float32(rnd.normal(0, 0.2, 8))], i % 3 or None) for i in range(n)]
    rows += [(n + i, rows[i][1], 7) for i in range(5)] + [(n + 9, [0.0] * 8, 7), (n + 10, [-0.0005] * 8, 7)]
    good = list(rows)
    bad = [None, [], [None] + [0.0] * 7, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7, [0.0] * 7 + [float("-inf")]]
    rows += [(-1 - i, v, 1) for i, v in enumerate(bad)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(int(a), b, None if c is None else int(c), *"abcde") for a, b, c in rows], VECTORS).repartition(3)
    got = sorted(vector_codes.compress(df, entries=entries).collect())
    codes, errors, books = brute([v for _, v, _ in sorted(good, key=lambda r: r[0])], 4, entries, 4)
    sums = defaultdict(int)
    for (_, _, label), e in zip(sorted(good, key=lambda r: r[0]), errors):
        sums[label] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(i, c, e, sums[label], sha) for (i, _, label), c, e in zip(sorted(good, key=lambda r: r[0]), codes, errors)]


def test_compress_odd_ids(spark):
    """Null ids stand after all others in the first codebook, repeated rows are rows of their own."""
    rows = [(None, [9.0, 9.0], 1), (3, [0.5, 0.5], None), (3, [0.5, 0.5], None), (2, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2)
    got = vector_codes.compress(df, parts=2, entries=1, rounds=0).collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got) == [(0, "0000", 2 * 8192**2), (2, "0000", 0), (3, "0000", 2 * 512**2), (3, "0000", 2 * 512**2)]


def test_compress_without_rows_and_unfit(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(df).count() == 0 and vector_codes.compress(df.limit(0)).count() == 0
    for vectors in ([[1.0] * 8, [1.0] * 4], [[1.0] * 6], [[1e9] * 8]):
        with pytest.raises(Exception, match="vectors"):
            vector_codes.compress(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")).count()


@given(st.integers(0, 2**32), st.sampled_from([1, 3, 1000, 2**20, 2**26]), st.integers(1, 24))
@settings(max_examples=150, deadline=None)
def test_nearest_is_exact(seed, scale, d):
    """Also where float32 can't tell entries apart: large, close and equal ones."""
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-scale, scale + 1, (40, d))
    book = np.concatenate([rnd.integers(-scale, scale + 1, (20, d)), x[:10] + rnd.integers(-1, 2, (10, d)), x[:5], x[:5]])
    far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    near, best = vector_codes.nearest(x, book)
    assert near.tolist() == far.argmin(axis=1).tolist() and best.tolist() == far.min(axis=1).tolist()
