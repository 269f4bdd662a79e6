import json
import random
from collections import deque
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern import config
from quern.config import ChunkConfig, CrawlConfig, RetrievalConfig, SiteConfig
from quern.operators import answer, cells, chunking, conversation, crawl, dom, frames, grams, html, index, loop, retrieval
from quern.sources import files, pages, robots

# Pages

PAGE = """<html><head><title> My  page </title></head><body><nav class="navbar"><a href="/home">Home</a></nav>
<header role="banner">Banner</header><main><h1>Guide</h1><p>Intro with <a href="/a?b#c">a link</a>.</p><h2>Steps</h2>
<ul><li>One</li><li>Two <ol><li>deep</li></ol></li></ul><h4>Deep</h4><table><tr><th>K</th><th>V</th></tr><tr><td>x</td><td>y</td></tr><tr><td></td></tr></table>
<p>Last <b>bold<p>Next</main><footer>Foot</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_cleaning_keeps_content_and_drops_chrome():
    done = html.clean(PAGE, "https://hub.example.com/x/")
    text = done["cleaned_text"]
    assert done["title"] == "My page" and not any(w in text for w in ("Home", "Banner", "Foot", "var x"))
    assert text.startswith("# Guide") and "## Steps" in text and "- One\n- Two" in text and "1. deep" in text and "K | V\nx | y" in text
    assert "[a link](https://hub.example.com/a?b#c)" in text and "Last bold" in text and "\n\nNext" in text
    assert [b["section"] for b in done["blocks"] if b["kind"] == "heading"] == ["Guide", "Guide > Steps", "Guide > Steps > Deep"]
    assert done["preserved_links"] == [{"text": "a link", "url": "https://hub.example.com/a?b#c"}]


def test_section_path_is_positional():
    heads = html.content_blocks(html.parse("<h1>A</h1><h3>C</h3><h4>D</h4><h3>E</h3>"), "")
    assert [b["section"] for b in heads] == ["A", "A > C", "A > C > D", "A > C > E"]


def test_chrome_hints_need_whole_words_and_short_text():
    kept = '<div class="allMenu">Grid text</div><div id="main-menu">' + "long content " * 80 + '</div><div class="skip-link">Skip</div><div class="site menu">Menu</div>'
    text = html.clean(f"<body>{kept}</body>")["cleaned_text"]
    assert "Grid text" in text and "long content" in text and "Skip" not in text and "Menu\n" not in text and not text.endswith("Menu")


def test_extraction(spark):
    rows = spark.createDataFrame([(1, "https://hub.example.com/x/", PAGE), (2, None, None), (3, "https://hub.example.com/y", "<p>a<!-- note --><a href='https://o.example/'>o</a><a href='/z'>1</a><a href='/z#q'>2</a><h2>B</h2><h1>A</h1>")], "page_id long, url string, html string")
    got = {r["page_key"]: r for r in html.extract_pages(rows, ["hub.example.com"]).collect()}
    assert len(got) == 3 and got[2]["cleaned_text"] == "" and got[2]["blocks"] == []
    assert [(x["url"], x["text"], x["internal"]) for x in got[3]["links"]] == [("https://o.example/", "o", False), ("https://hub.example.com/z", "1", True)]
    assert [(h["level"], h["text"]) for h in got[3]["headings"]] == [("h1", "A"), ("h2", "B")]
    assert "note" in got[3]["visible_text"] and got[1]["navigation"][0]["label"] == "navbar" and got[1]["visible_text"].startswith("My page")


def test_without_html():
    done = html.clean_without_html("T", [{"level": "h3", "text": "H"}, {"level": "hx", "text": "I"}], " body ", [{"text": "l", "url": "https://x", "internal": True}, {"text": "m", "url": "https://y", "internal": False}])
    assert done["cleaned_text"] == "# T\n\n### H\n\n## I\n\nbody\n\n[l](https://x)"


def test_line_dedupe_window():
    many = [f"line {i}" for i in range(40)]
    assert html.distinct_lines("\n".join(["a", *many[:39], "a"])) == "\n".join(["a", *many[:39]])
    assert html.distinct_lines("\n".join(["a", *many, "A"])) == "\n".join(["a", *many, "A"])
    assert html.distinct_lines("x" * 120 + "\n\n" + "x" * 120) == "x" * 120 + "\n\n" + "x" * 120


def test_block_dedupe_matches_native(spark):
    rnd = random.Random(1)
    blocks = [(d, i, rnd.choice(["heading", "paragraph"]), rnd.choice(["a", " A ", "b", "c" * 180])) for d in range(5) for i in range(20)]
    got = {(r["doc_id"], r["pos"]) for r in html.dedupe_blocks(spark.createDataFrame(blocks, "doc_id int, pos int, kind string, text string")).collect()}
    expected = set()
    for d in range(5):
        own = [{"kind": k, "text": t, "pos": i} for e, i, k, t in blocks if e == d]
        expected |= {(d, b["pos"]) for b in html.distinct_blocks(own)}
    assert got == expected


# Chunks


def test_windows_match_a_walk(spark):
    config = ChunkConfig(10, 3, 1)
    for n in (0, 1, 39, 40, 41, 68, 69, 200):
        text = "".join(chr(97 + i % 26) for i in range(n))
        walk, at = [], 0
        while text and at < n:
            walk.append(text[at : at + 40])
            if at + 40 >= n:
                break
            at += 28
        assert chunking.windows(text, config) == walk
        assert spark.range(1).select(chunking.fixed_windows(F.lit(text), config)).first()[0] == walk


@pytest.mark.parametrize("seed", range(6))
def test_split_keeps_all_words_in_bounds(seed):
    rnd = random.Random(seed)
    config = ChunkConfig(20, 5, 3)
    text = "\n\n".join("\n".join("w" * rnd.randrange(1, 9) + str(rnd.randrange(99)) for _ in range(rnd.randrange(1, 6))) for _ in range(30)).strip()
    pieces = chunking.split(text, config)
    assert all(chunking.tokens(p) <= config.size for p in pieces) and len(pieces) > 1
    assert all(w in "\n".join(pieces) for w in text.split())


def test_tiny_piece_merges_across_sections():
    got = chunking.chunk_groups([("A", "A", "x" * 400), ("B", "B", "tiny")], ChunkConfig(100, 20, 10))
    assert len(got) == 1 and got[0]["text"] == "x" * 400 + "\n\ntiny" and got[0]["heading"] == "A"
    assert len(chunking.chunk_groups([("A", "A", "x" * 400), ("B", "B", "y" * 100)], ChunkConfig(100, 20, 10))) == 2


def test_chunks_of_pages(spark):
    rows = spark.createDataFrame([(1, "https://hub.example.com/x/", PAGE), (2, "https://hub.example.com/e", "")], "page_id long, url string, html string")
    docs = html.extract_pages(rows, ["hub.example.com"])
    chunks = chunking.chunk_documents(docs, ChunkConfig(20, 5, 2), source_label="L")
    got = chunks.orderBy("chunk_no").collect()
    assert len(got) >= 2 and all(r["token_count"] == chunking.tokens(r["text"]) for r in got)
    assert {"chunk_id", "page_title", "url", "section", "heading", "crawl_timestamp", "source_type", "source", "access", "content_hash"} <= set(chunks.columns)
    assert got[0]["source"] == "L" and got[0]["access"] == "authenticated" and got[0]["section"] == "Guide"
    packed = chunking.to_documents(docs, chunks).collect()
    assert len(packed) == 1 and packed[0]["chunk_count"] == len(got) and packed[0]["sections"] == ["Guide", "Guide > Steps", "Guide > Steps > Deep"]
    plain = spark.createDataFrame([("u", "T", "some text", None)], f"url string, title string, cleaned_text string, blocks {html.BLOCKS}")
    assert [(r["section"], r["heading"]) for r in chunking.chunk_documents(plain).collect()] == [("T", "T")]


# Retrieval


def corpus(spark):
    rows = [("a", "the travel policy text", "Travel", "https://h/1", "s", None, 0, [1.0, 0.0]), ("b", "leave rules and Travel", "Leave", "https://h/2", "", "authenticated", 1, [0.8, 0.6]), ("c", "travel secret", "Secret", "https://h/3", "", "restricted", 2, [1.0, 0.1]), ("d", "party hall", "Hall", "https://h/4", "", "", 3, [0.0, 1.0])]
    return spark.createDataFrame(rows, "chunk_id string, text string, title string, url string, section string, access string, pos long, embedding array<double>")


def asked(spark, *questions):
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(questions)], "query_id long, question string, vector array<double>")


def test_vector_topk(spark):
    got = retrieval.vector_topk(asked(spark, ("x", [1.0, 0.0]), ("y", None)), corpus(spark), 2).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in got] == [(0, "a", 1), (0, "c", 2)] and got[0]["distance"] == 0.0
    one = retrieval.vector_topk_one(corpus(spark), [1.0, 0.0], 2).collect()
    assert [r["chunk_id"] for r in one] == ["a", "c"]
    assert retrieval.vector_topk(asked(spark, ("x", [1.0, 0.0])), corpus(spark).limit(0), 2).count() == 0


def test_top_lists_do_not_grow_with_the_number_of_parts(spark, monkeypatch):
    """Forty parts give no more candidates than a few groups do, and the same rows."""
    monkeypatch.setattr(frames, "GROUPS_PER_CORE", 1)
    monkeypatch.setattr(retrieval, "DISTANCES", 640)
    rnd = np.random.default_rng(3)
    vectors = [(f"c{i:03}", [float(x) for x in v]) for i, v in enumerate(rnd.integers(-2, 3, (400, 4)))]
    corpus = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, vectors[i][1]) for i in range(10)], "query_id long, vector array<double>")
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    want = []
    for q in range(10):
        far = sorted((round(1 - float(unit(np.array(vectors[q][1])) @ unit(np.array(v))), 6) + 0.0, name) for name, v in vectors)
        want += [(q, name, d, i) for i, (d, name) in enumerate(far[:5], 1)]
    for parts in (1, 40):
        got = retrieval.vector_topk(asked, corpus.repartition(parts), 5)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    cores = spark.sparkContext.defaultParallelism
    assert frames.in_groups(corpus.repartition(40)).rdd.getNumPartitions() == cores < 40


def test_keyword_search_counts_substrings(spark):
    got = retrieval.keyword_topk(asked(spark, ("travel art policy", None), ("the of", None)), corpus(spark), 5).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["relevance"], 2)) for r in got] == [("a", 0.85), ("c", 0.5), ("d", 0.5)]
    assert {r["chunk_id"] for r in retrieval.keyword_topk(asked(spark, ("travel", None)), corpus(spark), 5, case_insensitive=True).collect()} == {"a", "b", "c"}


def test_rank_fusion(spark):
    lists = spark.createDataFrame([(0, 0, "x", 1, 0.5), (0, 0, "y", 2, 0.4), (0, 1, "y", 1, 0.9), (0, 1, "z", 2, 0.0)], "query_id long, list_no int, chunk_id string, rank int, relevance double")
    got = retrieval.rrf_fuse(lists).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["y", "x", "z"] and got[0]["relevance"] == 0.9 and got[2]["relevance"] == pytest.approx(1 / 62)
    assert {r["chunk_id"]: r["score"] for r in retrieval.rrf_scores(lists).collect()}["y"] == pytest.approx(1 / 62 + 1 / 61)


def test_hybrid_search_filters_access_and_lifts_titles(spark):
    got = retrieval.hybrid_search(asked(spark, ("about leave rules", [1.0, 0.0]), ("of the", [0.0, 1.0])), corpus(spark)).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in got if r["query_id"] == 0] == ["b", "a", "d"] and "c" not in {r["chunk_id"] for r in got}
    assert [(r["chunk_id"], r["relevance"]) for r in got if r["query_id"] == 1] == [("d", 1.0), ("b", 0.6), ("a", 0.0)]
    plain = retrieval.hybrid_search(asked(spark, ("leave", [1.0, 0.0])), corpus(spark), RetrievalConfig(hybrid=False), 1).collect()
    assert len(plain) == 1 and plain[0]["chunk_id"] == "b"


def test_sufficiency(spark):
    found = spark.createDataFrame([(0, "T", "", "alpha text", 0.3), (1, "T", "", "none", 0.3), (2, "T", "", "x", 0.2), (3, "T", "", "x", 0.91)], "query_id long, title string, section string, text string, relevance double")
    rows = retrieval.context_sufficient(found, asked(spark, ("alpha", None), ("beta gamma delta", None), ("alpha", None), ("zeta", None), ("alpha", None)))
    got = {r["query_id"]: (r["sufficient"], r["any_relevant"]) for r in rows.collect()}
    assert got == {0: (True, True), 1: (False, True), 2: (False, False), 3: (True, True), 4: (False, False)}


# Answers


def test_context_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(0, 1, "x" * 50), (0, 2, "y" * 60), (0, 3, "z"), (1, 1, "w" * 500)], "query_id long, rank int, block string")
    assert {(r["query_id"], r["rank"]) for r in answer.context_budget(rows, 100).collect()} == {(0, 1), (1, 1)}


def service(**more):
    chunk = {"title": "T", "url": "u", "section": "s", "relevance": 0.9, "text": "fact"}
    return answer.Answerer(**{"retrieve": lambda q: [chunk, dict(chunk)], "sufficient": lambda c, q: bool(c)} | more)


def test_answers_and_follow_ups():
    queries, prompts = [], []
    own = service(retrieve=lambda q: queries.append(q) or [{"title": "T", "url": "u", "section": "s", "relevance": 0.98765, "text": "fact"}], complete=lambda s, p: prompts.append(p) or "yes")
    assert own.ask("First?", "c") == {"answer": "yes", "sources": [{"title": "T", "url": "u", "section": "s", "relevance": 0.9877}]}
    own.ask("Second?", "c")
    assert queries == ["First?", "Second?\n\nPrevious question in this conversation: First?"] and "Previous answer: yes" in prompts[1] and "User question:\nSecond?" in prompts[1]
    for _ in range(9):
        own.ask("again", "c")
    assert len(own.histories["c"]) == 4


def test_no_model_call_without_context():
    own = service(retrieve=lambda q: [], complete=lambda s, p: pytest.fail("asked"))
    assert own.ask("x") == {"answer": answer.INSUFFICIENT, "sources": []}
    filled = service(retrieve=lambda q: [], fill_gaps=lambda q, c: [{"title": "", "url": "", "section": "", "relevance": 1.0, "text": "got"}])
    assert filled.ask("x")["answer"] == "got"


def test_failures_and_validation():
    def fails(*_):
        raise OSError("down")

    for own in (service(retrieve=fails), service(complete=fails), service(complete=lambda s, p: " ")):
        with pytest.raises(answer.ServiceError):
            own.ask("x")
    for bad in (lambda: answer.validate(" "), lambda: answer.validate("x" * 4001), lambda: answer.validate("x", "i" * 129), lambda: answer.validate("x", None, 21)):
        with pytest.raises(ValueError):
            bad()


def test_conversations(spark):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("system", "s"), ("user", "Q1"), ("assistant", "A1"), ("user", "q1"), ("user", "Q3"), ("assistant", None)])], "conv_id long, turn long, role string, text string")
    turns = conversation.pair_turns(rows)
    assert [tuple(r)[2:] for r in turns.orderBy("turn").collect()] == [("Q1", "A1"), ("q1", ""), ("Q3", "")]
    assert [r["query"] for r in conversation.expanded(turns).orderBy("turn").collect()] == ["Q1", "q1", "Q3\n\nPrevious question in this conversation: q1"]
    assert conversation.tail(turns, 2).count() == 2 and conversation.history_text(turns).first()["history"] == "Previous question: Q3\nPrevious answer: "


# Index


def records(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "chunk_id string, text string, url string, content_hash string, pos long")


SCHEMA = "id string, text string, url string, content_hash string, pos long"


def test_index_refresh(spark, tmp_path):
    own = index.Index(spark, str(tmp_path / "index"), SCHEMA)
    two = records(spark, [("a", "x", "u", "h1"), ("b", "y", "u", "h1")])
    assert own.count() == 0 and own.refresh(two, "full")["upserted"] == 2 and own.count() == 2
    again = own.refresh(two)
    assert (again["upserted"], again["skipped_existing"], again["stale"]) == (0, 2, 0)
    edited = own.refresh(records(spark, [("a", "x2", "u", "h2"), (" ", "z", "u", "h2"), ("a", "dup", "u", "h2"), ("c", "new", "v", "")]))
    assert (edited["upserted"], edited["stale"], edited["skipped_invalid"]) == (2, 2, 2)
    assert {r["id"]: r["text"] for r in own.read().collect()} == {"a": "x2", "c": "new"} and own.peek(1).first()["id"] == "a"
    own.clear()
    assert own.count() == 0 and own.refresh(two, "full")["collection_count"] == 2 and own.manifest()["space"] == "cosine"


def test_rows_without_hash_are_never_stale(spark):
    held = index.normalize_records(records(spark, [("a", "x", "u", ""), ("b", "y", "u", "old"), ("c", "z", "w", "old")]))
    batch = index.normalize_records(records(spark, [("d", "q", "u", "new")]))
    assert {r["id"] for r in index.stale(held, batch).collect()} == {"b"}
    assert {r["id"] for r in index.upsert(held, batch).collect()} == {"a", "b", "c", "d"}
    assert index.get_by_ids(held, batch.unionByName(held.filter("id = 'a'")).select("id")).count() == 1 and index.get_by_metadata(held, url="w").count() == 1
    assert [r["hashes"] for r in index.hashes_by_url(held).orderBy("url").collect()] == [["old"], ["old"]]


# Crawl

HOSTS = ["hub.example.com"]


def brute_crawl(seeds, edges, config):
    queue, queued, order = deque(), set(), []

    def admit(url, depth):
        if "hub.example.com" in url and not url.endswith(".pdf") and depth <= config.max_depth and url not in queued and len(order) + len(queue) < config.max_pages:
            queue.append((url, depth))
            queued.add(url)

    for s in seeds:
        admit(s, 0)
    while queue:
        url, depth = queue.popleft()
        order.append((url, depth))
        for dst in edges.get(url, []):
            admit(dst, depth + 1)
    return order


@pytest.mark.parametrize("seed,config", [(1, CrawlConfig()), (2, CrawlConfig(max_pages=17)), (3, CrawlConfig(max_depth=2)), (4, CrawlConfig(max_pages=1))])
def test_bfs_matches_a_sequential_crawl(spark, seed, config):
    rnd = random.Random(seed)
    name = lambda i: f"https://hub.example.com/p{i}"
    edges = {name(i): [rnd.choice([name(rnd.randrange(80)), name(i), f"https://o.example/{i}", name(i) + ".pdf"]) for _ in range(4)] for i in range(60)}
    rows = spark.createDataFrame([(s, k, d) for s, ds in edges.items() for k, d in enumerate(ds)], "src string, pos long, dst string")
    start = spark.createDataFrame([(0, name(0)), (1, name(1)), (2, name(0))], "pos long, url string")
    got = [(r["url"], r["depth"]) for r in crawl.bfs(start, rows, HOSTS, config).orderBy("order_no").collect()]
    assert got == brute_crawl([name(0), name(1), name(0)], edges, config)


def slow_crawl(seeds, site, known, config):
    """(visited with outcome, decisions) one page at a time; site: url -> list of fetches (status, expired, links)."""
    queue, queued, good, out, said = deque(), set(), 0, [], []

    def offer(url, depth, order, pos):
        if depth > config.max_depth:
            what = "max_depth_exceeded"
        elif url in queued:
            what = "duplicate"
        elif good + len(queue) >= config.max_pages:
            what = "max_pages_budget"
        else:
            what = "queued"
            queue.append((url, depth))
            queued.add(url)
        said.append((order, pos, url, depth, what))

    for i, u in enumerate(seeds):
        offer(u, 0, 0, i)
    while queue and good < config.max_pages:
        url, depth = queue.popleft()
        fetches = site.get(url, [(404, False, [])])
        status, expired, links = next((f for f in fetches if not f[1]), fetches[0])
        outcome = "session_expired" if expired else "access_denied" if status == 403 else "http_error" if status >= 400 else "unchanged" if known.get(url) == "same" else "updated" if url in known else "new"
        out.append((url, depth, outcome))
        good += outcome in ("new", "updated")
        if outcome in ("new", "updated", "unchanged"):
            for k, u in enumerate(dict.fromkeys(links)):
                offer(u, depth + 1, len(out), k)
    return out, said


@pytest.mark.parametrize("seed,config", [(1, CrawlConfig()), (2, CrawlConfig(max_pages=12)), (3, CrawlConfig(max_pages=25, max_depth=2)), (4, CrawlConfig(max_pages=1)), (5, CrawlConfig(max_pages=30))])
def test_crawl_matches_a_sequential_one_with_failures_and_expiries(spark, seed, config):
    rnd = random.Random(seed)
    name = lambda i: f"https://hub.example.com/p{i}"
    site, rows, known = {}, [], {}
    for i in range(70):
        # Many links to few pages, so that ones that were turned away come again.
        links = [name(rnd.choice([rnd.randrange(6), rnd.randrange(90)])) for _ in range(5)]
        body = "<html><title>t</title><body>" + "".join(f'<a href="{u}">x</a>' for u in links) + f"page {i}</body></html>"
        status = rnd.choice([200, 200, 200, 404, 403])
        expired = [(200, True, [])] * rnd.choice([0, 0, 1, 2])
        site[name(i)] = expired + [(status, False, links)] if rnd.random() < 0.9 else [(200, True, [])]
        rows += [(1000 * i + k, name(i), body if not e else "", "https://hub.example.com/login" if e else name(i), st) for k, (st, e, _) in enumerate(site[name(i)])]
        if rnd.random() < 0.4:
            known[name(i)] = rnd.choice(["same", "other"])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, final_url string, status_code int")
    hashes = {r.url: r.content_hash for r in html.extract_pages(pages.filter("html <> ''").dropDuplicates(["url"]), HOSTS).collect()}
    state = spark.createDataFrame([(u, "", hashes.get(u, "x") if k == "same" else "other", "", "", "PROCESSED", "", []) for u, k in known.items()], crawl.STATE)
    seeds = [name(0), name(1), name(0), name(2)]
    start = spark.createDataFrame(list(enumerate(seeds)), "pos long, url string")
    fetched, decided, _ = crawl.crawl(pages, start, state, HOSTS, config)
    want, said = slow_crawl(seeds, site, known, config)
    assert [(r.url, r.depth, r.outcome) for r in fetched.orderBy("order_no").collect()] == want
    assert sorted(tuple(r) for r in decided.select("order_no", "pos", "url", "depth", "decision").collect()) == sorted(said)


def test_running_totals_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(frames, "RANGE_ROWS", 7)
    rnd = random.Random(2)
    values = [(i, rnd.randrange(-5, 9)) for i in range(100)]
    df = spark.createDataFrame(rnd.sample(values, 100), "pos long, v long").repartition(3)
    assert [r.s for r in frames.running(df, ["pos"], "v", "s").orderBy("pos").collect()] == [sum(v for _, v in values[: i + 1]) for i in range(100)]
    got = [r.s for r in frames.running(df, ["pos"], "v", "s", F.min, before=True).orderBy("pos").collect()]
    assert got == [min((v for _, v in values[:i]), default=None) for i in range(100)]
    assert frames.running(df.limit(0), ["pos"], "v", "s").count() == 0


def test_decisions_and_outcomes(spark):
    links = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate([("https://hub.example.com/a", 0), ("https://hub.example.com/a", 1), (None, 0), ("https://o.example/", 0), ("http://hub.example.com/b", 0), ("https://hub.example.com/c.pdf", 0), ("https://hub.example.com/d.js", 0), ("https://hub.example.com/e", 9), ("https://hub.example.com/f", 1)])], "pos long, url string, depth int")
    decided = crawl.decisions(links, HOSTS, CrawlConfig(max_pages=1))
    assert [r["decision"] for r in decided.orderBy("pos").collect()] == ["queued", "duplicate", "invalid", "external", "not_approved_https_url", "document_link", "non_html_asset", "max_depth_exceeded", "max_pages_budget"]
    stats = crawl.stats(decided).first()
    assert (stats["total_pages_discovered"], stats["duplicate_links"], stats["skipped_pages"]) == (1, 1, 5)
    fetched = spark.createDataFrame([(u, f, s, "", h, c) for u, f, s, h, c in [("1", "https://hub.example.com/", 200, "", "n"), ("2", "https://hub.example.com/", 200, "", "same"), ("3", "https://hub.example.com/", 200, "", "new"), ("4", "https://hub.example.com/", 403, "", ""), ("5", "https://hub.example.com/", 500, "", ""), ("6", "https://login.example/", 200, "", ""), ("7", "https://hub.example.com/", None, "Request Access", "")]], "url string, final_url string, status_code int, title string, html string, content_hash string")
    state = spark.createDataFrame([("2", "same"), ("3", "old"), ("1", "")], "url string, content_hash string")
    got = {r["url"]: (r["outcome"], r["status"]) for r in crawl.outcomes(fetched, state, HOSTS).collect()}
    assert got == {"1": ("new", "PROCESSED"), "2": ("unchanged", "SKIPPED"), "3": ("updated", "UPDATED"), "4": ("access_denied", "ACCESS_DENIED"), "5": ("http_error", "FAILED"), "6": ("session_expired", "PROCESSING"), "7": ("access_denied", "ACCESS_DENIED")}
    assert {r["url"]: r["outcome"] for r in crawl.outcomes(fetched, state, HOSTS, "full").collect()}["2"] == "updated"


def state_rows(spark):
    return spark.createDataFrame([(0, "https://hub.example.com/travel", "Travel policy", "h", "", "", "PROCESSED", "", ["https://hub.example.com/t.pdf"]), (1, "https://o.example/travel", "Travel", "", "", "", "PENDING", "", []), (2, "https://hub.example.com/z", "", "", "", "", "FAILED", "", None)], "pos long, " + crawl.STATE)


def test_catalog(spark):
    questions = asked(spark, ("travel policy", None), ("nothing here", None))
    got = crawl.search_catalog(state_rows(spark), questions, HOSTS, 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["url"], r["kind"]) for r in got] == [(0, "https://hub.example.com/travel", "ranked"), (1, "https://o.example/travel", "fallback"), (1, "https://hub.example.com/z", "fallback")]
    alone = crawl.search_catalog(state_rows(spark).limit(0), questions, HOSTS, 10, "https://hub.example.com/").collect()
    assert {r["kind"] for r in alone} == {"start"} and len(alone) == 2
    links = spark.createDataFrame([("https://HUB.example.com/travel#x",), ("https://hub.example.com/travel",), ("https://hub.example.com/policy-travel",)], "url string")
    assert [(r["url"], r["score"]) for r in crawl.rank_urls(links, questions, HOSTS).orderBy("rank").collect()] == [("https://hub.example.com/policy-travel", 2), ("https://hub.example.com/travel", 1)]


def test_state(spark, tmp_path):
    state = state_rows(spark).drop("pos")
    changes = spark.createDataFrame([("https://hub.example.com/z", None, "PROCESSED"), ("new", "T", "PENDING")], "url string, title string, status string")
    got = {r["url"]: r for r in crawl.upsert_state(state, changes, "now").collect()}
    assert got["https://hub.example.com/z"]["status"] == "PROCESSED" and got["https://hub.example.com/z"]["last_updated"] == "now" and got["new"]["title"] == "T" and got["https://hub.example.com/travel"]["last_updated"] == ""
    assert {r["url"] for r in crawl.retry_urls(state).collect()} == {"https://o.example/travel", "https://hub.example.com/z"} and crawl.processed_urls(state).count() == 1
    path = tmp_path / "state.json"
    path.write_text('{"urls": {"k": {"title": "t"}, "x": {"url": "", "title": "gone"}}}')
    assert [(r["url"], r["title"], r["status"]) for r in files.read_state(spark, str(path)).collect()] == [("k", "t", "PENDING")]
    path.write_text("{bad")
    assert files.read_state(spark, str(path)).count() == 0 and files.read_state(spark, str(tmp_path / "none")).count() == 0


def test_seeds(spark):
    got = crawl.seeds(spark, ["https://hub.example.com/b", "bad"], "https://hub.example.com/", state_rows(spark))
    assert [r["url"] for r in got.orderBy("pos").collect()][:2] == ["https://hub.example.com/", "https://hub.example.com/b"] and got.count() == 4
    with pytest.raises(ValueError):
        crawl.seeds(spark, [], "nothing")


# The loop, sources and streams


def test_loop_stops():
    calls = []
    retrieve = lambda q: calls.append(q) or [{"relevance": 0.5}]
    assert loop.fill_gaps("q", [], retrieve, lambda q, n: ["u"], lambda us: 1, seen := set()) == [{"relevance": 0.5}] and len(calls) == 1 and seen == {"u"}
    assert loop.fill_gaps("q", [{"relevance": 0.1}], retrieve, lambda q, n: ["u"], lambda us: 1, seen) == [{"relevance": 0.1}]
    assert loop.fill_gaps("q", [{"relevance": 0.9}], retrieve, None, None, set()) == [{"relevance": 0.9}]

    def broken(_):
        raise OSError

    assert loop.fill_gaps("q", [], retrieve, lambda q, n: ["v"], broken, set()) == []
    low = []
    loop.fill_gaps("q", [], lambda q: low.append(q) or [], lambda q, n: [str(len(low))], lambda us: 1, set())
    assert len(low) == RetrievalConfig().max_iterations


def test_targeted_ingest_and_refresh(spark, tmp_path):
    site = SiteConfig()
    rows = spark.createDataFrame([(1, "https://hub.example.com/x/", PAGE), (2, "https://hub.example.com/y/", PAGE.replace("Guide", "Other"))], "page_id long, url string, html string")
    own = index.Index(spark, str(tmp_path / "i"), SCHEMA)
    assert loop.targeted_ingest(["https://hub.example.com/x/", "https://none"], rows, own, site) == 1 and own.count() >= 1
    assert loop.targeted_ingest([], rows, own, site) == loop.targeted_ingest(["x"], rows, own, site, has_session=False) == 0
    state = spark.createDataFrame([], crawl.STATE)
    after, totals = loop.refresh(rows, state, own, "full", site, "now")
    after = crawl.checkpointed(after)
    assert totals["new_pages"] == 2 and {r["status"] for r in after.collect()} == {"PROCESSED"}
    _, again = loop.refresh(rows, after, own, "incremental", site, "later")
    assert again["unchanged_pages"] == 2 and again["documents_indexed"] == 0


def test_files(spark, tmp_path):
    import os
    import time

    for name in ("crawl_b", "crawl_a"):
        (tmp_path / name / "pages").mkdir(parents=True)
        time.sleep(0.05)
    os.utime(tmp_path / "crawl_a", (1, 1))
    folder = files.page_folder(spark, str(tmp_path))
    assert folder.endswith("crawl_b/pages") and files.page_folder(spark, str(tmp_path / "no")) is None
    (tmp_path / "crawl_b/pages/1.json").write_text('{"url": "u",\n "html": "<p>x"}')
    (tmp_path / "crawl_b/pages/2.json").write_text("{broken")
    good, bad = files.read_pages(spark, folder)
    assert [r["url"] for r in good.collect()] == ["u"] and [r["file"] for r in bad.collect()] == ["2.json"]
    with pytest.raises(FileNotFoundError):
        files.page_folder(spark, str(tmp_path), str(tmp_path / "crawl_x"))
    run = tmp_path / "process_1"
    (run / "documents").mkdir(parents=True)
    (run / "documents/d.json").write_text('{"document_id": "D", "chunks": [{"chunk_id": "c", "text": "t"}, {"chunk_id": "e", "document_id": "own"}]}')
    assert files.process_run(spark, str(tmp_path)).endswith("process_1")
    assert {(r["chunk_id"], r["document_id"]) for r in files.read_chunks(spark, str(run)).collect()} == {("c", "D"), ("e", "own")}
    (run / "chunks.jsonl").write_text('{"chunk_id": "x"}\n\nnot json\n{"chunk_id": "y"}\n')
    assert [r["chunk_id"] for r in files.read_chunks(spark, str(run)).collect()] == ["x", "y"]
    with pytest.raises(FileNotFoundError):
        files.process_run(spark, str(tmp_path / "no"))


def test_calls_are_tried_again_and_failures_are_rows(spark):
    from quern.sources import calls

    class Service:
        """Answers out of order; fails twice on each list that holds `slow`, always on one that holds `bad`, and loses `gap`."""

        def __init__(self):
            self.tries = {}

        def __call__(self, values):
            key = tuple(values)
            self.tries[key] = self.tries.get(key, 0) + 1
            if "bad" in values or "slow" in values and self.tries[key] < 3:
                raise OSError("token=secret")
            return [(i, [len(v), i]) for i, v in reversed(list(enumerate(values))) if v != "gap"]

    texts = ["a", "bb", "slow", "bad", "ccc", None, "gap", "bad", "dddd"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    waits = []
    got = calls.embedded(rows, "text", Service(), "v", batch=4, attempts=3, wait=lambda n: waits.append(n) or 0.0).orderBy("n").collect()
    assert [r.n for r in got] == list(range(27)) and [r.text for r in got] == texts
    assert [r.error for r in got] == [{"bad": "OSError", "gap": "ValueError"}.get(t) for t in texts]
    assert [r.v and r.v[0] for r in got] == [None if t in ("bad", "gap") else float(len(t or "")) for t in texts]
    assert calls.embedded(rows.limit(0), "text", Service()).count() == 0 and [calls.back_off(n) for n in (1, 2, 3, 9)] == [2.0, 4.0, 6.0, 6.0]


def test_page_source(spark):
    rows = spark.createDataFrame([("https://hub.example.com/private/x",), ("https://hub.example.com/y",)], "url string")
    source = pages.TableSource(spark.createDataFrame([("https://hub.example.com/y", "<p>", 1)], "url string, html string, n int"))
    assert sorted((r["url"], r["status_code"]) for r in source.fetch(rows).collect()) == [("https://hub.example.com/private/x", 404), ("https://hub.example.com/y", 200)]
    assert robots.body_of(lambda: (404, "")) is None and robots.body_of(None) is None and robots.body_of(lambda: (200, "x")) == "x" and robots.body_of(lambda: 1 / 0) is None


@pytest.mark.parametrize("agent", ["*", "Crawler/1.0", "other"])
def test_robots_rules_are_those_of_the_standard_parser(spark, agent):
    from urllib.robotparser import RobotFileParser

    rnd = random.Random(12)
    words = ["User-agent: *", "User-agent: crawl", "USER-AGENT : Other # x", "user-agent: bot", "Disallow: /a", "Allow: /a/b", "Disallow:", "Allow: /a%2Fb", "Disallow: /c d", "Disallow: /%63", "Crawl-delay: 3", "", "  ", "# note", "Sitemap: https://x/", "nonsense", "Disallow: *", "Disallow: /a?q=1", "Allow: /é"]
    bodies = [(f"h{i}.example.com", "\n".join(rnd.choices(words, k=rnd.randrange(1, 14)))) for i in range(120)] + [("none.example.com", None)]
    paths = ["", "/", "/a", "/a/b", "/a/b/c", "/a%2fb", "/ab", "/c%20d", "/c", "/a?q=1", "/a?q=2", "/%C3%A9", "/é/x", "/x"]
    links = [f"https://{h}{p}" for h, _ in bodies for p in paths] + ["https://elsewhere.example.com/a"]
    rules = robots.rules_of(spark.createDataFrame(bodies, "host string, body string"), agent)
    got = {r.url: r.allowed for r in robots.allowed(spark.createDataFrame([(u,) for u in links], "url string"), rules).collect()}
    parsers = {}
    for h, body in bodies:
        parsers[h] = RobotFileParser()
        parsers[h].parse((body or "").splitlines())
    want = {u: parsers[h].can_fetch(agent, u) if (h := u.split("/")[2]) in parsers else True for u in links}
    assert {u: (got[u], want[u]) for u in links if got[u] != want[u]} == {}


def test_a_crawl_keeps_to_robots_rules(spark):
    site = spark.createDataFrame([(1, "https://hub.example.com/", '<a href="/a">x</a><a href="/b">y</a>')], "page_id long, url string, html string")
    rules = robots.rules_of(spark.createDataFrame([("hub.example.com", "User-agent: *\nDisallow: /a")], "host string, body string"))
    start = spark.createDataFrame([(0, "https://hub.example.com/")], "pos long, url string")
    fetched, decided, _ = crawl.crawl(site, start, spark.createDataFrame([], crawl.STATE), HOSTS, robots=rules)
    assert [r.url for r in fetched.orderBy("order_no").collect()] == ["https://hub.example.com/", "https://hub.example.com/b"]
    assert {r.url: r.decision for r in decided.collect()}["https://hub.example.com/a"] == "robots_disallowed"


def test_questions_go_through_the_loop_together_as_each_would_alone(spark):
    """With discovered pages of their own, each question ends as the loop for one question leaves it."""
    rnd = random.Random(3)
    pages_of = {q: [[f"u{q}-{s}-{i}" for i in range(rnd.randrange(0, 4))] for s in range(7)] for q in range(12)}
    real = {u for ps in pages_of.values() for p in ps for u in p if rnd.random() < 0.8}
    gain = {u: rnd.choice([0.05, 0.1, 0.5]) for u in real}
    limit = RetrievalConfig().query_time_pages

    def alone(q):
        have, calls = set(), []

        def retrieve(_):
            return [{"relevance": max((gain[u] for u in have if u.startswith(f"u{q}-")), default=0.0)}] if have else []

        def discover(_, n):
            calls.append(1)
            return pages_of[q][len(calls) - 1][:n]

        def ingest(us):
            new = [u for u in us[:limit] if u in real]
            have.update(new)
            return len(new)

        found = loop.fill_gaps("q", [], retrieve, discover, ingest, set())
        return max((c["relevance"] for c in found), default=None), len(have)

    have, step = set(), [0]

    def retrieve(asked):
        ids = [r.query_id for r in asked.collect()]
        best = {q: max((gain[u] for u in have if u.startswith(f"u{q}-")), default=None) for q in ids}
        # A question with ingested pages but none of its own has a chunk of no relevance.
        rows = [(q, "c", b if b is not None else 0.0) for q, b in best.items() if have]
        return spark.createDataFrame(rows, "query_id long, chunk_id string, relevance double")

    def discover(asked, n):
        step[0] += 1
        return spark.createDataFrame([(r.query_id, i, u) for r in asked.collect() for i, u in enumerate(pages_of[r.query_id][step[0] - 1][:n])], "query_id long, rank int, url string")

    def ingest(wanted):
        new = [r.url for r in wanted.collect() if r.url in real]
        have.update(new)
        return spark.createDataFrame([(u,) for u in new], "url string")

    questions = spark.createDataFrame([(q, f"q{q}") for q in range(12)], "query_id long, question string")
    answers, found, seen = loop.fill_gaps_together(questions, retrieve, discover, ingest, spark.createDataFrame([], "url string"))
    got = {r.query_id: (r.best, r.ingested, r.enough) for r in answers.collect()}
    for q in range(12):
        best, n = alone(q)
        assert (got[q][0] or 0.0, got[q][1]) == (best or 0.0, n) and got[q][2] == ((best or 0.0) >= 0.28)
    assert len(got) == 12 and seen.count() > 0 and {r.query_id for r in found.collect()} <= set(got)


@pytest.mark.parametrize("when", ["at once", "as rows are read"])
@pytest.mark.parametrize("step", [1, 2])
def test_a_failed_ingestion_is_no_answer(spark, when, step):
    """Neither in the first step, which would look like nothing found, nor after one that brought pages."""
    calls = []

    def ingest(wanted):
        calls.append(1)
        if len(calls) < step:
            return wanted
        if when == "at once":
            raise OSError("store is gone")
        return wanted.select(F.raise_error(F.lit("store is gone")).cast("string").alias("url"))

    questions = spark.createDataFrame([(0, "a"), (1, "b")], "query_id long, question string")
    retrieve = lambda asked: asked.select("query_id", F.lit("c").alias("chunk_id"), F.lit(0.1).alias("relevance"))
    discover = lambda asked, n: asked.select("query_id", F.lit(0).alias("rank"), F.concat(F.lit(f"u{len(calls)}-"), "question").alias("url"))
    with pytest.raises(Exception, match="store is gone"):
        loop.fill_gaps_together(questions, retrieve, discover, ingest, spark.createDataFrame([], "url string"))
    assert len(calls) == step


def test_many_questions_are_answered_or_refused(spark):
    questions = spark.createDataFrame([(0, "travel policy"), (1, "travel policy"), (2, "pay")], "query_id long, question string")
    rows = [(0, 1, "c1", "Travel", "u1", "s", 0.9, "travel policy text\nmore"), (0, 2, "c2", "Travel", "u1", "s", 0.8, "again"), (1, 1, "c3", "T", "u", "", 0.1, "low")]
    found = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, title string, url string, section string, relevance double, text string")
    asked = []
    got = {r.query_id: (r.refused, r.answer, r.n_sources) for r in answer.answers(questions, found).collect()}
    assert got == {0: (False, "travel policy text", 1), 1: (True, answer.INSUFFICIENT, 0), 2: (True, answer.INSUFFICIENT, 0)}
    says = {r.query_id: r.answer for r in answer.answers(questions, found, lambda system, prompt: f"{'Ground' in prompt} {len(system) > 9}").collect()}
    assert says[0] == "True True" and says[1] == answer.INSUFFICIENT and asked == []
    check = spark.createDataFrame([(None, "a", 1), ("x" * 4001, "a", 1), ("x", "a" * 129, 1), ("x", None, 21), (" x ", "a", 20)], "m string, c string, k int")
    assert [r[0] for r in check.select(answer.verdict(F.col("m"), F.col("c"), F.col("k"))).collect()] == ["a message has 1 to 4000 characters"] * 2 + ["a conversation id has 128 characters at most", "top_k is from 1 to 20", "ok 1"]


def test_cells_find_near_vectors_of_clusters_in_few_probes(spark, tmp_path):
    rnd = np.random.default_rng(2)
    middle = rnd.normal(size=(12, 16))
    vectors = [(i, f"c{i:03}", (middle[i % 12] + 0.1 * rnd.normal(size=16)).tolist() if i % 50 else None) for i in range(600)]
    corpus = spark.createDataFrame(vectors, "id long, chunk_id string, embedding array<double>")
    centres = cells.fit_centres(corpus, 12)
    indexed = cells.index_cells(corpus, centres, str(tmp_path / "cells"))
    assert indexed.count() == 588 and indexed.select("cell").distinct().count() <= 12
    asked = corpus.filter("id % 20 = 1").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = retrieval.vector_topk(asked, corpus, 5)
    few, every = (cells.vector_topk_cells(asked, indexed, centres, 5, p) for p in (2, 12))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    figures = cells.recall(few, exact).first()
    assert figures["n_exact"] == 150 and figures["n_met"] >= 135
    assert cells.vector_topk_cells(asked.limit(0), indexed, centres, 5, 2).count() == 0


# Whole frames


def test_terms_meet_texts(spark):
    rnd = random.Random(4)
    texts = [(f"t{i:02}", i, "".join(rnd.choices("abc ", k=60))) for i in range(50)]
    terms = sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 4))) for _ in range(25)})
    rows = spark.createDataFrame(texts, "key string, pos long, body string").repartition(5)
    got = frames.first_holders(spark.createDataFrame([(x,) for x in terms], "term string"), rows, 3)
    expected = [(x, k, p, n) for x in terms for n, (k, p, _) in enumerate([r for r in texts if x in r[2]][:3], 1)]
    assert sorted(tuple(r) for r in got.select("term", "key", "pos", "nth").collect()) == sorted(expected)
    asked = [(q, rnd.sample(terms, 5) if q else []) for q in range(6)]
    best = frames.best_holders(spark.createDataFrame(asked, "query_id long, terms array<string>"), rows, 4)
    want = []
    for q, own in asked:
        scores = sorted((-sum(x in body for x in own), key) for key, _, body in texts)
        want += [(q, key, -s, n) for n, (s, key) in enumerate(scores[:4], 1) if s]
    assert sorted(tuple(r) for r in best.select("query_id", "key", "score", "rank").collect()) == sorted(want)


def test_deep_pages_do_not_recurse():
    deep = "<div>" * 3000 + "core" + "</div>" * 3000 + "<ul><li>x" * 2000
    page = dom.parse(deep)
    assert html.visible_text(page).splitlines()[0] == "core" and html.clean(deep)["cleaned_text"]
    nested = dom.parse("<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ul>").first("ul")
    assert html.list_text(nested, "") == "- a \n1. b\n2. c\n- d"


def test_index_keeps_what_was_live_if_a_write_breaks_off(spark, tmp_path):
    own = index.Index(spark, str(tmp_path / "i"), "id string, text string, url string, content_hash string, pos long")
    rows = spark.createDataFrame([("a", "x", "u", "h", 0), ("b", "y", "u", "g", 1)], "chunk_id string, text string, url string, content_hash string, pos long")
    own.refresh(rows)
    (tmp_path / "i" / "_manifest-1.json").write_text("{")  # a manifest that was never renamed
    (tmp_path / "i" / "data-0").mkdir()
    assert own.count() == 2 and own.manifest()["live"] == 0
    own.refresh(rows.filter("chunk_id = 'a'"), "full")
    assert own.count() == 1 and own.manifest()["live"] == 1
    gone = own.vacuum(1)
    assert len(gone) == 2 and "data-0" in gone and own.count() == 1
    own.clear()
    assert own.count() == 0


def test_a_refresh_writes_the_buckets_that_it_touches(spark, tmp_path):
    """One percent of the records changes: a few buckets are written, the rest stays in its folders, and the rows are those of a plain refresh."""
    own = index.Index(spark, str(tmp_path / "i"), SCHEMA, buckets=64)
    rows = [(f"c{i}", f"text {i}", f"u{i // 2}", f"h{i // 2}") for i in range(1000)]
    own.refresh(records(spark, rows), "full")
    before = own.manifest()["folders"]
    plain = index.normalize_records(records(spark, rows))
    edited = [(f"c{i}", f"new {i}", f"u{i // 2}", "new") for i in range(100, 108)] + [("d1", "more", "v", "h"), ("d2", "more", "v", "h")]
    figures = own.refresh(records(spark, edited))
    after = own.manifest()["folders"]
    moved = {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)}
    assert (figures["stale"], figures["upserted"], figures["collection_count"]) == (8, 10, 1002)
    assert 1 <= len(moved) <= 10 and len(before) == 64
    want = index.incremental(plain, records(spark, edited))
    got = sorted((r.id, r.text, r.url, r.content_hash) for r in own.read().collect())
    assert got == sorted((r.id, r.text, r.url, r.content_hash) for r in want[0].collect())
    assert figures == want[1].first().asDict()
    # A bucket that loses all its records is no longer named; a second writer on an old state fails and changes nothing.
    own.write(own.read({0}).limit(0), {0})
    assert "0" not in own.manifest()["folders"] and own.read({0}).count() == 0
    n, old = own.count(), own._manifests()[:-1]
    with pytest.raises(RuntimeError):
        own.write(own.read(), None, old)
    assert own.count() == n


def test_configuration():
    assert config.read_env("# c\nA=1\nexport B = 'x y'\n\nC=\"q\n") == {"A": "1", "B": "x y", "C": '"q'}
    assert config.run_name("crawl", datetime(2024, 1, 2, 3, 4, 5)) == "crawl_20240102_030405" and config.utc_now(datetime(2024, 1, 2)) == "2024-01-02T00:00:00"
    assert config.auth_selectors("a, b") == ("a", "b") and len(config.auth_selectors("")) == 14


def test_crawl_command(spark, tmp_path, capsys):
    from quern.__main__ import main

    pages = [(0, "https://hub.example.com/", '<title>Home</title><a href="/a">a</a><a href="/gone">g</a><a href="https://o.example/">o</a>'), (1, "https://hub.example.com/a", "<title>A</title><p>text</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "p.parquet"))
    run = str(tmp_path / "run")
    assert main(["crawl", str(tmp_path / "p.parquet"), run]) == 0
    assert json.loads(capsys.readouterr().out)["successfully_crawled_pages"] == 2
    got, bad = files.read_pages(spark, f"{run}/pages")
    assert {r["page_title"] for r in got.collect()} == {"Home", "A"} and bad.count() == 0
    assert {r["url"]: r["status"] for r in files.read_state(spark, f"{run}/state").collect()} == {"https://hub.example.com/": "PROCESSED", "https://hub.example.com/a": "PROCESSED", "https://hub.example.com/gone": "FAILED"}
    assert main(["crawl", str(tmp_path / "p.parquet"), run]) == 0
    assert json.loads(capsys.readouterr().out)["unchanged_pages"] == 2
    (tmp_path / ".env").write_text("QUERN_MAX_DEPTH=0\n")
    assert main(["crawl", str(tmp_path / "p.parquet"), str(tmp_path / "other"), "--env", str(tmp_path / ".env")]) == 0
    assert json.loads(capsys.readouterr().out)["successfully_crawled_pages"] == 1


def test_one_question_and_many_get_the_same_prompt(spark):
    chunk = {"title": "T", "url": "u", "section": "s", "relevance": 0.5, "text": "body"}
    asked: list[str] = []
    answer.Answerer(lambda q: [chunk], lambda c, q: True, lambda system, prompt: asked.append(prompt) or "yes").ask("What?")
    found = spark.createDataFrame([(1, 1, "T", "u", "s", 0.5, "body")], "query_id long, rank int, title string, url string, section string, relevance double, text string")
    many = answer.prompts(spark.createDataFrame([(1, "What?")], "query_id long, question string"), found)
    assert asked == [r["prompt"] for r in many.collect()]


@pytest.mark.parametrize("stripe_texts", [4096, 10])
def test_gram_index_finds_what_a_walk_finds(spark, tmp_path, monkeypatch, stripe_texts):
    rnd = random.Random(8)
    monkeypatch.setattr(grams, "FIRST_STRIPES", 2)
    monkeypatch.setattr(grams, "GATHERED", 500)
    monkeypatch.setattr(grams, "TAKEN", 1)
    monkeypatch.setattr(grams, "TIMES", 2)
    texts = [(f"t{i:03}", rnd.choice([i, i, i // 3, None]), rnd.choice(["ABC", "é", ""]) + "".join(rnd.choices("ab- c", k=rnd.randrange(40)))) for i in range(150)]
    texts += [("n1", 7, None), ("n2", 8, ""), ("n3", 9, "ab"), ("n4", 200, "rare-term here"), ("n4", 200, "rare-term here")]
    terms = sorted({"".join(rnd.choices("ab-c", k=rnd.randrange(3, 6))) for _ in range(40)} | {"rare-term", "abc", "none-such", "zzz"})
    rows = spark.createDataFrame(texts, "key string, pos long, body string").repartition(5)
    own = grams.GramIndex.build(rows, str(tmp_path / "g"), buckets=8, stripe_texts=stripe_texts)
    asked = spark.createDataFrame([(x,) for x in terms], "term string")
    order = lambda r: (r[1] is not None, r[1] or 0, r[0])
    want = [(x, k, p, n) for x in terms for n, (k, p, _) in enumerate([r for r in sorted(texts, key=order) if r[2] and x in r[2]][:3], 1)]
    got = [tuple(r) for r in own.first_holders(asked, rows, 3).select("term", "key", "pos", "nth").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert own.first_holders(asked.limit(0), rows, 3).count() == 0
    with pytest.raises(ValueError):
        own.first_holders(spark.createDataFrame([("ab",)], "term string"), rows, 3)


def test_gram_index_opens_the_buckets_of_asked_grams_alone(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), i, f"word{i} filler text") for i in range(300)], "key string, pos long, body string")
    own = grams.GramIndex.build(rows, str(tmp_path / "g"), buckets=16, stripe_texts=50)
    lists = own.asked(["word"], 0, 1, 16)
    buckets = {int(g) % 16 for g in grams.grams("word")}
    assert {r.bucket for r in lists.select("bucket").distinct().collect()} == buckets and {r.stripe for r in lists.select("stripe").distinct().collect()} == {0, 1}
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_keyword_search_is_the_same_with_and_without_an_index(spark, tmp_path):
    rnd = random.Random(1)
    words = ["travel", "policy", "leave", "holiday", "pay", "Travel"]
    own = spark.createDataFrame([(f"c{i}", " ".join(rnd.choices(words, k=4)), "travel", f"u{i}", "", "authenticated", i) for i in range(60)], "chunk_id string, text string, title string, url string, section string, access string, pos long")
    asked = spark.createDataFrame([(0, "travel policy"), (1, "holiday pay leave"), (2, "of the")], "query_id long, question string")
    for fold in (False, True):
        lists = grams.GramIndex.build(retrieval.keyword_texts(own, fold), str(tmp_path / f"g{fold}"), stripe_texts=16)
        with_, without = (sorted(map(tuple, retrieval.keyword_topk(asked, own, 5, case_insensitive=fold, index=i).collect())) for i in (lists, None))
        assert with_ == without and with_


def test_words_of_texts_are_looked_at_once(monkeypatch):
    monkeypatch.setattr(frames, "KEPT_RUNS", 3)
    rng = random.Random(11)
    words = [*{"".join(rng.choices("ab-1", k=rng.randint(1, 3))) for _ in range(30)}]
    for own in (words, [*words, "a b"]):
        met = frames._met(own)
        for _ in range(60):
            body = "".join(rng.choices("ab-1 \nÄB", k=40))
            assert {own[i] for i in met(body)} == {w for w in own if w in body}


def test_a_chunks_text_meets_its_questions_packed(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PACKED", 3)
    chunks = spark.createDataFrame([("a", "Red Fox", "the fox ran-off"), ("b", "", "Ärgern 12"), ("c", "x", "y")], "chunk_id string, title string, text string")
    terms = [["red", "fox"], ["ran"], ["gern", "fox", "off"], []]
    hits = spark.createDataFrame([(q, c, (q, 1), terms[q % 4]) for q in range(20) for c in "ab"], "query_id long, chunk_id string, first_pos struct<term_no:int,nth:int>, terms array<string>")
    got = retrieval._overlaps(chunks, hits)
    bodies = {"a": "red fox the fox ran-off", "b": " ärgern 12"}
    want = [(q, c, (q, 1), sum(t in bodies[c] for t in terms[q % 4])) for q in range(20) for c in "ab"]
    assert sorted((r.query_id, r.chunk_id, tuple(r.first_pos), r.overlap) for r in got.collect()) == sorted(want)


def test_words_with_their_places_are_met_no_more(monkeypatch):
    sizes = []
    real = frames.automaton
    monkeypatch.setattr(frames, "automaton", lambda words, *numbers: sizes.append(len(words)) or real(words, *numbers))
    rng = random.Random(3)
    words = [*{"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(80)}]
    texts = [(f"k{i:03}", i, "".join(rng.choices("abc -", k=30))) for i in range(400)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "pos", "body"), r)) for r in texts[at : at + 50]]) for at in range(0, 400, 50)]
    for own in (words, ["a", "b"], [*words, "nowhere"]):
        sizes.clear()
        got = [tuple(r.values()) for b in frames._firsts(own, 3)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted((w, k, p) for w in own for k, p, _ in [r for r in texts if w in r[2]][:3])
        assert own == ["a", "b"] or (len(sizes) > 1 and sizes == sorted(sizes, reverse=True) and sizes[-1] < len(own))


@pytest.mark.parametrize("few", [2, 300])
def test_terms_are_counted_as_far_as_they_matter(monkeypatch, few):
    """A chunk's terms are looked for until a question has enough; no more looks than distinct terms, the same relevance."""
    monkeypatch.setattr(retrieval, "FEW_TERMS", few)
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(40)]
    body = " ".join(words[:30])
    asked = [rng.sample(words, rng.randint(0, 12)) for _ in range(200)]
    batch = pa.RecordBatch.from_pylist([{"chunk_id": "c", "title": "t", "body": body, "asked": [{"query_id": q, "term_no": 0, "nth": 1, "terms": " ".join(own)} for q, own in enumerate(asked)]}])
    exact = [sum(w in body for w in own) for own in asked]
    for most in (None, retrieval.ENOUGH_TERMS):
        got = [n for b in retrieval._counted(most)(iter([batch])) for n in b.column("overlap").to_pylist()]
        assert got == (exact if most is None else [min(n, most) for n in exact])
    base = lambda n: min(1.0, 0.35 + 0.15 * n)
    assert base(retrieval.ENOUGH_TERMS) == 1.0 and max(exact) > retrieval.ENOUGH_TERMS > min(exact)


@pytest.mark.parametrize("head", [1, 10**9])
def test_common_terms_are_looked_for_in_the_earliest_texts(spark, monkeypatch, head):
    """Terms that have their places in the earliest texts don't go to the others; places and ties are the same either way."""
    monkeypatch.setattr(frames, "HEAD_LEAST", head)
    asked, real = [], frames._firsts
    monkeypatch.setattr(frames, "_firsts", lambda words, k: asked.append(sorted(words)) or real(words, k))
    texts = [(f"t{i:02}", None if i < 2 else i // 2, "common" + (" seldom" if i % 30 == 1 else "") + (" late" if i > 90 else "")) for i in range(96)]
    rows = spark.createDataFrame(texts, "key string, pos long, body string").repartition(5)
    got = frames.first_holders(spark.createDataFrame([(x,) for x in ("common", "seldom", "late", "nowhere")], "term string"), rows, 4)
    want = [(x, k, p, n) for x in ("common", "seldom", "late") for n, (k, p, _) in enumerate([r for r in texts if x in r[2]][:4], 1)]
    assert sorted(map(tuple, got.select("term", "key", "pos", "nth").collect()), key=repr) == sorted(want, key=repr)
    assert asked[1:] == ([["late", "nowhere", "seldom"]] if head == 1 else [])


@pytest.mark.parametrize("sample", [8, 4096])
def test_few_pairs_of_vectors_are_worked_out_and_ties_stay(spark, monkeypatch, sample):
    """A sample tells how near the best are, so few candidates leave the tasks; like vectors, zeros and near ties are ranked as before."""
    monkeypatch.setattr(retrieval, "SAMPLE", sample)
    monkeypatch.setattr(retrieval, "DISTANCES", 1 << 10)
    rnd = np.random.default_rng(7)
    rows = [*rnd.normal(size=(600, 8)), *np.tile(rnd.normal(size=8), (300, 1)), *np.zeros((5, 8))]
    names = [f"c{i * 7919 % 905:04}" for i in range(905)]
    matrix = np.array([v / (np.linalg.norm(v) or 1) for v in rows])
    asked = [0, 1, 700, 903]
    want = []
    for q in asked:
        far = sorted(zip((np.round(1 - matrix @ matrix[q], 6) + 0.0).tolist(), names))
        want += [(q, name, d, n) for n, (d, name) in enumerate(far[:6], 1)]
    corpus = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, rows)], "chunk_id string, embedding array<double>")
    found = retrieval.vector_topk(spark.createDataFrame([(q, rows[q].tolist()) for q in asked], "query_id long, vector array<double>"), corpus, 6)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    floors = next(retrieval._floors(matrix, 6)(iter([pa.RecordBatch.from_pydict({"query_id": asked, "vector": [rows[q].tolist() for q in asked]})]))).column("floor").to_numpy()
    batch = pa.RecordBatch.from_pydict({"chunk_id": sorted(names), "embedding": [rows[i].tolist() for i in np.argsort(names)]})
    ids, none = np.array(asked), np.full(len(asked), -np.inf)
    out = [next(retrieval._nearest(ids, matrix[asked], low, 6)(iter([batch]))).to_pylist() for low in (floors, none)]
    assert out[0] == out[1]
    tasks = [next(retrieval._nearest(ids[:2], matrix[asked[:2]], floors[:2], 6)(iter([batch.slice(at, 5)])), None) for at in range(0, 905, 5)]
    assert sum(b.num_rows for b in tasks if b) < 181 * 2  # without floors each would give back all of its rows


def test_many_terms_of_a_chunk_are_met_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FEW_TERMS", 2)
    monkeypatch.setattr(retrieval, "ROWS_OUT", 7)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcde", k=rng.randint(3, 4))) for _ in range(30)]
    bodies = [(f"c{i}", f"T{i}", " ".join(rng.choices(words, k=6)).title()) for i in range(9)]
    chunks = spark.createDataFrame(bodies, "chunk_id string, title string, text string")
    terms = [rng.sample(sorted({*words}), i % 5) for i in range(40)]
    rows = [(q, f"c{q % 9 if q < 30 else 0}", (q, 1), terms[q]) for q in range(40)]
    got = retrieval._overlaps(chunks, spark.createDataFrame(rows, "query_id long, chunk_id string, first_pos struct<term_no:int,nth:int>, terms array<string>"))
    low = {c: f"{t} {x}".lower() for c, t, x in bodies}
    want = [(q, c, f"T{c[1:]}", sum(t in low[c] for t in own)) for q, c, _, own in rows]
    assert sorted((r.query_id, r.chunk_id, r.title, r.overlap) for r in got.collect()) == sorted(want)


def test_best_holders_of_many_like_texts(spark, monkeypatch):
    monkeypatch.setattr(frames, "TEXTS", 5)
    rng = random.Random(5)
    words = ["red", "fox", "ran", "off", "x y"]
    texts = [(f"k{i:03}", " ".join(rng.choices(words[: 2 + i % 4], k=rng.randint(0, 3)))) for i in range(200)]
    asked = [(q, rng.sample(words, rng.randint(1, 4))) for q in range(12)] + [(12, [f"n{i}" for i in range(299)] + ["red"])]
    rows = spark.createDataFrame(texts, "key string, body string").repartition(3)
    got = {(r.query_id, r["rank"], r.key, r.score) for r in frames.best_holders(spark.createDataFrame(asked, "query_id long, terms array<string>"), rows, 4).collect()}
    scored = {q: sorted((-n, k) for k, b in texts if (n := sum(t in b for t in own))) for q, own in asked}
    assert got == {(q, i, k, -n) for q, own in scored.items() for i, (n, k) in enumerate(own[:4], 1)}


def test_a_task_works_on_a_few_rows_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    sizes = [b.num_rows for b in frames.in_slices(lambda b: b, 4)(iter([pa.record_batch({"x": list(range(10))}), pa.record_batch({"x": [1]})]))]
    assert sizes == [4, 4, 2, 1]
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", f"<title>{i}</title><p>text") for i in range(150)], "page_id long, url string, html string").coalesce(1)
    assert {(r.page_key, r.title) for r in html.extract_pages(pages, ["a.example"]).collect()} == {(i, str(i)) for i in range(150)}
