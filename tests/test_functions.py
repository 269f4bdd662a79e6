import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import ChunkConfig, CrawlConfig, ModelConfig, SiteConfig, from_environment, hybrid_stopwords
from quern.functions import embedding, text, tokens, urls
from quern.operators import chunking

ODD = [None, "", "  ", "a  b", " x　", "İstanbul ΣΑΣ", "🎉 é", "x\x1cy", "A  B\t\nC"]


def values(spark, column, texts=ODD):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_hash_ignores_white_space_and_case(spark):
    expected = [hashlib.sha256(re.sub(r"\s+", " ", (t or "").strip()).lower().encode()).hexdigest() for t in ODD]
    assert values(spark, text.content_hash("t")) == expected
    assert len(set(values(spark, text.content_hash("t"), ["Hello  World", " hello\nworld ", "hello world"]))) == 1


def test_slugs_and_ids(spark):
    texts = ["Hello, World!", "--", None, "É x" + "y" * 100]
    assert values(spark, text.slugify("t"), texts) == [_slug(t or "") or "chunk" for t in texts]
    digest = hashlib.sha1(b"u|H|12|body").hexdigest()[:12]
    row = spark.range(1).select(text.chunk_id(F.lit("u"), F.lit("H"), F.lit(12), F.lit("body")), text.chunk_id(F.lit("u"), F.lit(""), F.lit(12345), F.lit("body")), text.document_id(F.lit("https://a.b/c"), F.lit(""))).first()
    assert row[0] == f"h-0012-{digest}" and row[1].startswith("intro-12345-") and row[2] == "https-a.b-c-https-a.b-c"


def _slug(t):
    return re.sub(r"[^a-zA-Z0-9._-]+", "-", t.strip().lower()).strip("-")[:80]


def test_terms(spark):
    assert values(spark, text.query_terms("t"), ["What is the Travel-policy for travel-policy and go x1y?", None]) == [["travel-policy", "x1y"], []]
    assert "whom" not in hybrid_stopwords("My Hub") and "hub" in hybrid_stopwords("My Hub")
    assert values(spark, text.keywords("t", hybrid_stopwords("My Hub"), 2), ["hub alpha beta gamma"]) == [["alpha", "beta"]]
    assert values(spark, text.term_hits("t", F.array(F.lit("art"), F.lit("zzz"))), ["Party", None]) == [1, 0]


def test_tokens(spark):
    texts = ["", "a", "abcd", "abcde", "é" * 401, None]
    assert values(spark, text.count_tokens("t"), texts) == [0, 1, 1, 2, 101, 0]
    assert values(spark, text.truncate_to_tokens("t", 100), texts) == ["", "a", "abcd", "abcde", "é" * 400, None]
    assert values(spark, text.overlap_suffix("t", 1), texts) == ["", "a", "abcd", "bcde", "é" * 4, ""]
    assert values(spark, text.overlap_suffix("t", 0), ["abc"]) == [""]


def test_relevance_and_access(spark):
    rows = spark.createDataFrame([(None, None), (0.2, " Authorized "), (1.7, ""), (-1.0, "denied")], "d double, a string").coalesce(1)
    assert [tuple(r) for r in rows.select(text.relevance("d"), text.authorized("a")).collect()] == [(0.0, True), (0.8, True), (0.0, True), (1.0, False)]


def test_white_space_and_footers(spark):
    from quern.operators.html import is_boilerplate, tidy

    texts = ["a  b\n\n\n\nc \n \n\n d", "", " x ", "a\r\nb c", "\n\n"]
    assert values(spark, text.normalize_whitespace("t"), texts) == [tidy(t) for t in texts]
    footers = ["© 2020 me", "(c) x", "All Rights Reserved", "x" * 119 + " copyright", "© a\nb", " ", "plain"]
    assert values(spark, text.is_footer_boilerplate("t"), footers) == [is_boilerplate(t) for t in footers] == [True, True, True, False, False, True, False]


def test_links_and_secrets(spark):
    assert [tuple(x) for x in values(spark, text.markdown_links("t"), ["[a](http://x) [b](ftp://y) [c d](https://z/q)"])[0]] == [("a", "http://x"), ("c d", "https://z/q")]
    got = values(spark, text.redact("t"), ["token=abc Authorization: Bearer xyz", "bearer abc", "fine"])
    assert got == ["token=*** Authorization=*** xyz", "bearer ***", "fine"]
    got = values(spark, text.safe_error(F.lit("KeyError"), "t"), ["api_key: 1 sk-abcdefgh12", None])
    assert got == ["KeyError: api_key=*** ***", "KeyError: KeyError"]
    assert values(spark, text.configured("t"), ["x", " ", "replace_with_key", None]) == [True, False, False, False]


URLS = [
    ("https://Hub.Example.com/A//b/#top", "https://hub.example.com/A/b/"), ("http://h_b.example:80?q=1", "http://h_b.example/?q=1"), ("https://u:p@h.example:8443/x;v=1?a#b", "https://h.example:8443/x?a"),
    ("HTTPS://H.example:443", "https://h.example/"), ("mailto:x@y", None), ("ftp://x/y", None), ("  ", None), (None, None), ("/rel", None), ("https://", None), ("https://h.example:99999/", None), ("https://h.example:x/", None),
]


def test_urls(spark):
    from quern.operators.html import normalize_reference

    assert values(spark, urls.normalize_url("t"), [u for u, _ in URLS]) == [e for _, e in URLS]
    assert [normalize_reference(u or "", "") for u, _ in URLS] == [e for _, e in URLS]
    base = F.lit("https://h.example/a/b?x#y")
    refs = ["c", "../d", "//o.example/z", "?q=2", "#f", "javascript:x", "https://k.example"]
    assert values(spark, urls.resolve_url(base, "t"), refs) == ["https://h.example/a/c", "https://h.example/d", "https://o.example/z", "https://h.example/a/b?q=2", "https://h.example/a/b?x", None, "https://k.example/"]


def test_url_classes(spark):
    hosts = ["hub.example.com"]
    texts = ["https://hub.example.com/a.PDF", "http://hub.example.com/x", "https://x.example/a.js", "https://hub.example.com/login/x", "https://hub.example.com/a?b=.pdf", None]
    columns = [urls.is_internal("t", hosts), urls.is_allowed("t", hosts), urls.is_document("t"), urls.is_probably_html("t"), urls.looks_like_login("t", hosts), urls.log_path("t")]
    got = [values(spark, c, texts) for c in columns]
    assert got[0] == [True, True, False, True, True, False] and got[1] == [True, False, False, True, True, False]
    assert got[2] == [True, False, False, False, False, False] and got[3] == [False, True, False, True, True, True]
    assert got[4] == [False, False, True, True, False, True] and got[5] == ["/a.PDF", "/x", "/a.js", "/login/x", "/a", "/"]
    assert values(spark, urls.looks_like_login("t", []), ["https://x.example/oauth"]) == [True]
    assert values(spark, urls.looks_like_sign_in_title("t"), [" Sign In to x", "", "home"]) == [True, False, False]
    denied = urls.looks_like_denied(F.lit(200), F.lit("u"), F.lit(""), F.col("t"))
    assert values(spark, denied, ["x" * 2000 + "access denied", "You don't have access", None]) == [False, True, False]
    assert values(spark, urls.looks_like_denied(F.lit(403), F.lit(""), F.lit(""), F.col("t")), [""]) == [True]
    assert values(spark, urls.page_slug("t"), ["https://h.example/a b?c"])[0].startswith("h.example_a_b_c_")


def test_embeddings(spark):
    for t, d in (("hello", 32), ("", 16), ("é" * 50, 16)):
        slots = [0.0] * d
        for i, b in enumerate(t.encode()):
            slots[i % d] += (b % 31) / 31.0
        norm = sum(x * x for x in slots) ** 0.5 or 1.0
        assert np.allclose(embedding.hash_vector(t, d), [x / norm for x in slots])
    assert len(values(spark, embedding.hash_embedding("t", 16), ["abc"])[0]) == 16
    assert values(spark, embedding.embed("t", lambda xs: [[float(len(x))] for x in xs], 2), ["a", "bb", None]) == [[1.0], [2.0], [0.0]]
    with pytest.raises(Exception, match="asked for"):
        values(spark, embedding.embed("t", lambda xs: []), ["a"])
    assert embedding.provider("hash") and embedding.provider("other") and pytest.raises(ValueError, embedding.provider, "other", True)


def test_configs():
    assert SiteConfig.hosts_from(" A.x, ,b.Y", "") == ("a.x", "b.y") and SiteConfig.hosts_from(None, "https://C.z/") == ("c.z",)
    assert from_environment(ChunkConfig, "CHUNK", {"CHUNK_SIZE": "900"}).size == 900
    assert ChunkConfig(500, 50).warnings() and not ChunkConfig().warnings()
    assert ModelConfig("azure", "m", "d").embedding_model() == "d" and ModelConfig("x", "m", "d").embedding_model() == "m"
    for bad in (lambda: ChunkConfig(10, 10), lambda: CrawlConfig(mode="some")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("size,overlap", [(5, 2), (1, 0), (7, 6), (400, 10)])
def test_windows_have_exactly_so_many_tokens(size, overlap):
    """Each window is a run of whole tokens of the text, `size` long but for the last, and steps on by size less overlap."""
    import public_tokenizers

    rnd = random.Random(size)
    kinds = (tokens.Characters(3), tokens.Pattern(), tokens.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    texts = ["", " ", "one", "Naïve 🎉🎉 日本語 text", "x" * 50] + [" ".join(rnd.choice(["word", "Straße", "🎉", "a\n\nb", "1234"]) for _ in range(rnd.randrange(120))) for _ in range(20)]
    for ends in kinds:
        for text in texts:
            at = ends(text).tolist()
            assert at == sorted(at) and (not at or at[-1] == len(text))
            walk, i = [], 0
            while i < len(at):
                walk.append(text[(at[i - 1] if i else 0) : at[min(len(at), i + size) - 1]])
                if i + size >= len(at):
                    break
                i += size - overlap
            assert tokens.windows(text, size, overlap, ends) == walk
            assert tokens.truncate(text, size, ends) == (text if len(at) <= size else text[: at[size - 1]])
            assert tokens.suffix(text, size, ends) == (text if len(at) <= size else text[at[-size - 1] :]) and tokens.suffix(text, 0, ends) == ""


def test_tokens_are_the_librarys(spark):
    import public_tokenizers
    import tiktoken

    ends = tokens.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ranks = tokens._encoding(ends.path, ends.pattern)
    assert isinstance(ranks, tiktoken.Encoding)
    texts = ["Hello there, general.", "日本語🎉", "", None, "a" * 99]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.n for r in rows.select("i", tokens.count("text", ends).alias("n")).orderBy("i").collect()]
    assert got == [len(ranks.encode_ordinary(t or "")) for t in texts]
    config = ChunkConfig(20, 5, 3)
    long = "\n\n".join(f"Paragraph {i} of some length, with numbers {i * i}." for i in range(40))
    pieces = chunking.split(long, config, ends)
    assert len(pieces) > 5 and all(len(ends(p)) <= config.size for p in pieces) and all(f"Paragraph {i} of" in "\n".join(pieces) for i in range(40))
    docs = spark.createDataFrame([("https://hub.example.com/x", "T", long)], "url string, title string, cleaned_text string").withColumn("blocks", F.lit(None).cast("array<struct<kind:string,text:string,heading:string,section:string,level:int>>"))
    chunks = chunking.chunk_documents(docs, config, ends=ends).collect()
    assert [(c.text, c.token_count) for c in chunks] == [(p, len(ends(p))) for p in pieces]


def test_text_for_a_hash_is_gone_through_once(spark):
    odd = "\u00a0\u2003 a \t\u2028B\x1c\u3000"
    rows = spark.createDataFrame([(odd,), (" \n",), ("",), (None,), ("x",)], "t string")
    got = rows.select(text.normalize_for_hash("t").alias("n"))
    assert [r.n for r in got.collect()] == ["a b", "", "", "", "x"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
