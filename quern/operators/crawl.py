"""Crawling as relations: admission of links, outcomes of fetches, state of pages, and the frontier level by level.

Pages come from a supplied table; nothing here touches a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import CrawlConfig
from quern.functions import urls
from quern.functions.text import blank, query_terms
from quern.operators.frames import best_holders, checkpointed, running, small, union

STATUSES = ("PENDING", "PROCESSING", "PROCESSED", "UPDATED", "FAILED", "ACCESS_DENIED", "SKIPPED")
STATE = "url string, title string, content_hash string, last_scraped string, last_updated string, status string, error string, document_links array<string>"


def admission(url: Column, depth: Column, hosts: Iterable[str], max_depth: int = CrawlConfig().max_depth, robots: Column | None = None) -> Column:
    """What becomes of a link, by the first rule that fits; the caller looks for duplicates and minds the page budget."""
    hosts = list(hosts)
    robots = F.lit(True) if robots is None else robots
    # As a lambda's variable the URL's own expression is worked out once and not for each rule.
    return F.element_at(F.transform(F.array(url), lambda u: _rules(u, depth, hosts, max_depth, robots)), 1)


def _rules(url: Column, depth: Column, hosts: list[str], max_depth: int, robots: Column) -> Column:
    return (
        F.when(url.isNull(), "invalid")
        .when(~urls.is_internal(url, hosts), "external")
        .when(~urls.is_allowed(url, hosts), "not_approved_https_url")
        .when(urls.is_document(url), "document_link")
        .when(~urls.is_probably_html(url), "non_html_asset")
        .when(~robots, "robots_disallowed")
        .when(depth > max_depth, "max_depth_exceeded")
        .otherwise("candidate")
    )


def decisions(links: DataFrame, hosts: Iterable[str], config: CrawlConfig = CrawlConfig(), robots: Column | None = None) -> DataFrame:
    """links (pos, url, depth) with decision, in order of pos: a candidate's first occurrence is `queued` while the budget
    lasts, or `max_pages_budget`; one that is queued already is a `duplicate`."""
    rows = links.withColumn("decision", admission(F.col("url"), F.col("depth"), hosts, config.max_depth, robots))
    candidate = F.col("decision") == "candidate"
    # The first max_pages of distinct candidates; a sort with a limit, as few as the budget.
    firsts = rows.filter(candidate).groupBy("url").agg(F.min("pos").alias("first_pos")).orderBy("first_pos").limit(config.max_pages)
    rows = rows.join(small(checkpointed(firsts)), "url", "left")
    # Beyond the budget nothing is queued, so a later occurrence runs into the budget again.
    decided = F.when(~candidate, F.col("decision")).when(F.col("first_pos") == F.col("pos"), "queued").when(F.col("first_pos").isNotNull(), "duplicate").otherwise("max_pages_budget")
    return rows.select("pos", "url", "depth", decided.alias("decision"))


def stats(decided: DataFrame) -> DataFrame:
    """One row of counters; external and document links count once for each URL, the rest each time."""
    when = lambda d: F.col("decision") == d
    n = lambda d: F.count_if(when(d))
    skipped = ("not_approved_https_url", "document_link", "non_html_asset", "robots_disallowed", "max_depth_exceeded", "max_pages_budget")
    return decided.agg(
        n("queued").alias("total_pages_discovered"),
        F.count_distinct(F.when(when("external"), F.col("url"))).alias("external_links"),
        F.count_distinct(F.when(when("document_link"), F.col("url"))).alias("document_links"),
        n("duplicate").alias("duplicate_links"),
        F.count_distinct(F.when(when("duplicate"), F.col("url"))).alias("duplicate_urls"),
        n("non_html_asset").alias("non_html_skipped"),
        n("robots_disallowed").alias("robots_blocked"),
        n("max_depth_exceeded").alias("max_depth_reached"),
        F.count_if(F.col("decision").isin(*skipped)).alias("skipped_pages"),
    )


def outcomes(fetched: DataFrame, state: DataFrame, hosts: Iterable[str], mode: str = "incremental") -> DataFrame:
    """fetched (url, final_url, status_code, title, html, content_hash, ...) with outcome and the status it leads to."""
    before = state.select("url", F.col("content_hash").alias("old_hash"))
    rows = fetched.join(before, "url", "left")
    known = blank("old_hash") != ""
    same = known & (F.col("old_hash") == F.col("content_hash")) & F.lit(mode == "incremental")
    outcome = (
        F.when(urls.looks_like_login(F.col("final_url"), hosts), "session_expired")
        .when(F.col("status_code").isin(401, 403), "access_denied")
        .when(F.col("status_code") >= 400, "http_error")
        .when(urls.looks_like_denied(F.col("status_code"), F.col("final_url"), F.col("title"), F.col("html")), "access_denied")
        .when(same, "unchanged")
        .when(known, "updated")
        .otherwise("new")
    )
    rows = rows.withColumn("outcome", outcome)
    status = F.create_map(*(F.lit(x) for pair in (("session_expired", "PROCESSING"), ("access_denied", "ACCESS_DENIED"), ("http_error", "FAILED"), ("unchanged", "SKIPPED"), ("updated", "UPDATED"), ("new", "PROCESSED")) for x in pair))
    return rows.withColumn("status", F.element_at(status, F.col("outcome")))


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("outcome").isin("new", "updated")).alias("successfully_crawled_pages"), F.count_if(F.col("outcome") == "new").alias("new_pages"), F.count_if(F.col("outcome") == "updated").alias("updated_pages"),
        F.count_if(F.col("outcome") == "unchanged").alias("unchanged_pages"), F.count_if(F.col("outcome").isin("access_denied", "http_error")).alias("failed_pages"), F.count_if(F.col("outcome") == "session_expired").alias("session_expired"),
    )


def upsert_state(state: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """state with the non-null fields of changes; last_updated is `now` where a change doesn't give it."""
    given = set(changes.columns)
    new = changes.select("url", *(F.col(c).alias(f"n_{c}") for c in changes.columns if c != "url"), F.lit(True).alias("hit"))
    rows = state.join(new, "url", "full_outer")
    blanks = {"status": F.lit("PENDING"), "document_links": F.array().cast("array<string>")}
    fields = [f for f in state.columns if f != "url"]
    out = []
    for c in fields:
        start = blanks.get(c, F.lit(""))
        if c == "last_updated":
            fresh = F.coalesce("n_last_updated", F.col(c), start) if "last_updated" in given else F.lit(now)
            out.append(F.when(F.col("hit"), fresh).otherwise(F.coalesce(F.col(c), start)).alias(c))
        elif c in given:
            out.append(F.coalesce(f"n_{c}", F.col(c), start).alias(c))
        else:
            out.append(F.coalesce(F.col(c), start).alias(c))
    return rows.select("url", *out)


def retry_urls(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status").isin("FAILED", "PENDING", "PROCESSING")).select("url")


def processed_urls(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status").isin("PROCESSED", "UPDATED")).select("url")


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def is_unchanged(old_hash: Column, new_hash: Column) -> Column:
    return F.coalesce((blank(old_hash) != "") & (old_hash == new_hash), F.lit(False))


def rank_catalog(state: DataFrame, questions: DataFrame, hosts: Iterable[str], limit: int = 10) -> DataFrame:
    """(query_id, rank, url, score) of state's internal pages by how many of a question's terms their title, URL and documents hold.

    Questions are a stated set that goes to the tasks in blocks; each task keeps its best pages for a question.
    """
    url = F.coalesce(urls.normalize_url("url"), F.col("url"))
    rows = state.filter(urls.is_internal("url", hosts)).select(url.alias("url"), "title", "document_links")
    rows = rows.select("url", F.concat_ws(" ", blank("title"), "url", F.array_join("document_links", " ")).alias("haystack"))
    return _ranked(rows, questions, limit)


def rank_urls(links: DataFrame, questions: DataFrame, hosts: Iterable[str], limit: int = 10) -> DataFrame:
    url = F.coalesce(urls.normalize_url("url"), F.col("url"))
    rows = links.filter(urls.is_internal("url", hosts)).select(url.alias("url")).distinct()
    return _ranked(rows.withColumn("haystack", F.col("url")), questions, limit)


def _ranked(rows: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    asked = questions.select("query_id", query_terms("question").alias("terms"))
    found = best_holders(asked, rows.select(F.col("url").alias("key"), F.lower("haystack").alias("body")), limit)
    return found.select("query_id", "rank", F.col("key").alias("url"), "score")


def search_catalog(state: DataFrame, questions: DataFrame, hosts: Iterable[str], limit: int = 10, start_url: str | None = None) -> DataFrame:
    """Ranked pages; for questions without any, the first `limit` pending or failed pages in store order; else the start URL.

    state has pos, its store order. Ranked URLs that are not keys of state are left out.
    """
    known, questions = state.select("url").distinct(), questions.select("query_id", "question")
    ranked = checkpointed(rank_catalog(state, questions, hosts, limit))
    ranked = ranked.join(known, "url", "left_semi").select("query_id", "rank", "url", F.lit("ranked").alias("kind"))
    idle = state.filter(F.col("status").isin("PENDING", "FAILED")).orderBy("pos").limit(limit)
    idle = idle.select(F.row_number().over(Window.orderBy("pos")).alias("rank"), "url")
    missed = questions.select("query_id").join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    # idle has `limit` rows at most.
    fallback = missed.join(F.broadcast(idle), F.lit(True)).select("query_id", "rank", "url", F.lit("fallback").alias("kind"))
    out = ranked.unionByName(fallback)
    if start_url:
        left = questions.select("query_id").join(out.select("query_id").distinct(), "query_id", "left_anti")
        out = out.unionByName(left.select("query_id", F.lit(1).alias("rank"), F.lit(start_url).alias("url"), F.lit("start").alias("kind")))
    return out


def seeds(spark: SparkSession, given: list[str], start_url: str, state: DataFrame | None = None, mode: str = "incremental") -> DataFrame:
    """(pos, url): the start URL first unless it is given, then what is given, then pages to retry; ValueError if none is valid."""
    asked = spark.createDataFrame([(i, u) for i, u in enumerate([start_url, *given])], "pos int, raw string").select("pos", urls.normalize_url("raw").alias("url")).filter("url IS NOT NULL")
    rows = [r for r in asked.orderBy("pos").collect()]  # the caller's own list
    start = next((r["url"] for r in rows if r["pos"] == 0), None)
    order = [r["url"] for r in rows if r["pos"] > 0]
    order = order if start is None or start in order else [start, *order]
    if not order:
        raise ValueError(f"no valid URL to start from: {start_url}")
    out = spark.createDataFrame([(i, u) for i, u in enumerate(order)], "pos long, url string")
    if state is not None and mode == "incremental":
        again = retry_urls(state).select((F.lit(1 << 40) + F.monotonically_increasing_id()).alias("pos"), "url")
        out = out.unionByName(again)
    return out


#: Outcomes that count against the page budget, and those whose links are followed.
SUCCESSES = ("new", "updated")
FOLLOWED = ("new", "updated", "unchanged")

Visit = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def bfs(seed: DataFrame, edges: DataFrame, hosts: Iterable[str], config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """(url, depth, order_no): pages that a breadth-first crawl visits if every fetch is a success, in its order.

    seed: (pos, url); edges: (src, pos, dst).
    """

    def visit(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = edges.join(small(level.select(F.col("url").alias("src"), "order_no")), "src").select("order_no", F.col("pos").cast("long").alias("pos"), F.col("dst").alias("url"))
        return level.withColumn("outcome", F.lit("new")), links

    return walk(seed, visit, hosts, config)[0].select("url", "depth", "order_no")


def walk(seed: DataFrame, visit: Visit, hosts: Iterable[str], config: CrawlConfig = CrawlConfig(), robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fetched, decided) of a breadth-first crawl, level by level, equal to a sequential one.

    visit(level) fetches pages (url, depth, order_no): it gives them with `outcome`, and the links (order_no, pos, url) of
    those whose links are followed. A link is queued while successes and waiting pages are fewer than the budget, so each
    fetch that is no success frees a place for the links that come after it, also for one that was turned away before.
    decided: (order_no, pos, url, depth, decision) of each link and seed (order_no 0). robots: rules as robots.rules_of has them.
    """
    from quern.sources.robots import allowed

    hosts = list(hosts)
    links = seed.select(F.lit(0).cast("long").alias("order_no"), F.col("pos").cast("long").alias("pos"), "url", F.lit(0).cast("long").alias("freed"))
    fetched, decided, queued, freed, depth = [], [], 0, 0, 0
    while True:
        links = allowed(links, robots) if robots is not None else links.withColumn("allowed", F.lit(True))
        rows = checkpointed(links.withColumn("decision", admission(F.col("url"), F.lit(depth), hosts, config.max_depth, F.col("allowed"))))
        offers = rows.filter("decision = 'candidate'")
        if fetched:
            offers = offers.join(union([f.select("url") for f in fetched]), "url", "left_anti")
        # While no place is freed, a link that was turned away stays so: its first offer at each number of freed places will do.
        offers = checkpointed(offers.groupBy("url", "freed").agg(F.min(F.struct("order_no", "pos")).alias("place")))
        taken = checkpointed(_taken(offers, config.max_pages - queued))
        n = taken.count()
        decided.append(_decided(rows, taken, [f.select("url") for f in fetched], depth))
        if not n:
            break
        level = running(taken.select("url", F.lit(depth).alias("depth"), "place", F.lit(1).alias("one")), ["place"], "one", "nth")
        pages, found = visit(checkpointed(level.select("url", "depth", (F.col("nth") + queued).alias("order_no"))))
        pages = checkpointed(pages)
        lost = running(pages.select("order_no", (~F.col("outcome").isin(*SUCCESSES)).cast("long").alias("lost")), ["order_no"], "lost", "freed")
        links = found.join(small(checkpointed(lost.select("order_no", (F.col("freed") + freed).alias("freed")))), "order_no")
        fetched.append(pages)
        queued, depth = queued + n, depth + 1
        freed += pages.filter(~F.col("outcome").isin(*SUCCESSES)).count()
    return (union(fetched) if fetched else visit(_no_level(seed))[0]), union(decided)


def _no_level(seed: DataFrame) -> DataFrame:
    return seed.select("url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("order_no")).limit(0)


def _decided(rows: DataFrame, taken: DataFrame, seen: list[DataFrame], depth: int) -> DataFrame:
    """What became of a level's links: the offer that was taken is queued, those after it are duplicates."""
    rows = rows.join(small(taken.select("url", F.col("place").alias("at"))), "url", "left")
    if seen:
        rows = rows.join(small(checkpointed(union(seen)).withColumn("known", F.lit(True))), "url", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    place = F.struct("order_no", "pos")
    what = F.when(F.col("decision") != "candidate", F.col("decision")).when(F.col("known") | (place > F.col("at")), "duplicate").when(place == F.col("at"), "queued").otherwise("max_pages_budget")
    return rows.select("order_no", "pos", "url", F.lit(depth).alias("depth"), what.alias("decision"))


def _taken(offers: DataFrame, room: int) -> DataFrame:
    """(url, place) of what is queued of offers (url, freed, place), in order of place, `room` places and the freed ones being there.

    A queue of bounded room that offers come to one by one, none leaving: offer t is taken if its room less t is not below
    the least such number before it, or 0. That holds for offers that are no repeats. So the first offer of each URL comes
    first; one that is turned away brings the URL's next offer, one that is taken makes the later ones void, until
    nothing changes. Each round is right up to a later place than the one before.
    """
    firsts = offers.groupBy("url").agg(F.min(F.struct("place", "freed")).alias("o")).select("url", "o.place", "o.freed", F.lit(0).alias("k"))
    asked = checkpointed(firsts)
    if asked.count() <= room + (asked.agg(F.min("freed")).first()[0] or 0):
        return asked.select("url", "place")
    while True:
        rows = running(asked.withColumn("one", F.lit(1)), ["place"], "one", "t")
        rows = rows.withColumn("spare", F.greatest(F.lit(0), F.col("freed") + room) - F.col("t"))
        rows = running(rows, ["place"], "spare", "least", F.min, before=True)
        rows = checkpointed(rows.select("url", "place", "freed", "k", (F.col("spare") >= F.least(F.lit(0), "least")).alias("ok")))
        won = rows.filter("ok").groupBy("url").agg(F.min("k").alias("won"))
        rows = rows.join(won, "url", "left").filter("won IS NULL OR k <= won")
        last = rows.filter("won IS NULL").groupBy("url").agg(F.max("k").alias("k"), F.max("freed").alias("last"))
        more = offers.join(last, "url").filter("freed > last").groupBy("url").agg(F.min(F.struct("place", "freed", (F.col("k") + 1).alias("k"))).alias("o")).select("url", "o.*")
        before, kept = asked.count(), rows.select("url", "place", "freed", "k", "won")
        more, kept = checkpointed(more), checkpointed(kept)
        if more.isEmpty() and kept.count() == before:
            return kept.filter("k = won").select("url", "place")
        asked = checkpointed(kept.select("url", "place", "freed", "k").unionByName(more))


def requeue(frontier: DataFrame, fetched: DataFrame) -> DataFrame:
    """frontier (url, order_no, ...) after a session was renewed: pages whose fetch (url, outcome) met an expired one come first again."""
    expired = fetched.filter("outcome = 'session_expired'").select("url", F.lit(0).alias("again")).distinct()
    rows = frontier.join(expired, "url", "left").withColumn("again", F.coalesce("again", F.lit(1)))
    rows = running(checkpointed(rows.withColumn("one", F.lit(1))), ["again", "order_no"], "one", "nth")
    return rows.withColumn("order_no", F.col("nth").cast("long")).drop("again", "one", "nth")


def crawl(
    pages: DataFrame, seed: DataFrame, state: DataFrame, hosts: Iterable[str], config: CrawlConfig = CrawlConfig(), robots: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fetched, decided, links) of a breadth-first crawl over a page source pages (page_id, url, html, and final_url and status_code if it has them).

    fetched: the visited URLs in order with what their page gave and its outcome, a page that the source lacks being a 404;
    decided: what became of each link that was found on them; links: (src, pos, dst). Rows of one URL are what its fetches
    give, in order of page_id: one that met an expired session is made again at once, as requeue has it, so the first other
    row counts, and only if all met one is the outcome session_expired; `renewals` says how many did before. Pages
    are read and parsed only for the URLs that a level visits.
    """
    from quern.operators import html

    hosts = list(hosts)
    url = F.coalesce(urls.normalize_url("url"), F.col("url")).alias("url")
    final = F.col("final_url") if "final_url" in pages.columns else url
    code = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    normal = pages.select("page_id", url, "html", final.alias("final_url"), code.cast("int").alias("status_code"))
    expired = urls.looks_like_login(F.col("final_url"), hosts)
    edges = []

    def visit(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = small(level)
        own = normal.join(asked.select("url"), "url", "left_semi").withColumn("expired", expired)
        first = F.min_by(F.struct("page_id", "html", "final_url", "status_code"), F.struct("expired", "page_id")).alias("p")
        got = checkpointed(own.groupBy("url").agg(first, F.count_if("expired").alias("renewals")).select("url", "p.*", "renewals"))
        done = html.extract_pages(got.select("page_id", "url", "html"), hosts).select("url", "title", "headings", "visible_text", "links", "content_hash")
        rows = level.join(got, "url", "left").join(done, "url", "left")
        rows = rows.select(
            "url", "depth", "order_no", F.coalesce("final_url", "url").alias("final_url"), F.coalesce("status_code", F.lit(404)).alias("status_code"), blank("title").alias("title"),
            "headings", "visible_text", "links", blank("html").alias("html"), "content_hash", F.coalesce("renewals", F.lit(0)).alias("renewals"),
        )
        rows = checkpointed(outcomes(rows, state, hosts, config.mode))
        found = rows.filter(F.col("outcome").isin(*FOLLOWED)).select("order_no", "url", F.posexplode("links").alias("pos", "l"))
        edges.append(found.select(F.col("url").alias("src"), "pos", F.col("l.url").alias("dst")))
        return rows, found.select("order_no", F.col("pos").cast("long").alias("pos"), F.col("l.url").alias("url"))

    fetched, decided = walk(seed, visit, hosts, config, robots)
    return fetched, decided, union(edges)
