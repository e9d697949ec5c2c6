"""Web payloads as tables: sitemaps, robots files, wiki and blog listings, links of pages, robots rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Path endings and paragraphs that are left out.
SKIPPED_FILES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".css", ".js", ".pdf", ".zip", ".mp4", ".mp3", ".xml", ".json")
SKIPPED_PAGES = ("/tag", "/category", "/author", "/login", "/wp-admin")
NOTICES = ("Copyright", "All Rights Reserved", "सर्वाधिकार सुरक्षित")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def paragraphs(html: Column, least: int = 25, least_body: int = 200) -> Column:
    """Paragraph texts of a page that are long enough and no notices, joined by blank lines; null for short bodies."""
    bare = F.regexp_replace(html, r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", "")
    bare = F.regexp_replace(bare, r"(?is)<!--.*?-->", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    plain = F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]+>", " "), r"\s+", " ")))
    kept = F.filter(plain, lambda p: (F.length(p) > least) & ~any_of([p.contains(x) for x in NOTICES]))
    body = F.array_join(kept, "\n\n")
    return F.when(F.length(body) >= least_body, body)


def body_text(html: Column, primary: Callable[[Column], Column] | None = None) -> Column:
    """A page's text by an extractor of one's own, and where it gives none, by its paragraphs."""
    return F.coalesce(primary(html), paragraphs(html)) if primary else paragraphs(html)


def page_links(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """key, link, place: links of a page to its own host that look like articles, each once, in the order met.

    Relative ones are joined to the page's folder; `./` and `../` (up to three) are taken out.
    """
    base = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.col(url), r"[?#].*$", ""), r"[^/]*$", "")
    found = pages.select(
        key, base.alias("base"), folder.alias("folder"),
        F.posexplode(
            F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href=["']([^"'#\s]+)["']"""), F.lit(1))
        ).alias("place", "href")
    )
    full = (
        F.when(F.col("href").rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.regexp_extract("base", "^(https?:)", 1), "href"))
        .when(F.col("href").startswith("/"), F.concat("base", "href"))
        .otherwise(F.concat("folder", "href"))
    )
    clean = F.regexp_replace(F.regexp_replace(full, r"[?#].*$", ""), r"/(?:\./)+", "/")
    for _ in range(3):
        clean = F.regexp_replace(clean, r"(?<=[^/:]/)(?!\.\./)[^/]+/\.\./", "")
    links = found.select(key, "base", "place", clean.alias("link"))
    path = F.expr("substring(link, length(base) + 1)")
    own = (F.regexp_extract("link", r"^(https?://[^/]+)", 1) == F.col("base")) & (F.length(path) > 1)
    links = links.filter(own & ~any_of([F.col("link").endswith(x) for x in (*SKIPPED_FILES, *SKIPPED_PAGES)]))
    return links.groupBy(key, "link").agg(F.min("place").alias("place"))


def sitemap_links(payloads: DataFrame, body: str = "body") -> DataFrame:
    """link, nested: locations of sitemaps, feeds and malformed files; nested ones are sitemaps again. First place each."""
    found = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<(?:\w+:)?(?:loc|link)>\s*(?:<!\[CDATA\[)?\s*([^<\s\]]+)"), F.lit(1))
    links = payloads.select(
        F.col(body).rlike("(?i)<(?:\\w+:)?sitemapindex").alias("index"), F.posexplode(found).alias("place", "link")
    )
    lower = F.lower("link")
    nested = F.col("index") | lower.endswith(".xml") | lower.endswith(".xml.gz") | lower.contains("sitemap")
    return links.groupBy("link").agg(F.min("place").alias("place"), F.max(nested).alias("nested"))


def robots_sitemaps(robots: DataFrame, body: str = "body") -> DataFrame:
    return robots.select(
        F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("link")
    ).distinct()


def robots_rules(robots: DataFrame, host: str = "host", body: str = "body", agent: str = "*") -> DataFrame:
    """host, path, allow: the rules of the group for one agent."""
    group = F.regexp_extract(
        F.concat(F.lit("\n"), F.col(body), F.lit("\n")),
        rf"(?is)\n\s*user-agent:\s*{'[*]' if agent == '*' else agent}\s*\n(.*?)(?=\n\s*user-agent:|$)", 1
    )
    lines = robots.select(host, F.explode(F.split(group, "\n")).alias("line"))
    return lines.select(
        host, F.regexp_extract("line", r"(?i)^\s*(?:dis)?allow:\s*(\S*)", 1).alias("path"),
        (~F.col("line").rlike(r"(?i)^\s*disallow:")).alias("allow")
    ).filter(F.col("line").rlike(r"(?i)^\s*(dis)?allow:") & (F.col("path") != ""))


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with `allowed`: the longest rule that begins the path decides; without one, or for unknown hosts, yes."""
    host, path = F.regexp_extract(url, r"^https?://([^/?#]+)", 1), F.regexp_replace(url, r"^https?://[^/?#]+", "")
    found = urls.withColumn("_host", host).withColumn("_path", F.when(path == "", "/").otherwise(path)).alias("u")
    met = found.join(
        rules.alias("r"), (F.col("u._host") == F.col("r.host")) & F.col("u._path").startswith(F.col("r.path")), "left"
    )
    verdict = F.max_by("r.allow", F.struct(F.length("r.path"), F.col("r.allow")))
    return met.groupBy(*(F.col(f"u.{c}").alias(c) for c in urls.columns)).agg(F.coalesce(verdict, F.lit(True)).alias("allowed"))


def wiki_titles(payloads: DataFrame, root: str, body: str = "body") -> DataFrame:
    """Page URLs of a wiki's allpages listing."""
    kind = "query struct<allpages: array<struct<title: string>>>"
    title = F.explode(F.from_json(body, kind)["query"]["allpages"]["title"]).alias("title")
    return payloads.select(title).select(
        F.concat(
            F.lit(root.rstrip("/") + "/"), F.regexp_replace(F.url_encode(F.regexp_replace("title", " ", "_")), r"\+", "%20")
        ).alias("url")
    )


def title_of(url: Column) -> Column:
    """A wiki page's title by its URL."""
    return F.regexp_replace(F.url_decode(F.regexp_extract(url, r"([^/]*)$", 1)), "_", " ")


def wiki_next(payloads: DataFrame, body: str = "body") -> DataFrame:
    """The token with which a listing goes on, null on its last page."""
    return payloads.select(F.get_json_object(body, "$.continue.apcontinue").alias("next"))


def wiki_texts(payloads: DataFrame, body: str = "body", least: int = 200) -> DataFrame:
    """Plain-text extracts of an API payload that are long enough."""
    pages = F.map_values(
        F.from_json(body, "query struct<pages: map<string, struct<title: string, extract: string>>>")["query"]["pages"]
    )
    return payloads.select(F.explode(pages).alias("p")).select(
        "p.title", F.col("p.extract").alias("text")
    ).filter(F.length("text") >= least)


def blog_posts(payloads: DataFrame, body: str = "body") -> DataFrame:
    return payloads.select(F.explode(F.from_json(body, "array<struct<link: string>>")["link"]).alias("url"))


def link_crawl(roots: DataFrame, links: DataFrame, depth: int = 2, most: int | None = None) -> DataFrame:
    """url, depth: what links(source, target) reach from roots(url) in at most depth steps, at its first depth."""
    seen = roots.select("url").distinct().withColumn("depth", F.lit(0))
    edge = seen
    for k in range(1, depth + 1):
        edge = links.join(
            edge.select(F.col("url").alias("source")), "source"
        ).select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(edge)
    return seen.orderBy("depth", "url").limit(most) if most else seen


def discovered(found: list[tuple[int, DataFrame]], most: int, enough: int = 50) -> DataFrame:
    """url, rank: results of strategies in their order of preference, each URL once, the first `most`.

    The next strategy counts only while those before it gave fewer than `enough` URLs.
    """
    seen = None
    for rank, df in found:
        if seen is not None and seen.limit(enough).count() >= enough:
            break
        own = df.select("url").distinct().withColumn("rank", F.lit(rank))
        seen = own if seen is None else seen.unionByName(own.join(seen.select("url"), "url", "left_anti"))
    return seen.orderBy("rank", "url").limit(most)


def archive_path(url: Column) -> Column:
    """Two-level folder of a raw page's archive file, by hash of its URL."""
    h = F.md5(url)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit(".html.gz"))
