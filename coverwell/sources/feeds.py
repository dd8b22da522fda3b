"""Feed bodies to items: hardened XML, both RSS and Atom, with a row for every reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverwell.functions import wires
from coverwell.functions.text import html_text, split_outlet
from coverwell.operators import bylines, filters

BODY_CAP = 4 * 1024 * 1024
ENTRIES = 80
_ITEM = "title string, link string, author string, creator string, pubDate string, description string, source string"
_ENTRY = "title string, published string, updated string, summary string, author struct<name:string>, link struct<_href:string>"
SCHEMA = f"struct<channel:struct<item:array<struct<{_ITEM.replace(' string', ':string')}>>>,entry:array<struct<{_ENTRY.replace('author struct', 'author:struct').replace('link struct', 'link:struct').replace(' string', ':string')}>>>"


def verdict(body: Column) -> Column:
    """Why a body is not parsed, or null: over the cap in bytes, or a document type that declares entities."""
    hostile = body.rlike(r"(?is)<!DOCTYPE[^>]*<!ENTITY|<!DOCTYPE[^>]*\[.*?<!ENTITY")
    return F.when(body.isNull(), "missing").when(F.octet_length(body) > BODY_CAP, "too-large").when(hostile, "entities")


def parsed(feeds: DataFrame) -> DataFrame:
    """``feeds`` (feed_id, body) with reject and doc; rejected bodies are never parsed."""
    judged = feeds.withColumn("reject", verdict(F.col("body")))
    doc = F.from_xml(F.when(F.col("reject").isNull(), F.col("body")), SCHEMA)
    return judged.withColumn("doc", doc)


def items(feeds: DataFrame, most: int = ENTRIES) -> DataFrame:
    """(feed_id, pos, headline, source, author, url, published, snippet): the first ``most`` entries of every feed."""
    docs = parsed(feeds).where("doc is not null")
    rss = docs.select("feed_id", F.posexplode(F.slice("doc.channel.item", 1, most)).alias("pos", "i")).select(
        "feed_id", "pos", "i.title", F.coalesce("i.creator", "i.author").alias("author"), F.col("i.link").alias("url"),
        F.col("i.pubDate").alias("published"), F.col("i.description").alias("body"), F.col("i.source").alias("named"),
    )
    atom = docs.select("feed_id", F.posexplode(F.slice("doc.entry", 1, most)).alias("pos", "i")).select(
        "feed_id", "pos", "i.title", F.col("i.author.name").alias("author"), F.col("i.link._href").alias("url"),
        F.coalesce("i.published", "i.updated").alias("published"), F.col("i.summary").alias("body"), F.lit(None).cast("string").alias("named"),
    )
    cut = split_outlet(F.col("title"))
    return rss.unionByName(atom).select(
        "feed_id", "pos", cut["headline"].alias("headline"), F.coalesce("named", cut["outlet"]).alias("source"), "author", "url",
        safe_time(F.col("published")).alias("published_at"), F.substring(html_text(F.coalesce("body", F.lit(""))), 1, 300).alias("snippet"),
    )


def safe_time(text: Column) -> Column:
    """A time in one of the formats that feeds use, else null."""
    formats = ("EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", ""), " (GMT|UTC|UT)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats[1:]])


_PARTS = "title:string,summary:string,content:string,author:string,"
_RSS = f"struct<{_PARTS}link:string,creator:string,pubDate:string,description:string,encoded:string,source:string>"
_ATOM = "struct<title:string,summary:string,content:string,published:string,updated:string,author:struct<name:string>,link:struct<_href:string>>"
SCAN = f"struct<channel:struct<item:array<{_RSS}>>,entry:array<{_ATOM}>>"


def scan(feeds: DataFrame, most: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(items, health) of fetched feeds (feed_id, status, body): the valid items of the first ``most`` entries, RSS before Atom, and a row a feed.

    Names are read without their prefixes. A title is decoded and cut into headline and outlet, the feed's id standing in for an outlet; the
    snippet is the first of description, summary, encoded and plain content that has any; credits are judged, and stay null where they name no
    person. A feed fails by its status, a body that is missing, too large, hostile or not XML; its health row says why, and counts entries and
    valid items of the others. Items need a headline of over 15 characters and a usable link.
    """
    judged = feeds.select("feed_id", "status", "body", verdict(F.col("body")).alias("reject"))
    http = F.when(F.coalesce("status", F.lit(0)) != 200, F.concat(F.lit("http "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    judged = judged.withColumn("why", F.coalesce(http, F.col("reject")))
    xml = F.col("body").rlike(r"^\s*<") & F.col("body").rlike(r"</(rss|feed|RDF)\s*>\s*\z")
    judged = judged.withColumn("why", F.coalesce("why", F.when(~xml, "not a feed")))
    doc = F.from_xml(F.when(F.col("why").isNull(), F.col("body")), SCAN, {"ignoreNamespace": "true"})
    docs = judged.select("feed_id", "why", doc.alias("doc"))
    first = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(""))
    entry = lambda title, url, author, at, body: F.struct(
        F.trim(title).alias("title"), url.alias("url"), author.alias("author"), at.alias("at"), body.alias("body")
    )
    none = F.array().cast("array<struct<title:string,url:string,author:string,at:string,body:string>>")
    rss = F.transform("doc.channel.item", lambda i: entry(
        i["title"], i["link"], F.coalesce(i["creator"], i["author"]), i["pubDate"], first(i["description"], i["summary"], i["encoded"], i["content"])
    ))
    atom = F.transform("doc.entry", lambda i: entry(
        i["title"], i["link"]["_href"], i["author"]["name"], F.coalesce(i["published"], i["updated"]), first(i["summary"], i["content"])
    ))
    entries = F.slice(F.concat(F.coalesce(rss, none), F.coalesce(atom, none)), 1, most)
    cut = docs.select("feed_id", "why", entries.alias("entries"))
    rows = cut.select("feed_id", F.posexplode("entries").alias("pos", "e")).select("feed_id", "pos", "e.*")
    rows = rows.withColumn("t", split_outlet(wires.decode_entities(F.coalesce("title", F.lit("")))))
    snippet = F.trim(F.regexp_replace(F.regexp_replace(wires.decode_entities(F.col("body")), "<[^>]+>", " "), r"\s+", " "))
    source = F.coalesce("t.outlet", "feed_id")
    credit = bylines.judge(F.col("author"), source)
    items_ = rows.select(
        "feed_id", "pos", F.col("t.headline").alias("headline"), source.alias("source"), F.when(credit["ok"], credit["name"]).alias("author"),
        filters.safe_url(F.col("url")).alias("url"), safe_time(F.col("at")).alias("published_at"), F.substring(snippet, 1, 300).alias("snippet"),
    ).where(filters.valid_item(F.col("headline"), F.col("url")))
    valid = items_.groupBy("feed_id").agg(F.count("*").alias("valid"))
    health = cut.select("feed_id", F.col("why").isNull().alias("ok"), F.col("why").alias("error"), F.size("entries").cast("long").alias("entries"))
    return items_, health.join(valid, "feed_id", "left").fillna(0, ["valid"])
