"""Text columns: normal forms, hashes, token sets and their similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to tell stories apart. Callers add brands and places of their own.
STOPWORDS = (
    "the a an of in on at to for and or but is are was were be been by with from as that this these those says said "
    "have has had will can may might after before over under into about more than their they them new news report "
    "reports update updates latest announces announced launches launched opens opened plans plan"
).split()
# The shorter lists of the candidate gate.
GATE_STOPWORDS = "the a an of in on at to for and or is are as by with its new two service services".split()
PHRASE_STOPWORDS = "the a an of in on at to for and or is are as by with its that be no not".split()


def normal_form(text: Column) -> Column:
    """Lower-cased, with all but a-z, 0-9, Arabic letters and spaces deleted, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9؀-ۿ ]", ""))


def content_hash(text: Column) -> Column:
    """SHA-256 of the normal form; null for null."""
    return F.sha2(F.encode(normal_form(text), "UTF-8"), 256)


def _kept(text: Column, pattern: str, least: int, stop: list[str]) -> Column:
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), pattern, " "), r"[ \t\n\x0B\f\r]+")
    return F.filter(parts, lambda t: (F.length(t) >= least) & ~t.isin(*stop))


def tokens(text: Column, extra_stop: tuple[str, ...] = ()) -> Column:
    """The distinct words of four characters or more that are not stopwords."""
    return F.array_distinct(_kept(text, r"[^a-zA-Z0-9_ \t\n\x0B\f\r؀-ۿ]", 4, [*STOPWORDS, *extra_stop]))


def gate_tokens(text: Column, extra_stop: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(_kept(text, r"[^a-z0-9؀-ۿ ]", 3, [*GATE_STOPWORDS, *extra_stop]))


def strong_tokens(toks: Column, least: int = 5) -> Column:
    return F.filter(toks, lambda t: F.length(t) >= least)


def phrases(text: Column) -> Column:
    """Distinct pairs of adjacent words, past a minimal stoplist."""
    ws = _kept(text, r"[^a-z0-9؀-ۿ ]", 3, PHRASE_STOPWORDS)
    return F.array_distinct(
        F.get(
            F.transform(
                F.array(ws),
                lambda w: F.zip_with(
                    F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)
                ),
            ),
            F.lit(0),
        )
    )


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once a row: lambdas have no common subexpressions, so each use would be worked out anew."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays without repeats; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / (F.size(a) + F.size(b) - inter))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def split_outlet(title: Column) -> Column:
    """(headline, outlet): cut at the last `` - `` beyond the twentieth character, if there is one."""
    at = F.length(title) - F.length(F.substring_index(title, " - ", -1)) - 3
    cut = at > 20
    return F.struct(
        F.when(cut, title.substr(F.lit(1), at)).otherwise(title).alias("headline"),
        F.when(cut, F.substring_index(title, " - ", -1)).alias("outlet"),
    )


def html_text(html: Column) -> Column:
    """Scripts, styles, comments and tags become spaces; white space is one space."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " "))


def article_text(html: Column, most: int = 3500) -> Column:
    """The text of a page from its article on: from the first article or main element, else from the first heading, else all of it."""
    page = F.coalesce(html, F.lit(""))
    place = lambda p: F.length(F.regexp_extract(page, rf"(?is)^(.*?)<(?:{p})[\s>]", 1))
    has = lambda p: page.rlike(rf"(?i)<(?:{p})[\s>]")
    at = F.when(has("article|main"), place("article|main")).when(has("h1"), place("h1")).otherwise(0)
    text = F.substring(page, at + 1, F.length(page))
    for gone in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>", "&nbsp;|&#160;"):
        text = F.regexp_replace(text, gone, " ")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)
