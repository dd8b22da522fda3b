"""Text of feeds, mails and model answers: links, entities, dates, labelled lines, recipients, fences and arrays. All are JVM columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverwell.functions.text import bound

# The entities that feeds use, and what each stands for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘",
    "rdquo": "”", "ldquo": "“", "laquo": "«", "raquo": "»", "middot": "·",
    "copy": "©", "reg": "®", "trade": "™", "deg": "°",
}
# Language and country arguments of the search service.
LOCALES = {"en": "hl=en-US&gl=US&ceid=US:en", "ar": "hl=ar&gl=EG&ceid=EG:ar"}
#: What a form encoder escapes though a URI component may hold it.
UNESCAPED = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
FENCE = "source_text"
_DASHES = r"^[—–\-·.\s]*\z"


def uri_component(text: Column) -> Column:
    """Percent-encoded, with a blank as ``%20``; null for null."""
    out = F.url_encode(text)
    for escaped, plain in UNESCAPED.items():
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def search_url(query: Column, locale: str, base: str, window: str = "when:2d") -> Column:
    """The feed of a news search over the ``window``; null for a null query."""
    return F.concat(F.lit(f"{base}?q="), uri_component(F.concat(query, F.lit(f" {window}"))), F.lit(f"&{LOCALES[locale]}"))


def wrapper_host(url: Column, host: str) -> Column:
    """Whether the URL's host is ``host`` or one below it; false where there is no URL."""
    own = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce((own == host) | F.endswith(own, F.lit(f".{host}")), F.lit(False))


def _entity(name: Column) -> Column:
    """The text for one entity without ``&`` and ``;``, or null where it stands for nothing."""
    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    digits = F.regexp_replace(name, "^#x?0*", "")
    code = F.when(F.length(digits) > 8, F.lit(None).cast("long")).when(F.startswith(name, F.lit("#x")), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
    char = F.when(code == 0xFEFF, F.lit("﻿")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))  # UTF-32 takes U+FEFF for a mark of order
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    named = F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.lower(name)))
    return F.when(F.startswith(name, F.lit("#")), F.when(valid, char)).otherwise(named)


def _decode_once(text: Column) -> Column:
    pattern = r"&(#x[0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda e: F.coalesce(_entity(e), F.concat(F.lit("&"), e, F.lit(";"))))
    return F.array_join(F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("part"), found.alias("char")), lambda p: F.concat(p["part"], F.coalesce(p["char"], F.lit("")))), "")


def decode_entities(text: Column) -> Column:
    """Named and numeric entities as characters, in two passes as feeds encode twice; what is unknown stays. Null for null."""
    return bound(bound(text, _decode_once), _decode_once)


def clean_date(text: Column) -> Column:
    """The text if it is a day of the calendar written YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def angle_lines(text: Column) -> Column:
    """(label, val) of each line ``label: value``; values of dashes only are passed over. Null and empty have none."""
    pattern = r"^([A-Za-z][A-Za-z /&]*?)\s*[·:\-–—]\s*(.*)\z"
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", ""))
    pairs = F.transform(
        F.filter(lines, lambda s: s.rlike(pattern)),
        lambda s: F.struct(F.trim(F.regexp_extract(s, pattern, 1)).alias("label"), F.trim(F.regexp_extract(s, pattern, 2)).alias("val")),
    )
    return F.filter(pairs, lambda p: ~p["val"].rlike(_DASHES))


def action_line(lines: Column) -> Column:
    """The value labelled Action in any case, else the last line's; null without lines."""
    named = F.filter(lines, lambda p: F.lower(p["label"]) == "action")
    return F.coalesce(F.get(named, F.lit(0)), F.get(lines, F.size(lines) - 1))["val"]


def age_label(at: Column, now: datetime) -> Column:
    """How long ago in words, times to come being now; empty where there is no time."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3_600_000_000))
    whole = lambda c: F.floor(c + 0.5).cast("string")
    label = F.when(hours < 1, "just now").when(hours < 24, F.concat(whole(hours), F.lit("h ago"))).otherwise(F.concat(whole(hours / 24), F.lit("d ago")))
    return F.when(at.isNull(), "").otherwise(label)


def impact_level(importance: Column) -> Column:
    """1 to 5; nothing and 0 read as 1."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(importance, F.lit(1)))).cast("long")


def named_recipients(csv: Column) -> Column:
    """(name, email) of a comma-separated list of addresses, some as ``Name <address>``; null has none."""
    pattern = r"^(.+?)\s*<([^>]+)>\z"
    entries = F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    named = lambda s: s.rlike(pattern)
    return F.transform(
        entries,
        lambda s: F.struct(
            F.when(named(s), F.trim(F.regexp_extract(s, pattern, 1))).alias("name"), F.when(named(s), F.trim(F.regexp_extract(s, pattern, 2))).otherwise(s).alias("email")
        ),
    )


def neutralised(text: Column, most: int = 0) -> Column:
    """Text that cannot close its fence: control characters are blanks, the fence's tags are in round brackets; cut at ``most`` if set. Null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    out = F.regexp_replace(out, rf"(?i)<(\s*/?\s*{FENCE}\s*)>", "($1)")
    return F.substring(out, 1, most) if most else out


def fenced(body: Column) -> Column:
    return F.concat(F.lit(f"<{FENCE}>\n"), body, F.lit(f"\n</{FENCE}>"))


def salvaged_json(text: Column) -> Column:
    """The JSON of a model's answer: the whole of it, else from the first ``[`` to the last ``]``; null if neither parses."""
    cut = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.to_json(F.coalesce(F.try_parse_json(text), F.try_parse_json(F.when(cut != "", cut))))
