"""Who wrote a page: the credits that it names, and the judgement of each. All are JVM columns.

A candidate is (source, raw). Sources in order of trust: structured data, meta tags, visible bylines, a name before a date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverwell.functions.text import bound, html_text

# Credits that name a desk, not a person.
DESKS = [
    "", "admin", "administrator", "staff", "editor", "editorial", "newsroom",
    "correspondent", "reporter", "agencies", "agency", "staff writer",
    "staff report", "staff reporter", "web desk", "news desk", "guest",
    "تحرير", "المحرر", "محرر", "فريق التحرير", "هيئة التحرير", "وكالات", "خاص", "متابعة",
]
# Words of a site's furniture, which stand in no name.
FURNITURE_AR = "بحث البحث ابحث كلمة اشترك اشتراك تسجيل الدخول القائمة الرئيسية المرور تابعنا تابعونا المزيد التطبيق أرشيف الأرشيف الارشيف إعلان اعلان".split()
FURNITURE = ["search", "login", "log ?in", "sign ?up", "register", "subscribe", "menu", "password", "keywords?", "homepage", "sidebar", "widget", "click"]
# Weekdays and months, and the markers of a publication.
DAYS_AR = "السبت الأحد الاحد الإثنين الاثنين الثلاثاء الأربعاء الاربعاء الخميس الجمعة".split()
MONTHS_AR = "يناير فبراير مارس أبريل إبريل ابريل مايو يونيو يوليو أغسطس اغسطس سبتمبر أكتوبر اكتوبر نوفمبر ديسمبر".split()
LEVANT_MONTHS = "كانون شباط آذار اذار نيسان أيار ايار حزيران تموز آب أيلول ايلول تشرين".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTHS = "january february march april june july august september october november december".split()
PUBLICATIONS_AR = "بوابة وكالة موقع شبكة جريدة صحيفة".split()
# Offices and verbs beside the name of one whom a story is about.
ROLES = [
    "chief (?:executive|financial|operating|technology|marketing|commercial)", r"\bC[EFOTM]O\b", "chair(?:man|woman|person)", "co-?founder", "founder",
    "managing director", "general manager", "vice[- ]president", "president", "minister", "governor", "spokes(?:man|woman|person)", "head of", "director of",
    "board member", "ambassador", "deputy",
    "الرئيس التنفيذي", "المدير التنفيذي", "المدير العام", "العضو المنتدب", "رئيس مجلس", "نائب رئيس", "مؤسس", "وزير", "محافظ", "المتحدث", "عضو مجلس",
]
SAID = "said says told added explained noted stated قال قالت أضاف أوضح صرح صرّح أكد".split()
NO_NAME = "عن في على من إلى الى أن ان هذا هذه المقال الخبر التقرير الموضوع".split()

# The patterns of names, dates, separators and credits, and the tags and classes that sites give their bylines.
_or = "|".join
_ROLE = f"(?iu)({_or(ROLES)})"
_MON = "(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]*"
_DATE = rf"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b|\d{{1,2}}\s*{_MON}|{_MON}\s*\d{{1,2}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|{_or(DAYS_AR)}|\d{{1,2}}\s*(?:{_or(MONTHS_AR)}))"
_PART = r"[\p{Lu}\p{IsArabic}][\p{L}.'’-]*"
_SHAPE = r"^\p{L}[\p{L} .ّ’'\-]*\z"
_SPLIT = r"\s*[|/·•:：,،]\s*|\s+[-–—]\s+"
_CREDIT = r"(?iu)(?:\bby|written by|بقلم|كتبت?|حرره)\s*[:\-–—]?\s*\z"
META = ["author", "article:author", r"sailthru\.author", "parsely-author"]
#: Visible bylines, explicit ones before loose ones.
VISIBLE = [
    r"""(?i)<a[^>]+href=["'][^"']*/author/[^"']*["'][^>]*>([^<]{2,60})</a>""",
    r"""(?i)<a[^>]+href=["'][^"']*[?&]author=[^"']*["'][^>]*>([^<]{2,60})</a>""",
    r"""(?i)rel=["']author["'][^>]*>([^<]{2,60})<""",
    r"""(?i)class=["'][^"']*\bbyline\b[^"']*["'][^>]*>\s*(?:by\s+)?([^<]{2,60})<""",
    r"(?:بقلم|كتبت?|حرره)\s*[:\-–]\s*([^<\n،.]{3,40})",
    r"""(?i)itemprop=["']author["'][^>]*>\s*(?:by\s+)?([^<]{2,60})<""",
    r"""(?is)itemprop=["']author["'].{0,160}?itemprop=["']name["'][^>]*>\s*([^<]{2,60})<""",
    r"""(?i)class=["'][^"']*\bauthors?\b[^"']*["'][^>]*>\s*(?:by\s+)?([^<]{2,60})<""",
    r"(?i)<address[^>]*>\s*(?:by\s+)?([^<]{2,60})</address>",
]
WINDOW = 1500  # a date beyond this is the story's, not its dateline


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def clean_credit(raw: Column) -> Column:
    """Without tags, a leading "by" and doubled blanks; null is empty."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"<[^>]+>", " "), r"\s+", " ")
    return _trim(F.regexp_replace(s, r"(?iu)^\s*(by|بقلم|كتبت|كتب)(?=[\s:\-–]|\z)\s*[:\-–]?\s*", ""))


def outlet_like(name: Column, outlet: Column) -> Column:
    """Whether a credit is a publication: a marker, a desk among its parts, or the outlet's own name."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9؀-ۿ]+", "")
    a, o = flat(name), flat(outlet)
    parts = F.transform(F.split(F.lower(name), r"[-–—·|/،,]+"), lambda p: _trim(p).isin(DESKS))
    own = (F.length(o) >= 3) & (F.contains(a, o) | F.contains(o, a))
    marked = _has(name, r"(?i)\b(gate|newsroom|portal)\b") | _has(name, _or(PUBLICATIONS_AR))
    return (F.length(a) > 0) & (marked | F.array_contains(parts, True) | own)


def _person(s: Column) -> Column:
    """Two to four words of letters."""
    return F.length(s).between(3, 60) & F.size(F.split(s, r"\s+")).between(2, 4) & _has(s, _SHAPE)


def story_subject(name: Column, text: Column) -> Column:
    """Whether the story is about the one named: an office or a verb of speech beside the name, and nowhere a credit or a date. Eight mentions are read."""
    split = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(name), F.lit(r"\E")), 9)
    return bound(split, lambda parts: bound(_mentions(parts), lambda met: _about(name, parts, met)))


def _mentions(parts: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.struct(
            F.coalesce(F.substring(F.get(parts, i - 1), -60, 60), F.lit("")).alias("before"), F.coalesce(F.substring(F.get(parts, i), 1, 60), F.lit("")).alias("after")
        ),
    )


def _about(name: Column, parts: Column, met: Column) -> Column:
    credited = F.exists(met, lambda m: _has(m["before"], _CREDIT) | _has(m["after"], rf"(?iu)^\s*[,،|·•\-–—]?\s*{_DATE}"))
    near = lambda m: F.concat(F.substring(m["before"], -30, 30), F.lit(" "), F.substring(m["after"], 1, 30))
    verb = lambda m: _has(m["after"], rf"^[\s,،:;.—–-]{{0,3}}(?:{_or(SAID)})\b") | _has(m["before"], rf"\b(?:{_or([*SAID, 'according to', 'وأشار'])})[\s,،:;—–-]{{0,3}}\z")
    flagged = F.exists(met, lambda m: _has(near(m), _ROLE) | verb(m))
    return F.coalesce((F.length(name) >= 3) & (F.size(parts) > 1) & ~credited & flagged, F.lit(False))


def judge(raw: Column, outlet: Column, headline: Column | None = None, text: Column | None = None) -> Column:
    """(ok, name, reason): the first rule that a credit fails, or ``ok`` with the person; of several people the first counts."""
    return bound(clean_credit(raw), lambda n: _judge(n, outlet, headline, text))


def _judge(n: Column, outlet: Column, headline: Column | None, text: Column | None) -> Column:
    segments = F.filter(F.transform(F.split(n, _SPLIT), lambda s: _trim(s)), lambda s: s != "")

    def parted(parts: Column) -> Column:
        people = F.filter(parts, lambda s: ~F.lower(s).isin(DESKS) & ~outlet_like(s, outlet) & _person(s))
        one = F.size(parts) <= 1
        return F.struct(one.alias("one"), F.when(one, n).otherwise(F.get(people, F.lit(0))).alias("name"))

    return bound(bound(segments, parted), lambda p: _verdict(n, p["one"], p["name"], outlet, headline, text))


def _verdict(n: Column, one: Column, name: Column, outlet: Column, headline: Column | None, text: Column | None) -> Column:
    rules = [
        (n == "", "empty"), (F.contains(n, F.lit("@")), "email"), (F.lower(n).isin(DESKS), "desk-word"),
        (_has(n, rf"(?:^|\s)(?:{_or(FURNITURE_AR)})(?:\s|\z)") | _has(n, rf"(?i)\b(?:{_or(FURNITURE)})\b"), "ui-junk"),
        (_has(n, r'(?i)[<>="{}]|\b(?:data|aria)-[a-z]|\b(?:href|class|src|style|rel|id|alt|title)\s*='), "markup"),
        (_has(n, r"(?:^|\s)[^\s-]*-[^\s-]*-\S*"), "slug"),
        (_has(n, rf"(?iu)(^|\s)({_or([*DAYS_AR, *MONTHS_AR, *LEVANT_MONTHS, *DAYS, *MONTHS])})(\s|\z)"), "dateline-word"),
        (F.length(n) > 80, "too-long"), (one & outlet_like(n, outlet), "outlet-name"), (one & ~_has(n, _SHAPE), "not-name-shaped"), (name.isNull(), "no-person-segment"),
    ]
    if headline is not None:
        rules.append(((F.length(name) >= 3) & F.contains(F.lower(F.coalesce(headline, F.lit(""))), F.lower(name)), "in-headline"))
    if text is not None:
        rules.append((story_subject(name, text), "story-subject"))
    reason = reduce(lambda so_far, r: so_far.when(*r), rules[1:], F.when(*rules[0])).otherwise("ok")
    return bound(reason, lambda r: F.struct((r == "ok").alias("ok"), F.when(n != "", F.coalesce(name, n)).alias("name"), r.alias("reason")))


def _linked(html: Column) -> Column:
    """Authors in JSON-LD: of the object, of each in a list or of its graph; strings or objects with a name."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    many = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    each = lambda v, *paths: F.coalesce(*[many(v, p) for p in paths], F.array(v))
    nodes = F.flatten(F.transform(blocks, lambda b: F.coalesce(*[each(v, "$", '$["@graph"]') for v in [F.try_parse_json(b)]])))
    authors = F.flatten(F.transform(nodes, lambda v: each(F.try_variant_get(v, "$.author", "variant"), "$")))
    names = F.transform(authors, lambda a: F.coalesce(F.try_variant_get(a, "$.name", "string"), F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))))
    return F.filter(names, lambda x: x != "")


def _meta(html: Column) -> Column:
    tag = lambda key: F.regexp_extract(html, rf"""(?i)<meta\s[^>]*(?:name|property)=["']{key}["'][^>]*>""", 0)
    found = F.array(*[F.regexp_extract(tag(k), r"""(?i)content=["']([^"']+)["']""", 1) for k in META])
    return F.filter(found, lambda x: (x != "") & ~x.rlike("(?i)^https?://"))


def _visible(html: Column) -> Column:
    unmarked = F.regexp_extract(html, r"(?:بقلم|كتبت|كتب)\s+([؀-ۿ][؀-ۿ .]{4,40})", 1)  # also a noun, so only if a name follows
    name = _person(_trim(unmarked)) & ~F.arrays_overlap(F.split(_trim(unmarked), r"\s+"), F.array(*map(F.lit, NO_NAME)))
    return F.filter(F.array(*[F.regexp_extract(html, p, 1) for p in VISIBLE], F.when(name, unmarked)), lambda x: x != "")


def _dated(text: Column) -> Column:
    """Names that stand before a separator and a date; a name begins after the last capitals or office in the run of words."""
    runs = F.regexp_extract_all(F.substring(text, 1, WINDOW), F.lit(rf"((?:{_PART}\s+){{1,3}}{_PART})\s*[,،|·•]\s*(?iu:{_DATE})"), F.lit(1))
    after = F.transform(runs, lambda r: F.regexp_replace(r, rf"^.*(?:^|\s)(?:[A-Z]{{2,}}|(?iu:{_or(x for x in ROLES if ' ' not in x)}))\s+", ""))
    return F.filter(F.slice(after, 1, 4), lambda s: F.size(F.split(s, r"\s+")) >= 2)


def candidates(html: Column) -> Column:
    """(source, raw) of all credits on a page, in order of trust; null has none."""
    return bound(F.coalesce(html, F.lit("")), lambda page: _candidates(page, html_text(page)))


def _candidates(page: Column, text: Column) -> Column:
    tagged = lambda source, names: F.transform(names, lambda x: F.struct(F.lit(source).alias("source"), x.alias("raw")))
    return F.concat(tagged("json-ld", _linked(page)), tagged("meta", _meta(page)), tagged("byline", _visible(page)), tagged("dateline", _dated(text)))


def trace(html: Column, outlet: Column, headline: Column) -> Column:
    """(source, raw, ok, name, reason) of every candidate; the byline is the first that is ok."""
    return bound(F.coalesce(html, F.lit("")), lambda page: bound(html_text(page), lambda text: _traced(page, text, outlet, headline)))


def _traced(page: Column, text: Column, outlet: Column, headline: Column) -> Column:
    def told(c: Column, v: Column) -> Column:
        return F.struct(c["source"].alias("source"), F.substring(c["raw"], 1, 80).alias("raw"), v["ok"].alias("ok"), v["name"].alias("name"), v["reason"].alias("reason"))

    judged = lambda c: bound(judge(c["raw"], outlet, headline, text), lambda v: told(c, v))
    return F.transform(_candidates(page, text), judged)


def byline(traced: Column) -> Column:
    return F.get(F.filter(traced, lambda t: t["ok"]), F.lit(0))["name"]
