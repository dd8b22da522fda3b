"""The thin queries over each operator's whole table, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverwell.llm import bpe, decontaminate, divergence, html_extract, line_dedup, mixing, near_dup, perspectives, quality, repair, repeats
from coverwell.llm import secrets, token_counts

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_mix_sources(spark, sf_dir):
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query
def op3_line_dedup(spark, sf_dir):
    got = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLES["op3_line_dedup"] = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op8_quality_rules(spark, sf_dir):
    got = quality.quality(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"
    )


@query
def op5_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


_ITEM_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
ORACLES["op5_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)
),
hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_secret_scans(spark, sf_dir):
    got = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["ord"] < len(secrets.BASE))
    return got.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


def _secrets_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = "\nUNION ALL\n".join(
        f"""SELECT doc_id, '{r.kind}' AS kind, {order} AS ord,
  regexp_extract_all(text, {quoted("(?s:.*?)(?:" + r.pattern + ")")}) AS upto,
  regexp_extract_all(text, {quoted(r.pattern)}) AS whole,
  regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS part, {r.least} AS least FROM d"""
        for order, r in enumerate(secrets.RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each_ AS (
  SELECT doc_id, kind, ord, least, unnest(upto) AS u, unnest(whole) AS w, unnest(part) AS p,
    unnest(range(len(upto))) AS i FROM found
),
placed AS (
  SELECT *, sum(length(u)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS till FROM each_
),
spans AS (
  SELECT doc_id, kind, ord, till - length(w) AS start, kind || ':' || CAST(till - length(w) AS VARCHAR) || ':' || CAST(till AS VARCHAR) AS s
  FROM placed WHERE length(p) >= least
),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
    count(*) FILTER (WHERE ord = 2) AS n_hex, string_agg(s, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(secrets.BASE)}) AS base,
    string_agg(s, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (doc_id)
"""


ORACLES["op4_secret_scans"] = _secrets_sql()


@query
def op1_minhash_near_dedup(spark, sf_dir):
    got = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=2, percent=80)
    return got.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op7_suffix_dedup(spark, sf_dir):
    return repeats.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


ORACLES["op7_suffix_dedup"] = """
WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, text, ws, [length(x) FOR x IN regexp_extract_all(text, '^[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+')] AS steps
  FROM d WHERE len(ws) >= 50
),
w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM g)),
shared AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT w.doc_id, w.i, s.first FROM w JOIN shared s ON w.win = s.win),
opened AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50 THEN 1 ELSE 0 END AS opens FROM hit),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened),
spans AS (SELECT doc_id, run, min(i) AS first_word, max(i) + 50 - min(i) AS n_words, min(first) AS first_doc_id FROM runs GROUP BY doc_id, run)
SELECT s.doc_id, s.first_word, s.n_words,
  CAST(list_sum(g.steps[1:s.first_word + 1]) - length(g.ws[s.first_word + 1]) AS BIGINT) AS start,
  CAST(list_sum(g.steps[1:s.first_word + s.n_words]) AS BIGINT) AS "end", s.first_doc_id
FROM spans s JOIN g USING (doc_id)
"""


@query
def op9_chat_perspectives(spark, sf_dir):
    got = perspectives.perspectives(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return got.withColumn("masks", masks)


ORACLES["op9_chat_perspectives"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS rank
  FROM conversations
),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, p.speaker, CAST(floor(rank / 64) AS BIGINT) AS part, rank, t.role = p.speaker AS own,
    CASE WHEN t.role = p.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
      ELSE '<|user name=' || replace(t.role, '<|', '< |') || '|>' END || chr(10) AS head,
    replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
s AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY rank) AS upto FROM r
),
g AS (
  SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY rank) AS text,
    CAST(max(upto) AS BIGINT) AS n_chars,
    coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE own), '') AS masks,
    CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
  FROM s GROUP BY conv_id, speaker, part
)
SELECT conv_id, speaker, part, n_turns, text, n_chars,
  CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  masks, n_masked
FROM g
"""


@query
def op6_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op11_bpe_round_trip(spark, sf_dir):
    import public_tokenizers

    got = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"), min_docs=30)


ORACLES["op13_source_divergence"] = """
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
),
w AS (SELECT n, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n, coalesce(any_value(v), 0) AS v FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5)) // (t.n + 5 * t.v) AS BIGINT) AS p
  FROM total t JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
),
q AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)) AS BIGINT) AS q
  FROM p JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM total GROUP BY lang) USING (lang) GROUP BY lang, term
),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op12_conversation_repair(spark, sf_dir):
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def _repair_sql() -> str:
    add = lambda x, cost, letter: f"(lpad(CAST(CAST(substr({x}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({x}, 13) || '{letter}')"
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    least = lambda *xs: f"least({', '.join(xs)})"
    may, more = "fault < 2", "CASE WHEN fault = 1 THEN 5 ELSE 0 END"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    to_u = "least(s0, s1, s3)"
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(0, 8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v
    FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS b)
  )
),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
sums AS (
  SELECT key, xor(4294967295, list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(key, '')],
    lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INT) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS d
  FROM (SELECT DISTINCT key FROM keyed), bits
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM keyed JOIN sums USING (key), range(2) AS copy(k) WHERE d <> 0 AND (k = 0 OR d = 3)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, {blank}) AS cut FROM damaged
),
judged AS (
  SELECT *, substr(role, 1, 1) AS sign, CASE WHEN cut = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
counted AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 3) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || sign NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000000005I' AS s2, '000000000010II' AS s3 FROM counted
  UNION ALL
  SELECT conv_id, i, s0, s1, least(s2, {add("least(s0, s1, s3)", 5, "I")}), least(s3, {add("s2", 5, "I")}, {add(add("least(s0, s1)", 5, "I"), 5, "I")})
  FROM (
    SELECT j.conv_id, j.i, {add("s0", 2, "D")} AS s0,
      {least(add("s1", 2, "D"), when(f"{may} AND sign = 's'", add("s0", more, "K")))} AS s1,
      {least(add("s2", 2, "D"), when(f"{may} AND sign = 'u'", add(to_u, more, "K")), when(may, add(to_u, f"1 + {more}", "R")))} AS s2,
      {least(add("s3", 2, "D"), when(f"{may} AND sign = 'a'", add("s2", more, "K")), when(may, add("s2", f"1 + {more}", "R")))} AS s3
    FROM steps JOIN judged j ON j.conv_id IS NOT DISTINCT FROM steps.conv_id AND j.i = steps.i + 1
  )
),
best AS (
  SELECT c.*, CAST(substr(least(s0, s3), 1, 12) AS BIGINT) AS cost, substr(least(s0, s3), 13) AS audit
  FROM counted c JOIN steps ON c.conv_id IS NOT DISTINCT FROM steps.conv_id AND c.n = steps.i
),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS nth FROM best WHERE audit <> ''),
walked AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
),
said AS (
  SELECT w.*, role, text, coalesce(max(CASE WHEN place = 1 AND letter = 'K' AND sign = 's' THEN 1 END) OVER (PARTITION BY w.conv_id), 0) AS system
  FROM walked w LEFT JOIN judged j ON w.letter <> 'I' AND w.conv_id IS NOT DISTINCT FROM j.conv_id AND w.i = j.i
),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS text
  FROM said WHERE letter <> 'D' GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN best b ON e.conv_id IS NOT DISTINCT FROM b.conv_id
  LEFT JOIN lines l ON e.conv_id IS NOT DISTINCT FROM l.conv_id
"""


ORACLES["op12_conversation_repair"] = _repair_sql()
