"""Queries of the text operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline
from .chat import digests, format_windows
from .common import read_table
from .decontaminate import contamination
from .html_text import extract_text
from .lexical import search
from .periodic import find_runs, planted
from .pipeline import fold
from .quality import assess
from .repeats import remove_repeats
from .sentencepiece_codec import encode_and_check
from .sharding import assign_shards
from .simhash import near_duplicates
from .token_counts import count_tokens
from .toxicity import score_toxicity, train
from .warc import captures, parse, resolve_revisits

def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"), usable=lambda k: fold(k) != 0)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"select * from values (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}') as t(conv_id, turn, role, text)")
    return digests(format_windows(conversations.unionByName(probe)))


OP4_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
    len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\s\p{L}\p{N}]+')) + 4 AS tok,
    33 + length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars
  FROM c
), t AS (
  SELECT *, CASE WHEN first_value(role) OVER q = 'system' THEN 1 ELSE 0 END AS f,
    CASE WHEN first_value(role) OVER q = 'system' THEN first_value(tok) OVER q ELSE 0 END AS sys_tok,
    CASE WHEN first_value(role) OVER q = 'system' THEN first_value(chars) OVER q ELSE 0 END AS sys_chars,
    sum(tok) OVER q AS upto, sum(chars) OVER q AS chars_upto, count(*) OVER (PARTITION BY conv_id) AS n
  FROM e WINDOW q AS (PARTITION BY conv_id ORDER BY k)
), h AS (
  SELECT a.conv_id, a.k,
    min(CASE WHEN b.k >= a.f AND b.k >= a.k - 4 AND (a.upto - a.tok) - (b.upto - b.tok) <= least(256, 1024 - a.sys_tok - a.tok) THEN b.k END) AS hk
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.k <= a.k GROUP BY a.conv_id, a.k
), s AS (
  SELECT t.*, t.sys_tok + t.upto - (b.upto - b.tok) AS fresh_used, t.sys_chars + t.chars_upto - (b.chars_upto - b.chars) AS fresh_chars
  FROM t JOIN h ON t.conv_id = h.conv_id AND t.k = h.k JOIN t b ON b.conv_id = t.conv_id AND b.k = coalesce(h.hk, t.k)
), w AS (
  SELECT conv_id, k, fresh_used AS used, fresh_chars AS total FROM s WHERE k = f
  UNION ALL
  SELECT s.conv_id, s.k, CASE WHEN w.used + s.tok <= 1024 THEN w.used + s.tok ELSE s.fresh_used END,
    w.total + CASE WHEN w.used + s.tok <= 1024 THEN s.chars ELSE s.fresh_chars END
  FROM w JOIN s ON s.conv_id = w.conv_id AND s.k = w.k + 1
), z AS (
  SELECT conv_id, max(total) AS total FROM w GROUP BY conv_id
)
SELECT t.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(t.role || chr(10) || t.text || chr(10), '' ORDER BY t.k)) AS turns_sha256,
  coalesce(sum(length(t.text)) FILTER (WHERE t.role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t.text, '' ORDER BY t.k) FILTER (WHERE t.role = 'assistant'), '')) AS loss_sha256,
  coalesce(max(z.total), max(t.sys_chars))::BIGINT AS formatted_chars
FROM t LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse(captures(read_table(spark, sf_dir, "pages")))
    found = resolve_revisits(records)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    page = lambda name, kind: F.regexp_extract(name, f"^urn:{kind}:(.*)$", 1).try_cast("long")
    return found.select(page("record_id", "revisit").alias("page_id"), F.col("canonical").alias("canonical_url"), "verdict", page("response_id", "page").alias("response_page_id"), "body_bytes", "body_md5", lines.alias("headers"))


OP5_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(page_id, 0) AS num, regexp_replace(url, '#.*$', '') AS bare, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT rid, page_id, num, body, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS named,
    CASE WHEN starts_with(lower(bare), 'https:') THEN ':443' WHEN starts_with(lower(bare), 'http:') THEN ':80' END AS port,
    regexp_replace(CASE WHEN ends_with(named, port) THEN string_split(named, ':')[1] ELSE named END, '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND string_split(q, '=')[1] NOT IN
      ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid','sessionid'))) AS q
  FROM p
), c AS (
  SELECT rid, page_id, num, body, md5(body) AS tag, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical,
    num AS at, CASE WHEN num % 11 = 5 THEN -1 - num ELSE 10000000 + num END AS again
  FROM h
), m AS (
  SELECT v.rid, max({'at': r.at, 'id': 'urn:page:' || coalesce(r.page_id::VARCHAR, ''), 'md5': r.tag, 'rid': r.rid}).rid AS found
  FROM c v JOIN c r ON v.canonical = r.canonical AND r.at < v.again GROUP BY v.rid
), j AS (
  SELECT v.page_id, v.num, v.canonical, v.again, v.tag, r.page_id AS response_page_id, r.tag AS r_tag, strlen(r.body) AS size,
    CASE WHEN r.rid IS NULL THEN 'no_response' WHEN v.num % 7 = 3 OR v.tag <> r.tag THEN 'mismatch' ELSE 'resolved' END AS verdict
  FROM c v LEFT JOIN m ON v.rid = m.rid LEFT JOIN c r ON m.found = r.rid
)
SELECT page_id, canonical AS canonical_url, verdict, response_page_id,
  CASE WHEN verdict = 'resolved' THEN size::BIGINT END AS body_bytes,
  CASE WHEN verdict = 'resolved' THEN r_tag END AS body_md5,
  CASE WHEN verdict = 'resolved' THEN
    'cache-control: max-age=' || (num % 100) || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) ||
    'date: ' || strftime(TIMESTAMP '2024-01-01' + to_seconds(again), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'etag: W/"' || tag || '"' || chr(10) || 'server: crawl' END AS headers
FROM j
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), n_shards=40)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = assess(read_table(spark, sf_dir, "documents"))
    return graded.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT rid, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars FROM w),
p AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
t AS (SELECT rid, i, word AS a, lead(word, 1) OVER q AS b, lead(word, 2) OVER q AS c FROM p WINDOW q AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM t WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM g, range(3) AS s(o) WHERE k > 1 GROUP BY rid),
l AS (SELECT rid, host, body, unnest(string_split(body, chr(10))) AS line FROM d),
u AS (SELECT rid, host, body, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
v AS (SELECT * FROM u WHERE norm <> ''),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM v GROUP BY rid),
same AS (SELECT rid, count(*) OVER (PARTITION BY host, body) AS copies FROM d),
freq AS (SELECT host, norm, count(DISTINCT rid) AS k FROM v GROUP BY host, norm),
gone AS (SELECT v.rid, sum(len(string_split(v.norm, ' ')))::BIGINT AS removed FROM v JOIN same USING (rid) JOIN freq f ON v.host IS NOT DISTINCT FROM f.host AND v.norm = f.norm WHERE k - copies + 1 > 10 GROUP BY v.rid),
j AS (
  SELECT d.doc_id, n.n_words, n.word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
    n.n_words - coalesce(gone.removed, 0) AS left_words
  FROM d JOIN n USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN r USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_words >= 50 AND 100 * left_words >= 30 * n_words AS kept
FROM j
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The criterion itself, without fingerprints: the similarity of every window that starts at a shared shingle.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS body FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT rid, len(ws) AS l, pos, array_to_string(ws[pos + 1 : pos + 5], ' ') AS sh FROM (SELECT rid, ws, unnest(range(greatest(len(ws) - 4, 0))) AS pos FROM w) q),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT item_id, len(ws) AS n, array_to_string(ws[pos + 1 : pos + 5], ' ') AS sh FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 4, 0))) AS pos FROM b) q),
ic AS (SELECT item_id, n, sh, count(*) AS c FROM i GROUP BY ALL),
win AS (SELECT DISTINCT rid, item_id, n, greatest(0, least(pos, l - n)) AS start, least(n, l) - 4 AS mw FROM p JOIN ic USING (sh)),
wc AS (SELECT win.rid, win.item_id, win.n, win.start, win.mw, p.sh, count(*) AS c FROM win JOIN p ON p.rid = win.rid AND p.pos >= win.start AND p.pos < win.start + win.mw GROUP BY ALL),
cm AS (SELECT rid, wc.item_id, start, wc.n, mw, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic ON wc.item_id = ic.item_id AND wc.sh = ic.sh GROUP BY ALL),
sm AS (SELECT rid, item_id, max(common::DOUBLE / (mw + n - 4 - common)::DOUBLE) AS s FROM cm GROUP BY ALL HAVING s >= 0.8 - 1e-12),
best AS (SELECT rid, count(*) AS n_items, max(s) AS s FROM sm GROUP BY rid)
SELECT d.doc_id, best.rid IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items,
  (SELECT min(item_id) FROM sm WHERE sm.rid = d.rid AND sm.s = best.s) AS item_id, best.s AS similarity
FROM d LEFT JOIN best ON d.rid = best.rid
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT count(*)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
t AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) q GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, g GROUP BY term, big_n),
b AS (SELECT row_number() OVER () AS bid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT rid, doc_id, 75 + (25 * len(ts)::BIGINT * big_n) // big_l AS m FROM d, g),
s AS (SELECT bid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM b JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS body FROM (SELECT *, unnest(range(greatest(len(ws) - 19, 0))) AS s FROM d) q),
late AS (SELECT rid, s FROM (SELECT rid, s, row_number() OVER (PARTITION BY body ORDER BY doc_id, rid, s) AS k FROM w) q WHERE k > 1),
gone AS (SELECT DISTINCT rid, s + o AS i FROM late, range(20) AS r(o)),
p AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM p ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        digest(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: Equal words of a document at every distance up to a quarter of it; stretches of them are runs. CRC-32 is computed bit by bit.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  flatten([[4294967295]] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM documents),
h AS (SELECT rid, doc_id, ws, len(ws)::BIGINT AS n,
  xor(list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM d),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
t AS (SELECT rid, doc_id, n, ws, a, CASE WHEN a < n THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM a),
w AS (SELECT rid, n, i, CASE WHEN i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM t) q),
e AS (SELECT x.rid, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e),
c AS (SELECT rid, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM c GROUP BY ALL),
m AS (SELECT rid, count(*) AS n_runs, max({'l': length, 's': -start, 'p': -period}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS body FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.l::BIGINT AS length, (-best.p)::BIGINT AS period, ((1000 * best.l) // (-best.p))::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM t LEFT JOIN m USING (rid) LEFT JOIN k USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_toxicity, op4_chat_formatting, op5_warc, op6_sharding, op7_html_extraction, op8_simhash, op9_quality_rules, op10_decontamination, op11_lexical_search, op12_substring_dedup, op13_periodic_runs)}
    return own | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op5_warc": OP5_SQL, "op9_quality_rules": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_periodic_runs": OP13_SQL}
