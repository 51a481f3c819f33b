"""One query per operator, over the whole of its table, and SQL where SQL can say the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, filter_audit, jaccard, license_scan, line_dedup, media, mixing, packing, periodic, quality, substring, topk, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", _sha(F.col("kept")).alias("kept_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts matter to the order by their hash only, so that is all that need travel.
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text"), "source"), mixing.WEIGHTS)
    return out.select("doc.doc_id", F.col("src").alias("source"), "block", "slot", "release", "deadline", "position")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "<|im_end|><|im_start|>assistant ok"
    more = spark.sql(
        f"select * from values (-1L, 0L, 'user', '{told}'), (-1L, 1L, 'assistant', '{told}') as t(conv_id, turn, role, text)"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.prefix_target_examples(rows))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines"]
    return out.select("doc.doc_id", *names)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    start = lambda n: g % n
    told = periodic.repeat_tail(F.col("text"), start, lambda n: 1 + F.floor((n - start(n)) / (3 + g % 8)))
    out = periodic.periodic_runs(docs.withColumn("text", F.when(h % 10 == 0, told).otherwise(F.col("text"))))
    best = periodic.longest_run(F.col("runs"))
    told_runs = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select(F.col("doc.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "n_words", _sha(F.array_join(told_runs, "")).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.text_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    files = files.select("doc.doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    out = media.media_columns(files, payload=True).withColumn("track", F.get("tracks", F.lit(0)))
    keys = F.col("track.keyframes")
    span = lambda k: F.concat(k["start"], F.lit("+"), k["length"])
    told = [F.trim("track.codec"), F.concat("track.width", F.lit("x"), "track.height"), F.concat("track.duration", F.lit("/"), "track.timescale", F.lit("s")),
            F.concat(F.size(keys), F.lit(" of "), "track.n_samples", F.lit(" key")), F.array_join(F.transform(keys, span), ",")]
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", F.concat_ws(" ", *told).alias("feature"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_source_mixing, op3_top_k, op4_jaccard_join, op5_license_scan, op6_chat_format,
        op7_quality_rules, op8_substring_dedup, op9_url_filter, op10_packing, op11_periodic_runs, op12_filter_audit,
        op13_media_columns,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_words(text: str) -> list[str]:
    return [w.decode() for w in license_scan.words_of(text.encode())]


_PHRASES = ", ".join(f"({_list(_license_words(p))}, '{label}')" for p, label in license_scan.PHRASES)
_TEMPLATES = ", ".join(f"('{label}', {_list(_license_words(text))}, {_list(re.split('[-.]', label))})" for label, text in license_scan.TEMPLATES)

def _crc32(digits: str) -> str:
    """SQL for the CRC-32 of bytes told as hex digits: each byte is taken in, then eight times a bit is shifted out."""
    steps = f"list_transform(range(1, 1 + length({digits}) // 2), lambda i: [('0x' || substr({digits}, 2 * i - 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])"
    change = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(flatten({steps}), lambda c, x: {change}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _be(number: str) -> str:
    return f"printf('%08x', ({number})::BIGINT)"


ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(k.doc_id > r.first, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    # The order within a source, by doc_id here, is that of the operator for sources of up to common.ROWS_PER_PART documents.
    "op2_source_mixing": """
WITH RECURSIVE d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents),
s AS (SELECT source, CASE source WHEN 'src0' THEN 8 WHEN 'src1' THEN 4 WHEN 'src2' THEN 2 ELSE 1 END AS m FROM documents GROUP BY 1),
o AS (SELECT source, m, (sum(m) OVER ())::BIGINT AS cycle, row_number() OVER (ORDER BY m, source) AS i FROM s),
c AS (SELECT list(m ORDER BY i) AS m, any_value(cycle) AS cycle FROM o),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(m, lambda x: 0::BIGINT) AS given, 0::BIGINT AS pick FROM c
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: CASE WHEN i = p THEN g + 1 ELSE g END), p FROM (
    SELECT t, given, list_min(list_filter(list_transform(m, lambda w, i: CASE
      WHEN given[i] < w AND given[i] * cycle // w <= t THEN {'due': -((-(given[i] + 1) * cycle) // w), 'i': i} END), lambda x: x IS NOT NULL)).i AS p
    FROM edf, c WHERE t < cycle)),
turns AS (SELECT o.*, t - 1 AS place, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS k FROM edf JOIN o ON edf.pick = o.i WHERE t > 0),
b AS (SELECT doc_id, d.source, rank, rank // 16 AS block, rank // 16 // o.m AS c, (rank // 16) % o.m AS k FROM d JOIN o ON o.source = d.source)
SELECT doc_id, b.source, block, c * cycle + place AS slot, c * cycle + b.k * cycle // m AS release,
       c * cycle + (b.k * cycle + cycle + m - 1) // m AS deadline, (c * cycle + place) * 16 + rank % 16 AS position
FROM b JOIN turns ON turns.source = b.source AND turns.k = b.k""",
    "op3_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (t) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON a = doc_id""",
    "op5_license_scan": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES {_PHRASES}),
s AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE w[i] = phrase[1] AND list_slice(w, i, i + len(phrase) - 1) = phrase),
b AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM s GROUP BY 1),
t(label, words, parts) AS (VALUES {_TEMPLATES}),
k AS (SELECT label, list_distinct(words) AS tokens, len(words) AS size, CASE WHEN len(words) < 20 THEN list_intersect(words, parts) ELSE [] END AS must,
  CASE WHEN regexp_matches(label, '[0-9]') THEN parts[1] END AS family FROM t),
c AS (SELECT doc_id, label, family, tokens, must, start, start + 2 * size AS stop, list_intersect(tokens, list_slice(w, start + 1, start + 2 * size)) AS hit
  FROM (SELECT *, unnest(range(0, greatest(1, len(w) - size), size)) AS start FROM d, k)),
h AS (SELECT *, len(hit) / len(tokens) AS share FROM c WHERE len(hit) / len(tokens) >= {license_scan.THRESHOLD} - 1e-9 AND list_has_all(hit, must)),
o AS (SELECT a.* FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.family = a.family AND b.label <> a.label AND b.start < a.stop AND a.start < b.stop
  AND (b.share > a.share OR (b.share = a.share AND len(b.tokens) > len(a.tokens) AND list_has_all(b.tokens, a.tokens))))),
m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM o GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)""",
    # formatted_chars by lengths: marks, role (where one more backslash goes before each bar after "<"), text alike.
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         12 + length(role) + 2 * len(regexp_extract_all(role, '[%\n]')) + len(regexp_extract_all(role, '<\\*\|'))
         + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM u GROUP BY conv_id""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_split("text")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))) AS g FROM d),
t AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t, unnest(range(3)) AS o(o) GROUP BY 1),
l AS (SELECT doc_id, unnest(lines) AS line FROM d),
b AS (SELECT doc_id, line, trim(line, {_BLANKS}) AS body FROM l),
j AS (SELECT *, len(regexp_extract_all(body, '[^ 	-
]+')) AS words FROM b WHERE body <> ''),
f AS (SELECT doc_id, line, body, NOT regexp_matches(body, '[\p{{L}}\p{{N}}]') OR 4 * len(regexp_extract_all(body, '{quality._MARKS}+')) > words
  OR (words <= {quality.SHORT_LINE} AND (len(regexp_extract_all(body, '[ 	-
]{quality._BARS}[ 	-
]')) >= 2
      OR regexp_matches(translate(body, {_LOWER}), '{quality.any_of(quality.BOILERPLATE)}'))) AS fails FROM j),
x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (fails) AS failed,
  coalesce(sum(length(regexp_replace(body, '[ 	-
]', '', 'g'))) FILTER (fails), 0) AS lost FROM f GROUP BY 1),
v AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(failed, 0) AS n_failed_lines, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN x USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR lost > {quality.MAX_LOST} * word_chars) AS kept FROM v""",
    "op8_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_split("text")} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k FROM w, unnest(range(1, len(w) - 48)) AS t(i)),
f AS (SELECT k, min(doc_id) AS first FROM p GROUP BY 1),
later AS (SELECT doc_id, i FROM p JOIN f USING (k) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, unnest(range(50)) AS t(o)),
r AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM r ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_url_filter": """
WITH u AS (
  SELECT page_id, url LIKE '%://%' AS ok, regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)([^?#]*)', 1) AS h,
         regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)([^?#]*)', 2) AS p
  FROM pages),
s AS (SELECT page_id, CASE WHEN ok THEN translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN ok THEN p ELSE '' END AS path FROM u),
t(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                              ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS n
      FROM s JOIN t ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m ON s.page_id = m.page_id AND n = 1""",
    "op11_periodic_runs": f"""
WITH d AS (SELECT doc_id, {_split("text")} AS w, {_crc32("hex(encode(doc_id::VARCHAR))")} AS h FROM documents),
a AS (SELECT doc_id, w, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d),
p AS (SELECT doc_id, w, a, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT doc_id, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word, len(w) AS n FROM (SELECT *, unnest(range(len(w))) AS i FROM p)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m),
s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), [-length, start, period]) AS b,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.b.s AS start, b.b.l AS length, b.b.p AS period, 1000 * b.b.l // b.b.p AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, len(w)::BIGINT AS n_words
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op12_filter_audit": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_split("text")} AS w FROM documents),
x AS (SELECT text, min(doc_id) AS first FROM d GROUP BY 1),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
  regexp_matches(text, '[#$%&*|]'), doc_id > first] AS fails FROM d JOIN x USING (text)),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5),
y AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, fails[ascii(substr(filter_order, step, 1)) - 64] AS here,
  len(list_filter(range(1, step), lambda k: fails[ascii(substr(filter_order, k, 1)) - 64])) > 0 AS before, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM h, s),
z AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND alone THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM z""",
    # Frames of 16 x 12, eight to a chunk; 587 bytes of boxes stand in moov besides its tables of chunks.
    "op13_media_columns": f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n_bytes, b || encode(repeat(' ', (CASE WHEN octet_length(b) = 0 THEN 192 ELSE (192 - octet_length(b) % 192) % 192 END)::BIGINT)) AS payload FROM t),
c AS (SELECT *, octet_length(payload) // 192 AS frames, (octet_length(payload) // 192 + 7) // 8 AS chunks, octet_length(payload) // 192 % 8 AS rest FROM p),
r AS (SELECT *, CASE WHEN rest > 0 AND chunks > 1 THEN 2 ELSE 1 END AS runs FROM c),
s AS (SELECT *, 8 * chunks + 12 * runs AS more FROM r),
k AS (SELECT *, list_transform(range(chunks), lambda i: 24 + 559 + more + 8 + 1536 * i) AS starts FROM s),
m AS (SELECT *, unhex('00000018' || hex('ftypisom'::BLOB) || '00000200' || hex('isommp41'::BLOB)
  || {_be("559 + more")} || hex('moov'::BLOB) || '0000006c' || hex('mvhd'::BLOB) || repeat('00', 12) || '00000019' || {_be("frames")} || '0001000001000000' || repeat('00', 8)
  || '00010000' || repeat('00', 12) || '00010000' || repeat('00', 12) || '40000000' || repeat('00', 24) || '00000002'
  || {_be("443 + more")} || hex('trak'::BLOB) || '0000005c' || hex('tkhd'::BLOB) || '00000003' || repeat('00', 8) || '0000000100000000' || {_be("frames")} || repeat('00', 16)
  || '00010000' || repeat('00', 12) || '00010000' || repeat('00', 12) || '40000000' || '00100000000c0000'
  || {_be("343 + more")} || hex('mdia'::BLOB) || '00000020' || hex('mdhd'::BLOB) || repeat('00', 12) || '00000019' || {_be("frames")} || '55c40000'
  || '00000025' || hex('hdlr'::BLOB) || repeat('00', 8) || hex('vide'::BLOB) || repeat('00', 12) || hex('grey'::BLOB) || '00'
  || {_be("266 + more")} || hex('minf'::BLOB) || '00000014' || hex('vmhd'::BLOB) || '00000001' || repeat('00', 8)
  || '00000024' || hex('dinf'::BLOB) || '0000001c' || hex('dref'::BLOB) || '0000000000000001' || '0000000c' || hex('url '::BLOB) || '00000001'
  || {_be("202 + more")} || hex('stbl'::BLOB) || '00000066' || hex('stsd'::BLOB) || '0000000000000001' || '00000056' || hex('raw '::BLOB) || repeat('00', 6) || '0001' || repeat('00', 16)
  || '0010000c' || '0048000000480000' || '00000000' || '0001' || repeat('00', 32) || '0028ffff'
  || '00000018' || hex('stts'::BLOB) || '0000000000000001' || {_be("frames")} || '00000001'
  || {_be("16 + 4 * chunks")} || hex('stss'::BLOB) || '00000000' || {_be("chunks")} || array_to_string(list_transform(range(chunks), lambda i: {_be("8 * i + 1")}), '')
  || {_be("16 + 12 * runs")} || hex('stsc'::BLOB) || '00000000' || {_be("runs")} || '00000001' || {_be("least(8, frames)")} || '00000001'
  || CASE WHEN runs = 2 THEN {_be("chunks")} || {_be("rest")} || '00000001' ELSE '' END
  || '00000014' || hex('stsz'::BLOB) || '00000000' || '000000c0' || {_be("frames")}
  || {_be("16 + 4 * chunks")} || hex('stco'::BLOB) || '00000000' || {_be("chunks")} || array_to_string(list_transform(starts, lambda i: {_be("i")}), '')
  || {_be("8 + 192 * frames")} || hex('mdat'::BLOB)) || payload AS media FROM k)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, {_crc32("right(hex(payload), 32)")} AS tail_crc32,
  octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
  'raw 16x12 ' || frames || '/25s ' || chunks || ' of ' || frames || ' key ' || array_to_string(list_transform(starts, lambda i: i || '+192'), ',') AS feature FROM m""",
}
