"""Queries over the driver's tables, one per operator, each with its SQL twin where SQL can say the same.

Bindings: the response sets are the conversations (prompt: the first user turn; responses: the
assistant turns in order). Groups of texts are documents by source and language; stages are languages, prompts
are sources. Labels come from `labels`, vectors from `embeddings`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyvox.functions import text as T
from polyvox.operators import curves, fits, length, lexical, pairwise, ranks, resample, stats, suites, tables, temperatures
from polyvox.plans import scorers
from polyvox.session import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines can be compared; minus zero becomes zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- bindings -------------------------------------------------------------


def response_sets(spark: SparkSession, sf: str) -> DataFrame:
    """set_id, k, prompt, response."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.where("role = 'assistant'").select(F.col("conv_id").alias("set_id"), F.row_number().over(order).cast("long").alias("k"), F.col("text").alias("response"))
    asked = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("set_id")).agg(F.min_by("text", "turn").alias("prompt"))
    return said.join(asked, "set_id", "left").select("set_id", "k", F.coalesce("prompt", F.lit("")).alias("prompt"), "response")


_SETS = """turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
asked AS (SELECT conv_id AS set_id, arg_min(text, turn) AS prompt FROM turns WHERE role = 'user' GROUP BY 1),
said AS (SELECT conv_id AS set_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text AS response FROM turns WHERE role = 'assistant'),
sets AS (SELECT set_id, k, coalesce(prompt, '') AS prompt, response FROM said LEFT JOIN asked USING (set_id))"""


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


_COUNTS = f"""rows0 AS (SELECT set_id, k, unnest({_words('response')}) AS word FROM sets
  UNION ALL SELECT set_id, 0 AS k, unnest({_words('prompt')}) AS word FROM sets WHERE k = 1),
counts AS (SELECT set_id, k, word, count(*) AS c FROM rows0 GROUP BY ALL),
types AS (SELECT set_id, count(DISTINCT word) AS types FROM counts GROUP BY 1),
slots AS (SELECT set_id, k, sum(c)::BIGINT AS n FROM counts GROUP BY 1, 2),
totals AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY set_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total FROM slots),
hist AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY set_id, word ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS h FROM counts)"""


def _prequential(history: str, alpha: float = 0.5) -> str:
    """CTEs ending in `bits`: set_id, k, bits."""
    return f"""gain AS (SELECT set_id, k, sum(list_sum(list_transform(range(c), lambda i: log2(h + {alpha} + i)))) AS gain FROM {history} WHERE k > 0 GROUP BY 1, 2)"""


_CURVE = (
    _prequential("hist")
    + """,
curve AS (SELECT s.set_id, s.k, octet_length(encode(s.response)) AS bytes,
  coalesce(list_sum(list_transform(range(t.n), lambda i: log2(t.total + 0.5 * (y.types + 1) + i))) - g.gain, 0) AS bits
  FROM sets s LEFT JOIN totals t USING (set_id, k) LEFT JOIN types y ON y.set_id = s.set_id LEFT JOIN gain g ON g.set_id = s.set_id AND g.k = s.k)"""
)
_ALONE = """ph AS (SELECT a.set_id, a.k, a.c, coalesce(p.c, 0) AS h FROM counts a LEFT JOIN counts p ON p.set_id = a.set_id AND p.word = a.word AND p.k = 0 WHERE a.k > 0),
again AS (SELECT set_id, k, sum(list_sum(list_transform(range(c), lambda i: log2(h + 0.5 + i)))) AS gain FROM ph GROUP BY 1, 2),
pn AS (SELECT set_id, n AS pn FROM slots WHERE k = 0),
alone AS (SELECT s.set_id, s.k, octet_length(encode(s.response)) AS bytes,
  coalesce(list_sum(list_transform(range(t.n), lambda i: log2(coalesce(pn, 0) + 0.5 * (y.types + 1) + i))) - g.gain, 0) AS bits
  FROM sets s LEFT JOIN slots t USING (set_id, k) LEFT JOIN types y ON y.set_id = s.set_id LEFT JOIN pn ON pn.set_id = s.set_id
  LEFT JOIN again g ON g.set_id = s.set_id AND g.k = s.k)"""
_BASE = f"WITH {_SETS}, {_COUNTS}, {_CURVE}"
_FULL = f"{_BASE}, {_ALONE}"
_CURVE_SCORES = """ends AS (SELECT set_id, max(k) AS n, arg_max(bits, k) AS a_n, arg_min(bits, k) AS a_1, arg_max(CASE WHEN bytes > 0 THEN bits / bytes ELSE 0 END, k) AS pb_n FROM curve GROUP BY 1),
steps AS (SELECT set_id, k, bits, bytes, lead(bits) OVER (PARTITION BY set_id ORDER BY k) AS nxt FROM curve),
scores AS (SELECT set_id, any_value(n) AS n, sum(bits - a_n) AS e, sum(CASE WHEN bytes > 0 THEN bits / bytes ELSE 0 END - pb_n) AS e_rate,
  any_value(a_1) AS a_1, any_value(a_n) AS a_n, any_value(pb_n) AS a_n_per_byte, bool_and(nxt IS NULL OR bits >= nxt) AS is_monotone
  FROM steps JOIN ends USING (set_id) GROUP BY 1),
coh AS (SELECT set_id, pow(2.0, -avg(CASE WHEN bytes > 0 THEN bits / bytes ELSE 0 END)) AS c,
  stddev_pop(CASE WHEN bytes > 0 THEN bits / bytes ELSE 0 END) AS sigma, avg(bytes) AS mean_byte_length FROM alone GROUP BY 1)"""


def _upper_tail(z: str) -> str:
    """SQL for the chance of a standard normal value above z, by Simpson's rule over a thousand steps from 0."""
    terms = f"list_transform(range(1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({z} * i / 1000.0, 2) / 2))"
    return f"(0.5 - {z} / 3000.0 / sqrt(2 * pi()) * list_sum({terms}))"


def _t_tails(t: str, df: str) -> str:
    """SQL for the chance of a Student's t as far from 0 as t, on both sides; Simpson's rule again, up to 40, beyond which there is nothing to see with ten degrees of freedom."""
    end = f"(CASE WHEN abs({t}) < 40 THEN abs({t}) WHEN {t} IS NOT NULL THEN 40 END)"
    terms = f"list_transform(range(1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow({end} * i / 1000.0, 2) / {df}, -({df} + 1) / 2))"
    return f"(1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * {end} / 3000.0 * list_sum({terms}))"


def _round(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols.split())


# --- sets, layouts, texts -------------------------------------------------


@query(f"WITH {_SETS} SELECT set_id, any_value(prompt) AS prompt, count(*) AS n, string_agg(response, chr(30) ORDER BY k) AS responses FROM sets GROUP BY 1")
def sets_ordered(spark, sf):
    rows = response_sets(spark, sf).groupBy("set_id").agg(F.first("prompt").alias("prompt"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", "response"))).alias("r"))
    return rows.select("set_id", "prompt", "n", F.array_join(F.transform("r", lambda x: x["response"]), "\x1e").alias("responses"))


_LABEL = "CASE WHEN k <= 26 THEN chr((64 + k)::INTEGER) ELSE chr((64 + (k - 1) // 26)::INTEGER) || chr((65 + (k - 1) % 26)::INTEGER) END"


@query(f"WITH {_SETS} SELECT set_id, k, {_LABEL} AS label FROM sets")
def labels_az(spark, sf):
    return response_sets(spark, sf).select("set_id", "k", T.response_label(F.col("k") - 1).alias("label"))


@query(f"""WITH {_SETS} SELECT set_id, any_value(prompt) || string_agg(chr(10) || chr(10) || 'Response ' || {_LABEL} || ': ' || response, '' ORDER BY k) AS layout
FROM sets GROUP BY set_id""")
def layout_instruct(spark, sf):
    rows = response_sets(spark, sf).groupBy("set_id", "prompt").agg(F.array_sort(F.collect_list(F.struct("k", "response"))).alias("r"))
    return rows.select("set_id", T.instruct_layout(F.col("prompt"), F.transform("r", lambda x: x["response"])).alias("layout"))


@query(f"""WITH {_SETS} SELECT set_id, string_agg(k || '. ' || prompt || ' ' || response, chr(10) || chr(10) ORDER BY k) AS layout FROM sets GROUP BY set_id""")
def layout_completion(spark, sf):
    rows = response_sets(spark, sf).groupBy("set_id", "prompt").agg(F.array_sort(F.collect_list(F.struct("k", "response"))).alias("r"))
    return rows.select("set_id", T.completion_layout(F.col("prompt"), F.transform("r", lambda x: x["response"])).alias("layout"))


@query("SELECT source, lang, count(*) AS n, avg(octet_length(encode(coalesce(text, '')))) AS mean_bytes, avg(length(coalesce(text, ''))) AS mean_chars FROM documents GROUP BY 1, 2")
def byte_lengths(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg(T.n_bytes(F.col("text"))).alias("mean_bytes"), F.avg(F.char_length(F.coalesce("text", F.lit("")))).alias("mean_chars"))


def _cut(n: int) -> str:
    cuts = []
    for back in range(4):
        h = f"left(hex(encode(text)), {2 * (n - back)})"
        after = f"substr(hex(encode(text)), {2 * (n - back) + 1}, 1)"
        cuts.append(f"WHEN {after} NOT IN ('8', '9', 'A', 'B') THEN decode(unhex({h}))")
    return "CASE " + " ".join(cuts) + " END"


@query(f"SELECT doc_id, {_cut(101)} AS prefix FROM documents")
def utf8_prefix(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.utf8_prefix(F.col("text"), 101).alias("prefix"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS collapsed,
CASE WHEN length(text) <= 60 THEN text ELSE coalesce(nullif(regexp_extract(left(text, 60), '(?s)^(.*) ', 1), ''), left(text, 60)) || '...' END AS cut,
upper(left(text, 1)) || substr(text, 2) AS capital, CASE WHEN regexp_matches(lower(text), '^[aeiou]') THEN 'an' ELSE 'a' END AS article,
replace(replace(text, ' ', '▁'), chr(10), '↵') AS shown FROM documents""")
def text_forms(spark, sf):
    t = F.col("text")
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.collapse_blanks(t).alias("collapsed"), T.truncate_words(t, 60).alias("cut"), T.capitalized(t).alias("capital"), T.article(t).alias("article"), T.token_display(t).alias("shown"))


@query(r"""SELECT DISTINCT p_name, trim(regexp_replace(lower(regexp_extract('org/' || p_name, '([^/]*)/?$', 1)), '[^a-z0-9.]+', '-', 'g'), '-') AS tag,
replace(replace('{brand}: {name}', '{brand}', p_brand), '{name}', p_name) AS filled FROM part""")
def run_tags(spark, sf):
    part = table(spark, sf, "part")
    values = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"))
    return part.select("p_name", T.run_tag(F.concat(F.lit("org/"), F.col("p_name"))).alias("tag"), T.fill_slots(F.lit("{brand}: {name}"), values).alias("filled")).distinct()


# --- lexical and embedding diversity --------------------------------------


def _groups(spark, sf):
    return table(spark, sf, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("text"))


def _ngram_sql(words: str, text: str = "coalesce(text, '')", sizes: str = "1, 2, 3, 4, 5") -> str:
    return f"""w AS (SELECT source, lang, {words.format(t=text)} AS w FROM documents),
g AS (SELECT source, lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS gram FROM w, (SELECT unnest([{sizes}]) AS n)),
grid AS (SELECT DISTINCT source, lang, n FROM documents, (SELECT unnest([{sizes}]) AS n)),
d AS (SELECT grid.source, grid.lang, grid.n, count(DISTINCT gram) AS uniq, count(gram) AS total, coalesce(count(DISTINCT gram) / nullif(count(gram), 0), 0) AS distinct_n
  FROM grid LEFT JOIN g ON g.source = grid.source AND g.lang = grid.lang AND g.n = grid.n GROUP BY ALL)"""


_DOT = "list_filter(string_split(replace(replace({t}, '.', ''), chr(10), ''), ' '), lambda x: x <> '')"
_WS = _words("{t}")


@query(f"WITH {_ngram_sql(_DOT)} SELECT source, lang, n, uniq, total, round(distinct_n, 6) AS \"distinct\" FROM d")
def distinct_n_dot(spark, sf):
    return rounded(lexical.distinct_ngrams(_groups(spark, sf), ["source", "lang"], T.dot_words))


@query(f"WITH {_ngram_sql(_WS)} SELECT source, lang, n, uniq, total, round(distinct_n, 6) AS \"distinct\" FROM d")
def distinct_n_ws(spark, sf):
    return rounded(lexical.distinct_ngrams(_groups(spark, sf), ["source", "lang"], T.ws_words))


@query(f"WITH {_ngram_sql(_DOT)} SELECT source, lang, round(avg(distinct_n), 6) AS avg_distinct FROM d GROUP BY 1, 2")
def distinct_n_avg(spark, sf):
    d = lexical.distinct_ngrams(_groups(spark, sf), ["source", "lang"], T.dot_words)
    return rounded(lexical.averaged_distinct(d, ["source", "lang"]).drop("per_n"))


@query(f"""WITH {_ngram_sql(_WS)} SELECT source, lang, round(avg(CASE WHEN total = 0 THEN 0 ELSE uniq / (50257 * (1 - pow(50256.0::DOUBLE / 50257, total))) END), 6) AS ead FROM d GROUP BY 1, 2""")
def ead_avg(spark, sf):
    d = lexical.distinct_ngrams(_groups(spark, sf), ["source", "lang"], T.ws_words)
    return rounded(lexical.expectation_adjusted(d, ["source", "lang"]))


@query(f"""WITH {_ngram_sql(_DOT, sizes='1, 2')}, a AS (SELECT lang, avg(distinct_n) AS raw FROM (SELECT source, lang, avg(distinct_n) AS distinct_n FROM d GROUP BY 1, 2) GROUP BY 1),
{_ngram_sql(_DOT, text="lower(coalesce(text, ''))", sizes='1, 2').replace('w AS (', 'w2 AS (', 1).replace(' FROM w,', ' FROM w2,').replace('g AS (', 'g2 AS (', 1).replace('LEFT JOIN g ON', 'LEFT JOIN g2 g ON').replace('grid AS (', 'grid2 AS (').replace('FROM grid LEFT', 'FROM grid2 grid LEFT').replace('d AS (SELECT grid', 'd2 AS (SELECT grid')},
b AS (SELECT lang, avg(distinct_n) AS lowered FROM (SELECT source, lang, avg(distinct_n) AS distinct_n FROM d2 GROUP BY 1, 2) GROUP BY 1)
SELECT lang, round(raw, 6) AS raw, round(lowered, 6) AS lowered FROM a JOIN b USING (lang)""")
def distinct_n_case(spark, sf):
    keys = ["source", "lang"]

    def mean(lowered: bool, name: str) -> DataFrame:
        texts = _groups(spark, sf)
        texts = texts.withColumn("text", F.lower("text")) if lowered else texts
        d = lexical.averaged_distinct(lexical.distinct_ngrams(texts, keys, T.dot_words, (1, 2)), keys)
        return d.groupBy("lang").agg(F.avg("avg_distinct").alias(name))

    return rounded(mean(False, "raw").join(mean(True, "lowered"), "lang"))


_COS = """u AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS u FROM embeddings),
d AS (SELECT label, unnest(u) AS v, generate_subscripts(u, 1) AS i FROM u),
s AS (SELECT label, i, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM d GROUP BY 1, 2),
m AS (SELECT label, max(n) AS n, sum(s * s - q) / (max(n) * (max(n) - 1)) AS mean_cosine FROM s GROUP BY 1)"""


@query(f"WITH {_COS} SELECT label, n, round(mean_cosine, 6) AS mean_cosine FROM m")
def cosine_mean(spark, sf):
    return rounded(lexical.mean_pairwise_cosine(table(spark, sf, "embeddings"), ["label"]))


@query(f"WITH {_COS} SELECT label, round(-mean_cosine, 6) AS negated, round(1 - mean_cosine, 6) AS one_minus FROM m")
def embedding_diversity(spark, sf):
    rows = table(spark, sf, "embeddings")
    a = lexical.mean_pairwise_cosine(rows, ["label"]).select("label", (-F.col("mean_cosine")).alias("negated"))
    b = lexical.mean_pairwise_cosine(rows, ["label"], clip=1e-8).select("label", (1 - F.col("mean_cosine")).alias("one_minus"))
    return rounded(a.join(b, "label"))


# --- curves and scores ----------------------------------------------------


@query(f"WITH {_SETS} SELECT set_id, k, round(len({_words('response')}) * log2(50257), 6) AS bits, octet_length(encode(response)) AS bytes FROM sets")
def uniform_curve(spark, sf):
    return rounded(scorers.uniform(response_sets(spark, sf), ["set_id"], 50_257))


@query(f"{_BASE} SELECT set_id, k, round(bits, 4) + 0.0 AS bits, bytes FROM curve")
def preq_curve(spark, sf):
    return rounded(scorers.prequential(response_sets(spark, sf), ["set_id"]), 4)


@query(f"{_FULL} SELECT set_id, k, round(bits, 4) + 0.0 AS bits, bytes FROM alone")
def preq_uncond(spark, sf):
    return rounded(scorers.prequential(response_sets(spark, sf), ["set_id"], alone=True), 4)


@query(f"""WITH {_SETS}, raw AS (SELECT set_id, k, unnest({_words('response')}) AS word, generate_subscripts({_words('response')}, 1) - 1 AS t FROM sets
  UNION ALL SELECT set_id, 0, unnest({_words('prompt')}), generate_subscripts({_words('prompt')}, 1) - 1 FROM sets WHERE k = 1),
ty AS (SELECT set_id, count(DISTINCT word) AS types FROM raw GROUP BY 1),
b AS (SELECT *, -log2((row_number() OVER (PARTITION BY set_id, word ORDER BY k, t) - 0.5) / (row_number() OVER (PARTITION BY set_id ORDER BY k, t) - 1 + 0.5 * (types + 1))) AS bits FROM raw JOIN ty USING (set_id))
SELECT set_id, k, t::INTEGER AS t, word, round(bits, 6) + 0.0 AS bits FROM b WHERE k > 0""")
def token_bits(spark, sf):
    return rounded(scorers.token_bits(response_sets(spark, sf), ["set_id"]))


_ALL_SCORES = f"""{_FULL}, {_CURVE_SCORES}, r AS (SELECT *, c * a_n_per_byte AS d_c_an, c * e AS d_c_e, c * e_rate AS d_c_e_rate, c * pow(2.0, sigma) AS c_plus,
c * pow(2.0, -sigma) AS c_minus, c * pow(2.0, sigma) * e_rate AS d_plus, c * pow(2.0, -sigma) * e_rate AS d_minus FROM scores JOIN coh USING (set_id))"""
_SCORE_NAMES = "e e_rate a_1 a_n a_n_per_byte c sigma mean_byte_length d_c_an d_c_e d_c_e_rate c_plus c_minus d_plus d_minus"


def _scores(spark, sf):
    sets = response_sets(spark, sf)
    return curves.diversity(scorers.prequential(sets, ["set_id"]), scorers.prequential(sets, ["set_id"], alone=True), ["set_id"])


@query(f"{_ALL_SCORES} SELECT set_id, n, is_monotone, {_round(_SCORE_NAMES, 4)} FROM r")
def diversity_scores(spark, sf):
    return rounded(_scores(spark, sf), 4)


@query(f"{_ALL_SCORES} SELECT n AS scale, count(*) AS sets, count_if(is_monotone)::BIGINT AS monotone, {', '.join(f'round(avg({c}), 4) + 0.0 AS {c}' for c in 'd_c_an d_c_e e e_rate c sigma'.split())} FROM r GROUP BY n")
def scale_means(spark, sf):
    s = _scores(spark, sf)
    return rounded(s.groupBy(F.col("n").alias("scale")).agg(F.count("*").alias("sets"), F.count_if("is_monotone").alias("monotone"), *[F.avg(c).alias(c) for c in ("d_c_an", "d_c_e", "e", "e_rate", "c", "sigma")]), 4)


@query(f"""WITH {_SETS}, {_COUNTS}, temps AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS temperature),
z AS (SELECT set_id, temperature, k, sum(c) AS n, sum(c * log2(h + 0.5) / temperature) AS gain, sum(pow(h + c + 0.5, 1 / temperature) - pow(h + 0.5, 1 / temperature)) AS delta FROM hist, temps GROUP BY ALL),
y AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY set_id, temperature ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grown FROM z),
b AS (SELECT y.set_id, temperature, k, n * log2((types + 1) * pow(0.5, 1 / temperature) + grown) - gain AS bits FROM y JOIN types USING (set_id) WHERE k > 0)
SELECT s.set_id, temps.temperature, s.k, round(coalesce(bits, 0), 4) + 0.0 AS bits, octet_length(encode(response)) AS bytes
FROM sets s CROSS JOIN temps LEFT JOIN b ON b.set_id = s.set_id AND b.k = s.k AND b.temperature = temps.temperature""")
def multi_temperature(spark, sf):
    return rounded(scorers.static(response_sets(spark, sf), ["set_id"], (0.5, 1.0, 2.0)), 4)


@query(f"""WITH {_SETS}, {_COUNTS}, b AS (SELECT hist.set_id, hist.k, sum(-c * log2(greatest(((h + 0.1) / (total + 0.1 * (types + 1)) + (h + 1.0) / (total + 1.0 * (types + 1))) / 2, 1e-45))) AS bits
FROM hist JOIN totals USING (set_id, k) JOIN types ON types.set_id = hist.set_id WHERE k > 0 GROUP BY 1, 2)
SELECT s.set_id, s.k, round(coalesce(bits, 0), 4) + 0.0 AS bits, octet_length(encode(response)) AS bytes FROM sets s LEFT JOIN b USING (set_id, k)""")
def ensemble(spark, sf):
    return rounded(scorers.ensemble(response_sets(spark, sf), ["set_id"], (0.1, 1.0)), 4)


PERMS = 3
_PERM_SETS = f"""{_SETS}, base AS (SELECT * FROM sets), psets AS (SELECT set_id * {PERMS} + perm AS set_id, row_number() OVER (PARTITION BY set_id, perm ORDER BY md5(perm || ':' || k), k) AS k, prompt, response
FROM base, (SELECT unnest(range({PERMS})) AS perm))"""
_PERM_BASE = f"WITH {_PERM_SETS}, " + f"{_COUNTS}, {_CURVE}".replace("FROM sets", "FROM psets")
_PERM_CURVE = f"{_PERM_BASE}, pcurve AS (SELECT set_id // {PERMS} AS set_id, set_id % {PERMS} AS perm, k, bits, bytes FROM curve)"


def _perm_curves(spark, sf):
    return scorers.prequential(scorers.hash_permutations(response_sets(spark, sf), ["set_id"], PERMS), ["set_id", "perm"])


@query(f"{_PERM_CURVE} SELECT set_id, perm, k, round(bits, 4) + 0.0 AS bits, bytes FROM pcurve")
def perm_curves(spark, sf):
    return rounded(_perm_curves(spark, sf).withColumn("perm", F.col("perm").cast("long")), 4)


@query(f"{_PERM_CURVE} SELECT set_id, k, round(avg(bits / nullif(bytes, 0)), 6) + 0.0 AS per_byte FROM pcurve GROUP BY 1, 2")
def mor_curve(spark, sf):
    return rounded(curves.mean_of_ratios(_perm_curves(spark, sf), ["set_id"]))


@query(f"{_PERM_CURVE} SELECT set_id, k, round(coalesce(avg(bits) / nullif(avg(bytes), 0), 0), 6) + 0.0 AS per_byte FROM pcurve GROUP BY 1, 2")
def rom_curve(spark, sf):
    return rounded(curves.ratio_of_means(_perm_curves(spark, sf), ["set_id"]))


@query(f"{_PERM_CURVE} SELECT set_id, k, round(avg(bits), 4) + 0.0 AS bits, round(avg(CASE WHEN bytes > 0 THEN bits / bytes ELSE 0 END), 6) + 0.0 AS per_byte, round_even(avg(bytes), 0)::BIGINT AS bytes FROM pcurve GROUP BY 1, 2")
def perm_mean_curve(spark, sf):
    m = curves.mean_curves(_perm_curves(spark, sf), ["set_id"])
    return m.select("set_id", "k", (F.round("bits", 4) + 0.0).alias("bits"), (F.round("per_byte", 6) + 0.0).alias("per_byte"), "bytes")


@query()
def perm_std(spark, sf):
    alone = scorers.prequential(response_sets(spark, sf), ["set_id"], alone=True)
    return rounded(curves.permutation_spread(_perm_curves(spark, sf), alone, ["set_id"]), 4)


TEMPERATURES = (0.5, 1.0, 2.0)
_HOT_SCORES = f"""WITH {_SETS}, {_COUNTS}, {_CURVE}, {_ALONE}, coh AS (SELECT set_id, pow(2.0, -avg(CASE WHEN bytes > 0 THEN bits / bytes ELSE 0 END)) AS c FROM alone GROUP BY 1),
p0 AS (SELECT set_id, perm, row_number() OVER (PARTITION BY set_id, perm ORDER BY md5(perm || ':' || k), k) AS k, prompt, response FROM sets, (SELECT unnest(range({PERMS})) AS perm)),
pw AS (SELECT set_id, perm, k, unnest({_words('response')}) AS word FROM p0 UNION ALL SELECT set_id, perm, 0, unnest({_words('prompt')}) FROM p0 WHERE k = 1),
pc AS (SELECT set_id, perm, k, word, count(*) AS c FROM pw GROUP BY ALL),
before AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY set_id, perm, word ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM pc),
z AS (SELECT set_id, perm, t, k, sum(c) AS n, sum(c * log2(h + 0.5) / t) AS gain, sum(pow(h + c + 0.5, 1 / t) - pow(h + 0.5, 1 / t)) AS delta FROM before, (SELECT unnest({list(TEMPERATURES)}::DOUBLE[]) AS t) GROUP BY ALL),
y AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY set_id, perm, t ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grown FROM z),
b AS (SELECT set_id, perm, t, k, n * log2((types + 1) * pow(0.5, 1 / t) + grown) - gain AS bits FROM y JOIN types USING (set_id) WHERE k > 0),
full_curve AS (SELECT p0.set_id, p0.perm, x.t AS temperature, p0.k, coalesce(bits, 0) AS bits FROM p0 CROSS JOIN (SELECT unnest({list(TEMPERATURES)}::DOUBLE[]) AS t) x LEFT JOIN b ON b.set_id = p0.set_id AND b.perm = p0.perm AND b.t = x.t AND b.k = p0.k),
pe AS (SELECT set_id, temperature, perm, count(*) AS n, sum(bits) - count(*) * arg_max(bits, k) AS e FROM full_curve GROUP BY 1, 2, 3),
pd AS (SELECT set_id, temperature, perm, n, e, c * e AS d FROM pe JOIN coh USING (set_id))"""


def _hot_scores(spark, sf):
    """Scores of every permutation at every temperature, with the coherence of the set at temperature 1."""
    sets = response_sets(spark, sf)
    hot = scorers.static(scorers.hash_permutations(sets, ["set_id"], PERMS), ["set_id", "perm"], TEMPERATURES)
    return curves.permutation_scores(hot, scorers.prequential(sets, ["set_id"], alone=True), ["set_id"], ["temperature"])


@query(f"{_HOT_SCORES} SELECT set_id, temperature, perm, n, {_round('e d', 4)} FROM pd")
def permutation_scores(spark, sf):
    return rounded(_hot_scores(spark, sf).select("set_id", "temperature", F.col("perm").cast("long"), "n", "e", "d"), 4)


@query(f"""{_HOT_SCORES}, s AS (SELECT set_id, temperature, round(stddev_pop(d), 6) AS sd FROM pd GROUP BY 1, 2),
x AS (SELECT o.temperature, o.sd, r.sd AS ref, round(r.sd - o.sd, 6) AS diff FROM s o JOIN s r ON r.set_id = o.set_id AND r.temperature = 1 AND o.temperature <> 1),
m AS (SELECT temperature, count(*) AS units, avg(sd) AS mean_sd, avg(ref) AS ref_mean_sd, count_if(diff <> 0)::BIGINT AS n FROM x GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY temperature ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY temperature, abs(diff)) - 1) / 2.0 AS r FROM x WHERE diff <> 0),
t AS (SELECT temperature, sum(c * c * c - c) AS ties FROM (SELECT temperature, count(*)::DOUBLE AS c FROM r GROUP BY temperature, abs(diff)) GROUP BY 1),
w AS (SELECT temperature, sum(CASE WHEN diff > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus FROM r GROUP BY 1),
q AS (SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) AS z FROM m JOIN w USING (temperature) JOIN t USING (temperature))
SELECT temperature, units, {_round("mean_sd ref_mean_sd", 4)}, n, w_plus, round(z, 5) + 0.0 AS z, round({_upper_tail("z")}, 5) + 0.0 AS p, {_upper_tail("z")} < 0.05 AS reject FROM q""")
def spread_reduction(spark, sf):
    """Whether D spreads less over permutations at other temperatures than at 1. (The twin has the normal tail, which more than 50 sets take.)"""
    spread = rounded(temperatures.spreads(_hot_scores(spark, sf), ["set_id"]))
    found = temperatures.spread_reduction(spread, ["set_id"])
    return found.select("temperature", "units", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean_sd", "ref_mean_sd")], "n", "w_plus", *[(F.round(c, 5) + 0.0).alias(c) for c in ("z", "p")], "reject")


@query()
def temperature_order(spark, sf):
    """Whether sixteen parts of the conversations keep the order of their fitted diversity at other temperatures."""
    sets = response_sets(spark, sf)
    part = (F.col("set_id") % 16).alias("part")
    curve = scorers.static(sets, ["set_id"], TEMPERATURES).select(part, "temperature", "k", "bits")
    c = curves.coherence(scorers.prequential(sets, ["set_id"], alone=True), ["set_id"]).select(part, "c")
    return rounded(temperatures.order_preservation(temperatures.fitted_diversity(curve, c, ["part"]), "part"), 3)


_TOKENS = f"""raw AS (SELECT set_id, k, unnest({_words('response')}) AS word, generate_subscripts({_words('response')}, 1) AS i FROM sets)"""


@query(f"""WITH {_SETS}, spans AS (SELECT set_id, k, (sum(length(response)) OVER w - length(response))::BIGINT AS s_start, (sum(length(response)) OVER w)::BIGINT AS s_end FROM sets WINDOW w AS (PARTITION BY set_id ORDER BY k)),
size AS (SELECT set_id, max(s_end) AS total FROM spans GROUP BY 1),
tokens AS (SELECT set_id, t, 7 * t AS c_start, 7 * t + 7 AS c_end FROM (SELECT set_id, unnest(range((total + 6) // 7)) AS t FROM size))
SELECT s.set_id, s.k, min(t) AS first, max(t) + 1 AS stop, count(*)::DOUBLE AS bits FROM tokens t JOIN spans s ON s.set_id = t.set_id AND c_end > s_start AND c_start < s_end WHERE s_end > s_start GROUP BY 1, 2""")
def span_overlap(spark, sf):
    """Tokens of seven characters over the joined responses: those at a border belong to both sides."""
    order = Window.partitionBy("set_id").orderBy("k")
    size = F.char_length("response").cast("long")
    spans = response_sets(spark, sf).select("set_id", "k", (F.sum(size).over(order) - size).alias("s_start"), F.sum(size).over(order).alias("s_end"))
    total = spans.groupBy("set_id").agg(F.max("s_end").alias("total")).where("total > 0")
    total = total.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "set_id", "total")  # few bytes, from which many tokens come
    tokens = total.select("set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 7))).alias("t"))
    tokens = tokens.select("set_id", "t", (F.col("t") * 7).alias("c_start"), (F.col("t") * 7 + 7).alias("c_end"), F.lit(1.0).alias("bits"))
    return scorers.span_overlap(tokens, spans.where("s_end > s_start"), ["set_id"])


# --- joins, sets, checks --------------------------------------------------


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf):
    return tables.remaining(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, source, lang FROM documents WHERE source NOT IN (SELECT source FROM documents d JOIN labels l USING (doc_id) GROUP BY source HAVING count(DISTINCT lang) >= 4)")
def complete_semi(spark, sf):
    docs = table(spark, sf, "documents")
    done = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return tables.incomplete(docs, done, ["source"], "lang", 4).select("doc_id", "source", "lang")


@query("""SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 2000)""")
def skip_reconcile(spark, sf):
    docs = table(spark, sf, "documents")
    missing = tables.remaining(docs, table(spark, sf, "labels"), ["doc_id"])
    return tables.unexplained(missing, docs.where("n_chars < 2000"), ["doc_id"])


def _stage_means(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("score"), F.count("*").alias("n"))


_MEANS = "m AS (SELECT source, lang, avg(n_chars) AS score, count(*) AS n FROM documents GROUP BY 1, 2)"
_PAIR = f"WITH {_MEANS}, p AS (SELECT a.source, a.score AS a, b.score AS b, a.score - b.score AS diff FROM m a JOIN m b USING (source) WHERE a.lang = 'en' AND b.lang = 'de')"


def _pairs(spark, sf):
    return tables.paired(_stage_means(spark, sf), "lang", "source", "score", "en", "de")


@query(f"{_PAIR} SELECT source, {_round('a b diff')} FROM p")
def paired_stage(spark, sf):
    return rounded(_pairs(spark, sf))


@query(f"WITH {_MEANS} SELECT source FROM m GROUP BY 1 HAVING count(DISTINCT lang) = 4")
def nway_common(spark, sf):
    return tables.complete_keys(_stage_means(spark, sf), "lang", "source", 4)


_EN = "SELECT DISTINCT text FROM documents WHERE lang = 'en'"
_QUALITY = "SELECT DISTINCT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1"


def _en_and_good(spark, sf):
    docs = table(spark, sf, "documents")
    good = docs.join(table(spark, sf, "labels").where("quality = 1"), "doc_id")
    return docs.where("lang = 'en'").select("text").distinct(), good.select("text").distinct()


@query(f"SELECT md5(text) AS h FROM ({_EN} INTERSECT {_QUALITY})")
def set_intersect(spark, sf):
    a, b = _en_and_good(spark, sf)
    return a.intersect(b).select(F.md5(F.col("text").cast("binary")).alias("h"))


@query(f"SELECT md5(text) AS h FROM ({_EN} EXCEPT {_QUALITY})")
def set_except(spark, sf):
    a, b = _en_and_good(spark, sf)
    return a.subtract(b).select(F.md5(F.col("text").cast("binary")).alias("h"))


@query(f"SELECT md5(text) AS h, side FROM (SELECT *, 'left' AS side FROM ({_EN} EXCEPT {_QUALITY}) UNION ALL SELECT *, 'right' AS side FROM ({_QUALITY} EXCEPT {_EN}))")
def set_symdiff(spark, sf):
    a, b = _en_and_good(spark, sf)
    return tables.symmetric_difference(a, b).select(F.md5(F.col("text").cast("binary")).alias("h"), "side")


@query("SELECT md5(text) AS h, count(DISTINCT source) AS labels, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def conflict_labels(spark, sf):
    return tables.conflicting(table(spark, sf, "documents"), "text", "source").select(F.md5(F.col("text").cast("binary")).alias("h"), "labels", "n")


@query("""WITH k AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY h) = 1 THEN h
ELSE h || '__row' || row_number() OVER (PARTITION BY h ORDER BY doc_id) END AS unique_key FROM k""")
def dup_keys(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return tables.disambiguate(rows, "h", "doc_id").select("doc_id", "unique_key")


@query("SELECT text_id, arg_max(doc_id, doc_id) AS doc_id, count(*) AS n FROM (SELECT md5(text) AS text_id, doc_id FROM documents) GROUP BY 1")
def last_wins(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_id"))
    return tables.last_wins(rows, ["text_id"], "doc_id").join(rows.groupBy("text_id").agg(F.count("*").alias("n")), "text_id")


@query("""SELECT d.doc_id, coalesce(a.quality, b.quality) AS quality FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id - 1""")
def fallback_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") - 1).alias("legacy_id"))
    return tables.lookup(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("key"), "quality"), "doc_id", "legacy_id", "key", "quality").select("doc_id", "quality")


@query("""WITH a AS (SELECT source, avg(n_chars) AS v FROM documents WHERE lang IN ('en', 'de') GROUP BY 1), b AS (SELECT source, avg(length(text)) AS v FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1)
SELECT source, round(a.v, 6) AS left_value, round(b.v, 6) AS right_value FROM a FULL JOIN b USING (source) WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 50""")
def drift_report(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.where("lang in ('en', 'de')").groupBy("source").agg(F.avg("n_chars").alias("v"))
    b = docs.where("lang in ('en', 'fr')").groupBy("source").agg(F.avg(F.char_length("text")).alias("v"))
    return rounded(tables.drift(a, b, ["source"], "v", 50))


@query("""WITH m AS (SELECT doc_id, n_chars::DOUBLE AS chars, octet_length(encode(text))::DOUBLE AS bytes, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS lines FROM documents)
UNPIVOT m ON chars, bytes, lines INTO NAME metric VALUE score""")
def wide_unpivot(spark, sf):
    return tables.unpivot_metrics(_doc_metrics(spark, sf), ["doc_id"], ["chars", "bytes", "lines"])


@query("SELECT source, quality, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def labelled_join(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rounded(rows.groupBy("source", "quality").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark, sf):
    props = F.from_json("props", "map<string,string>")
    rows = table(spark, sf, "events").select("event_id", "props", F.json_object_keys("props").alias("keys"))
    return rows.select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.element_at("keys", 1)).alias("first_value"), F.size("keys").cast("long").alias("n_keys"))


# --- lengths --------------------------------------------------------------


def _doc_metrics(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.col("n_chars").cast("double").alias("chars"), T.n_bytes(F.col("text")).cast("double").alias("bytes"), F.size(F.split("text", "\n")).cast("double").alias("lines")
    )


@query("SELECT source, min(octet_length(encode(text))) AS min_bytes, arg_min(lang, struct_pack(b := octet_length(encode(text)), d := doc_id)) AS lang, arg_min(doc_id, struct_pack(b := octet_length(encode(text)), d := doc_id)) AS doc_id FROM documents GROUP BY 1")
def shortest_by_prompt(spark, sf):
    rows = table(spark, sf, "documents").select("source", "lang", "doc_id", F.col("text").alias("response"), F.col("doc_id").alias("ord"))
    return length.shortest(rows, "source", ["lang", "doc_id"], "ord")


@query("""WITH p AS (SELECT lang, source, min(octet_length(encode(text))) AS t FROM documents GROUP BY 1, 2 HAVING min(octet_length(encode(text))) >= 50)
SELECT d.doc_id, octet_length(encode(d.text)) AS original_bytes, p.t AS truncation_bytes FROM documents d JOIN p USING (lang, source)""")
def length_match(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("prompt"), F.col("text").alias("response"))
    out = length.length_matched(rows, "prompt", 50)
    return out.select("doc_id", "original_bytes", "truncation_bytes")


@query("""SELECT lang, count(*) AS n, min(x) AS min, quantile_cont(x, 0.5) AS median, round(avg(x), 6) AS mean, max(x) AS max, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90,
round(stddev_samp(x) / avg(x), 6) AS cv FROM (SELECT lang, n_chars::DOUBLE AS x FROM documents) GROUP BY 1""")
def length_report(spark, sf):
    return rounded(length.length_report(table(spark, sf, "documents"), ["lang"], "n_chars"))


@query("""WITH r AS (SELECT lang, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
p AS (SELECT *, greatest(1, least(n, 0.1 * (n + 1)))::DOUBLE AS p FROM r)
SELECT lang, round(sum(CASE WHEN r = floor(p) THEN (1 - (p - floor(p))) * v ELSE (p - floor(p)) * v END), 4) AS quantile FROM p WHERE r = floor(p) OR r = floor(p) + 1 GROUP BY 1""")
def exclusive_quantile(spark, sf):
    return rounded(length.exclusive_quantile(table(spark, sf, "documents"), ["lang"], "n_chars", 0.1), 4)


@query("""WITH b AS (SELECT CASE WHEN n_chars >= 0 AND n_chars < 500 THEN 0 WHEN n_chars < 1500 THEN 1 WHEN n_chars < 5000 THEN 2 WHEN n_chars < 1000000 THEN 3 END AS bin, quality FROM documents JOIN labels USING (doc_id))
SELECT bin, count(*) AS n, round(avg(quality), 6) AS mean_label, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END), 6) AS gap FROM b GROUP BY 1""")
def length_bins(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    share = lambda v: F.avg(F.when(F.col("quality") == v, 1.0).otherwise(0.0))
    return rounded(tables.binned(rows, "n_chars", [0, 500, 1500, 5000, 1_000_000]).groupBy("bin").agg(F.count("*").alias("n"), F.avg("quality").alias("mean_label"), (share(1) - share(0)).alias("gap")))


@query(f"""WITH {_MEANS}, s AS (SELECT source, lang, score - lag(score) OVER (PARTITION BY source ORDER BY lang) AS d FROM m)
SELECT source, coalesce(bool_and(d > 0), false) AS rising, coalesce(bool_and(d < 0), false) AS falling FROM s GROUP BY 1""")
def monotone_trend(spark, sf):
    return length.monotone_trend(_stage_means(spark, sf), ["source"], "lang", "score")


# --- statistics -----------------------------------------------------------


def _labelled(spark, sf):
    return _doc_metrics(spark, sf).join(table(spark, sf, "labels"), "doc_id")


_LAB = "l AS (SELECT d.doc_id, lang, source, n_chars::DOUBLE AS chars, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS lines, quality, toxic FROM documents d JOIN labels USING (doc_id))"
_RANK = "(rank() OVER (PARTITION BY lang ORDER BY {x}) + (count(*) OVER (PARTITION BY lang, {x}) - 1) / 2.0)"


@query(f"WITH {_LAB}, r AS (SELECT lang, {_RANK.format(x='chars')} AS a, {_RANK.format(x='lines')} AS b FROM l) SELECT lang, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman(spark, sf):
    return rounded(stats.spearman(_labelled(spark, sf), ["lang"], "chars", "lines"))


@query(f"WITH {_LAB} SELECT lang, count(*) AS n, round(corr(chars, lines), 6) AS r FROM l GROUP BY 1")
def pearson(spark, sf):
    return rounded(stats.pearson(_labelled(spark, sf), ["lang"], "chars", "lines"))


@query(f"""WITH {_MEANS}, c AS (SELECT lang, round(score) AS x, n AS y FROM m), p AS (SELECT a.lang, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM (SELECT *, row_number() OVER () AS i FROM c) a JOIN (SELECT *, row_number() OVER () AS i FROM c) b ON a.lang = b.lang AND a.i < b.i),
q AS (SELECT lang, count(*) AS n FROM c GROUP BY 1)
SELECT lang, any_value(n) AS n, round(sum(s) / sqrt((count(*) - count_if(tx))::DOUBLE * (count(*) - count_if(ty))), 6) AS tau FROM p JOIN q USING (lang) GROUP BY 1""")
def kendall(spark, sf):
    return rounded(stats.kendall(_stage_means(spark, sf).withColumn("score", F.round("score")), ["lang"], "score", "n").select("lang", "n", "tau"))


@query(f"""WITH p AS (SELECT lang, n_chars::DOUBLE AS x, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS y, count(*)::DOUBLE AS c FROM documents WHERE text IS NOT NULL GROUP BY ALL),
q AS (SELECT a.lang, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM p a JOIN p b USING (lang) GROUP BY 1),
tx AS (SELECT lang, sum(t * (t - 1) / 2) AS x0, sum(t * (t - 1) * (t - 2)) AS x1, sum(t * (t - 1) * (2 * t + 5)) AS x2 FROM (SELECT lang, sum(c) AS t FROM p GROUP BY lang, x) GROUP BY 1),
ty AS (SELECT lang, sum(t * (t - 1) / 2) AS y0, sum(t * (t - 1) * (t - 2)) AS y1, sum(t * (t - 1) * (2 * t + 5)) AS y2 FROM (SELECT lang, sum(c) AS t FROM p GROUP BY lang, y) GROUP BY 1),
n AS (SELECT lang, sum(c) AS n FROM p GROUP BY 1),
z AS (SELECT lang, n, s, s / (sqrt(n * (n - 1) / 2 - x0) * sqrt(n * (n - 1) / 2 - y0)) AS tau,
  s / sqrt((n * (n - 1) * (2 * n + 5) - x2 - y2) / 18 + 2 * x0 * y0 / (n * (n - 1)) + x1 * y1 / (9 * n * (n - 1) * (n - 2))) AS z FROM n JOIN q USING (lang) JOIN tx USING (lang) JOIN ty USING (lang))
SELECT lang, n::BIGINT AS n, round(tau, 6) + 0.0 AS tau, s, round(z, 6) + 0.0 AS z, round(2 * {_upper_tail('abs(z)')}, 6) + 0.0 AS p FROM z""")
def kendall_points(spark, sf):
    """Length against number of lines over all documents of a language."""
    return rounded(stats.kendall(_doc_metrics(spark, sf), ["lang"], "chars", "lines"))


_U = f"""r AS (SELECT lang, quality, {_RANK.format(x='chars')} AS r FROM l), t AS (SELECT lang, sum(c * c * c - c) AS ties FROM (SELECT lang, chars, count(*)::DOUBLE AS c FROM l GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT lang, count_if(quality = 1)::BIGINT AS n_pos, count_if(quality = 0)::BIGINT AS n_neg, sum(CASE WHEN quality = 1 THEN r END) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2.0 AS u FROM r GROUP BY 1)"""


@query(f"""WITH {_LAB}, {_U} SELECT lang, n_pos, n_neg, u::DOUBLE AS u, round(CASE WHEN n_pos >= 2 AND n_neg >= 2 THEN u / (n_pos * n_neg) END, 6) AS auc,
round((u - n_pos * n_neg / 2.0 - 0.5) / nullif(sqrt(n_pos * n_neg / 12.0 * (n_pos + n_neg + 1 - ties / ((n_pos + n_neg) * (n_pos + n_neg - 1)))), 0), 6) AS z FROM u JOIN t USING (lang)""")
def mann_whitney_auc(spark, sf):
    return rounded(stats.rank_sum(_labelled(spark, sf), ["lang"], "chars", "quality"))


@query(f"""WITH {_LAB}, o AS (SELECT lang, row_number() OVER w AS pos, sum(quality) OVER w AS tp, sum(1 - quality) OVER w AS fp FROM l WINDOW w AS (PARTITION BY lang ORDER BY chars DESC, doc_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT lang, sum(quality) AS p, sum(1 - quality) AS q FROM l GROUP BY 1) SELECT o.lang, pos::INTEGER AS pos, round(fp / nullif(q, 0), 6) AS fpr, round(tp / nullif(p, 0), 6) AS tpr FROM o JOIN n USING (lang)""")
def roc(spark, sf):
    return rounded(stats.roc_points(_labelled(spark, sf), ["lang"], "chars", "quality", "doc_id"))


@query(f"""WITH {_LAB}, c AS (SELECT lang, chars, sum(quality) AS p, sum(1 - quality) AS q FROM l GROUP BY 1, 2),
r AS (SELECT lang, sum(p) OVER w + sum(q) OVER (PARTITION BY lang) - sum(q) OVER w AS hit, sum(q) OVER (PARTITION BY lang) AS none, sum(p + q) OVER (PARTITION BY lang) AS n FROM c WINDOW w AS (PARTITION BY lang ORDER BY chars DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, max(n)::BIGINT AS n, round(greatest(max(hit), max(none)) / max(n), 6) AS oca FROM r GROUP BY 1""")
def oca_best(spark, sf):
    return rounded(stats.best_threshold_accuracy(_labelled(spark, sf), ["lang"], "chars", "quality"))


@query(f"""WITH {_LAB}, m AS (SELECT lang, quantile_cont(chars, 0.5) AS m FROM l GROUP BY 1) SELECT lang, count(*) AS n, round(avg(CASE WHEN (chars > m)::INTEGER = quality THEN 1.0 ELSE 0.0 END), 6) AS oca FROM l JOIN m USING (lang) GROUP BY 1""")
def oca_median(spark, sf):
    return rounded(stats.median_split_accuracy(_labelled(spark, sf), ["lang"], "chars", "quality"))


@query(f"""{_PAIR}, d AS (SELECT abs(diff) AS a, diff > 0 AS s FROM p WHERE diff <> 0), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM d),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY a))
SELECT 1 AS one, count(*) AS n, sum(CASE WHEN s THEN r ELSE 0 END)::DOUBLE AS w_plus, round((sum(CASE WHEN s THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - any_value(ties) / 48), 6) AS z FROM r, t""")
def wilcoxon(spark, sf):
    return rounded(stats.signed_rank(_pairs(spark, sf).withColumn("one", F.lit(1)), ["one"], "diff"))


@query(f"""WITH {_LAB}, g AS (SELECT lang, count_if(quality = 1)::BIGINT AS n1, count_if(quality = 0)::BIGINT AS n0, avg(chars) FILTER (quality = 1) AS m1, avg(chars) FILTER (quality = 0) AS m0, var_samp(chars) FILTER (quality = 1) / count_if(quality = 1) AS a, var_samp(chars) FILTER (quality = 0) / count_if(quality = 0) AS b FROM l GROUP BY 1)
SELECT lang, n1, n0, round(m1 - m0, 4) AS diff, round(sqrt(a + b), 4) AS se, round((m1 - m0) / sqrt(a + b), 4) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 4) AS df FROM g""")
def welch(spark, sf):
    return rounded(stats.welch(_labelled(spark, sf), ["lang"], "chars", "quality"), 4)


@query(f"{_PAIR} SELECT 1 AS one, count(*) AS n, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) AS t FROM p")
def one_sample_t(spark, sf):
    return rounded(stats.one_sample_t(_pairs(spark, sf).withColumn("one", F.lit(1)), ["one"], "diff"))


@query(f"{_PAIR} SELECT 1 AS one, count(*) AS n, round(avg(diff) / stddev_samp(diff), 6) AS dz FROM p")
def cohen_dz(spark, sf):
    return rounded(stats.cohen_dz(_pairs(spark, sf).withColumn("one", F.lit(1)), ["one"], "diff"))


@query("""WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents GROUP BY 1),
x AS (SELECT lang, lead(lang) OVER w AS next_group, n, m, v, lead(n) OVER w AS n2, lead(m) OVER w AS m2, lead(v) OVER w AS v2 FROM g WINDOW w AS (ORDER BY lang))
SELECT lang, next_group, round((m2 - m) / sqrt(((n - 1) * v + (n2 - 1) * v2) / (n + n2 - 2)), 6) AS d FROM x WHERE next_group IS NOT NULL""")
def cohen_adjacent(spark, sf):
    return rounded(stats.adjacent_cohen_d(table(spark, sf, "documents"), "lang", "n_chars"))


def _test_p(spark, sf):
    rows = _stage_means(spark, sf).select("lang", "source", (1 / (1 + F.col("score"))).alias("p"))
    return rows


_P = f"WITH {_MEANS}, p AS (SELECT lang, source, 1 / (1 + score) AS p FROM m)"


@query(f"{_P} SELECT lang, source, round(least(1.0, p * count(*) OVER (PARTITION BY lang)), 6) AS p_bonferroni FROM p")
def bonferroni(spark, sf):
    rows = _test_p(spark, sf)
    return rounded(rows.select("lang", "source", stats.bonferroni(F.col("p"), F.count("*").over(Window.partitionBy("lang"))).alias("p_bonferroni")))


@query(f"""{_P}, s AS (SELECT lang, source, p, (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY p, source) + 1) * p AS step FROM p)
SELECT lang, source, round(least(1.0, max(step) OVER (PARTITION BY lang ORDER BY p, source ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s""")
def holm(spark, sf):
    return rounded(stats.holm(_test_p(spark, sf), ["lang"], "p", "source").select("lang", "source", "p_holm"))


_ABOUT = f"""r AS (SELECT lang, chars, lines, {_RANK.format(x='chars')} AS a, {_RANK.format(x='lines')} AS b FROM l),
k AS (SELECT lang, count(*) AS n, corr(a, b) AS rho, corr(chars, lines) AS r FROM r GROUP BY 1)"""


@query(f"""WITH {_LAB}, {_ABOUT}, w0 AS (SELECT lang, count_if(quality = 1) AS n1, count_if(quality = 0) AS n0, avg(chars) FILTER (quality = 1) - avg(chars) FILTER (quality = 0) AS diff,
  var_samp(chars) FILTER (quality = 1) / count_if(quality = 1) AS a, var_samp(chars) FILTER (quality = 0) / count_if(quality = 0) AS b FROM l GROUP BY 1),
{_U.replace('r AS (SELECT lang, quality', 'r2 AS (SELECT lang, quality').replace('FROM r GROUP BY', 'FROM r2 GROUP BY')},
tests AS (SELECT 'spearman' AS test, lang, rho * sqrt((n - 2) / (1 - rho * rho)) AS statistic, (n - 2)::DOUBLE AS df FROM k
  UNION ALL SELECT 'pearson', lang, r * sqrt((n - 2) / (1 - r * r)), n - 2 FROM k
  UNION ALL SELECT 'welch', lang, diff / sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)) FROM w0
  UNION ALL SELECT 'mann_whitney', lang, (u - n_pos * n_neg / 2.0 - 0.5) / nullif(sqrt(n_pos * n_neg / 12.0 * (n_pos + n_neg + 1 - ties / ((n_pos + n_neg) * (n_pos + n_neg - 1)))), 0), NULL FROM u JOIN t USING (lang)),
p AS (SELECT *, CASE WHEN test = 'mann_whitney' THEN {_upper_tail('statistic')} ELSE {_t_tails('statistic', 'df')} END AS p FROM tests WHERE statistic IS NOT NULL),
h AS (SELECT *, count(*) OVER () AS m, (count(*) OVER () - row_number() OVER (ORDER BY p, test || ' ' || lang) + 1) * p AS step FROM p),
o AS (SELECT *, least(1.0, p * m) AS p_bonferroni, least(1.0, max(step) OVER (ORDER BY p, test || ' ' || lang ROWS UNBOUNDED PRECEDING)) AS p_holm FROM h)
SELECT test, lang, {_round('statistic df p p_bonferroni p_holm')} FROM o""")
def test_p_values(spark, sf):
    """Every test of two labels or two scores by language, with its p-value, and both corrections over all of them."""
    rows, n = _labelled(spark, sf), F.col("n")
    found = [
        stats.spearman(rows, ["lang"], "chars", "lines").select("lang", F.lit("spearman").alias("test"), stats.correlation_t(F.col("rho"), n).alias("statistic"), (n - 2).alias("df")),
        stats.pearson(rows, ["lang"], "chars", "lines").select("lang", F.lit("pearson").alias("test"), stats.correlation_t(F.col("r"), n).alias("statistic"), (n - 2).alias("df")),
        stats.welch(rows, ["lang"], "chars", "quality").select("lang", F.lit("welch").alias("test"), F.col("t").alias("statistic"), "df"),
        stats.rank_sum(rows, ["lang"], "chars", "quality").select("lang", F.lit("mann_whitney").alias("test"), F.col("z").alias("statistic"), F.lit(None).cast("double").alias("df")),
    ]
    tests = reduce(DataFrame.unionByName, [t.withColumn("df", F.col("df").cast("double")) for t in found])
    normal = F.col("test") == "mann_whitney"
    tailed = tests.withColumn("p", F.when(normal, stats.normal_p(F.col("statistic"), sides=1)).otherwise(stats.t_p(F.col("statistic"), F.col("df")))).where("p IS NOT NULL")
    corrected = tailed.withColumn("all", F.lit(1)).withColumn("id", F.concat_ws(" ", "test", "lang"))
    corrected = stats.holm(corrected, ["all"], "p", "id").withColumn("p_bonferroni", stats.bonferroni(F.col("p"), F.count("*").over(Window.partitionBy("all"))))
    return rounded(corrected.select("test", "lang", "statistic", "df", "p", "p_bonferroni", "p_holm"))


_RULES = [
    suites.Rule("English is longer than German", "rank_sum", "chars", ("en", "de"), "lengths"),
    suites.Rule("French has more lines than Spanish", "rank_sum", "lines", ("fr", "es"), "lengths"),
    suites.Rule("a source's German is longer than its English", "signed_rank", "chars", ("de", "en"), "sources"),
    suites.Rule("a source's French has more bytes than its English", "signed_rank", "bytes", ("fr", "en"), "sources"),
    suites.Rule("lengths fall from German to English to Spanish", "order", "chars", ("de", "en", "es"), "means"),
    suites.Rule("English has over 1000 characters", "threshold", "chars", ("en",), "means", 1000),
    suites.Rule("German has under five lines", "threshold", "lines", ("de",), "means", 5, above=False),
    suites.Rule("French bytes over English bytes", "ratio", "bytes", ("fr", "en"), "means", 1),
]


@query(f"""WITH RECURSIVE ways(n, w) AS (SELECT 0, list_concat([1.0::DOUBLE], list_transform(range(1275), lambda i: 0.0::DOUBLE))
  UNION ALL SELECT n + 1, list_transform(range(1276), lambda i: w[i + 1] + CASE WHEN i > n THEN w[i - n] ELSE 0 END) FROM ways WHERE n < 50),
d AS (SELECT source AS unit, lang AS grp, n_chars::DOUBLE AS chars, octet_length(encode(coalesce(text, '')))::DOUBLE AS bytes, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS lines FROM documents),
v AS (UNPIVOT d ON chars, bytes, lines INTO NAME metric VALUE value),
claims(rule, family, test, metric, g, place, threshold, above) AS (VALUES
  ('English is longer than German', 'lengths', 'rank_sum', 'chars', 'en', 0, NULL, true), ('English is longer than German', 'lengths', 'rank_sum', 'chars', 'de', 1, NULL, true),
  ('French has more lines than Spanish', 'lengths', 'rank_sum', 'lines', 'fr', 0, NULL, true), ('French has more lines than Spanish', 'lengths', 'rank_sum', 'lines', 'es', 1, NULL, true),
  ('a source''s German is longer than its English', 'sources', 'signed_rank', 'chars', 'de', 0, NULL, true), ('a source''s German is longer than its English', 'sources', 'signed_rank', 'chars', 'en', 1, NULL, true),
  ('a source''s French has more bytes than its English', 'sources', 'signed_rank', 'bytes', 'fr', 0, NULL, true), ('a source''s French has more bytes than its English', 'sources', 'signed_rank', 'bytes', 'en', 1, NULL, true),
  ('lengths fall from German to English to Spanish', 'means', 'order', 'chars', 'de', 0, NULL, true), ('lengths fall from German to English to Spanish', 'means', 'order', 'chars', 'en', 1, NULL, true),
  ('lengths fall from German to English to Spanish', 'means', 'order', 'chars', 'es', 2, NULL, true),
  ('English has over 1000 characters', 'means', 'threshold', 'chars', 'en', 0, 1000, true), ('German has under five lines', 'means', 'threshold', 'lines', 'de', 0, 5, false),
  ('French bytes over English bytes', 'means', 'ratio', 'bytes', 'fr', 0, 1, true), ('French bytes over English bytes', 'means', 'ratio', 'bytes', 'en', 1, 1, true)),
x AS (SELECT rule, test, place, unit, value FROM v JOIN claims ON v.metric = claims.metric AND grp = g),
c AS (SELECT rule, any_value(family) AS family, any_value(test) AS test, any_value(metric) AS metric, max(place) AS last, any_value(threshold) AS threshold, bool_and(above) AS above FROM claims GROUP BY 1),
m AS (SELECT rule, place, count(*) AS n, avg(value) AS mean FROM x GROUP BY 1, 2),
f AS (SELECT *, lead(mean) OVER (PARTITION BY rule ORDER BY place) AS nxt FROM m),
g AS (SELECT rule, bool_and(nxt IS NULL OR mean > nxt) AS falls, arg_min(n, place) AS n_first, arg_max(n, place) AS n_last, arg_min(mean, place) AS mean_first, arg_max(mean, place) AS mean_last FROM f GROUP BY 1),
ur AS (SELECT rule, place, value, rank() OVER (PARTITION BY rule ORDER BY value) + (count(*) OVER (PARTITION BY rule, value) - 1) / 2.0 AS r FROM x WHERE test = 'rank_sum'),
ut AS (SELECT rule, sum(c * c * c - c) AS ties FROM (SELECT rule, count(*)::DOUBLE AS c FROM ur GROUP BY rule, value) GROUP BY 1),
us AS (SELECT rule, count_if(place = 0)::DOUBLE AS a, count_if(place = 1)::DOUBLE AS b, sum(CASE WHEN place = 0 THEN r END) - count_if(place = 0) * (count_if(place = 0) + 1) / 2.0 AS u FROM ur GROUP BY 1),
uz AS (SELECT rule, u::DOUBLE AS s, (u - a * b / 2 - 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM us JOIN ut USING (rule)),
wd AS (SELECT rule, avg(CASE WHEN place = 0 THEN value END) - avg(CASE WHEN place = 1 THEN value END) AS d FROM x WHERE test = 'signed_rank' GROUP BY rule, unit),
wr AS (SELECT rule, d, rank() OVER (PARTITION BY rule ORDER BY abs(d)) + (count(*) OVER (PARTITION BY rule, abs(d)) - 1) / 2.0 AS r FROM wd WHERE d <> 0),
ws AS (SELECT rule, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS s FROM wr GROUP BY 1),
wp AS (SELECT rule, s, list_sum(list_slice(w, ceil(s)::BIGINT + 1, 1276)) / pow(2.0, ws.n) AS p FROM ws JOIN ways ON ways.n = ws.n),
p AS (SELECT rule, s, {_upper_tail('z')} AS p FROM uz UNION ALL SELECT rule, s, p FROM wp),
h0 AS (SELECT rule, p, family, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, rule) + 1) * p AS step FROM p JOIN c USING (rule)),
h AS (SELECT rule, least(1.0, max(step) OVER (PARTITION BY family ORDER BY p, rule ROWS UNBOUNDED PRECEDING)) AS p_holm FROM h0),
o AS (SELECT *, CASE test WHEN 'threshold' THEN mean_first WHEN 'ratio' THEN mean_first / mean_last END AS reached FROM c LEFT JOIN g USING (rule) LEFT JOIN p USING (rule) LEFT JOIN h USING (rule))
SELECT rule, family, test, metric, coalesce(n_first, 0) AS n_first, coalesce(n_last, 0) AS n_last, round(mean_first, 6) + 0.0 AS mean_first, round(mean_last, 6) + 0.0 AS mean_last, round(coalesce(s, reached), 6) + 0.0 AS statistic, {_round('p p_holm')},
coalesce(CASE WHEN test IN ('rank_sum', 'signed_rank') THEN p_holm < 0.05 WHEN test = 'order' THEN falls WHEN above THEN reached > threshold ELSE reached < threshold END, false) AS passed FROM o""")
def hypothesis_suite(spark, sf):
    """Eight claims about lengths by language, in three families. (The twin counts signed ranks out, for up to 50 sources without ties.)"""
    scores = tables.unpivot_metrics(_doc_metrics(spark, sf).select(F.col("source").alias("unit"), F.col("lang").alias("group"), "chars", "bytes", "lines"), ["unit", "group"], ["chars", "bytes", "lines"])
    return rounded(suites.suite(scores.withColumnRenamed("score", "value"), _RULES))


@query(f"""WITH {_LAB}, b AS (SELECT l.*, octet_length(encode(coalesce(text, '')))::DOUBLE AS bytes FROM l JOIN documents USING (doc_id)),
v0 AS (SELECT lang, chars, bytes, lines, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM b),
v1 AS (UNPIVOT v0 ON chars, bytes, lines INTO NAME metric VALUE x), v AS (UNPIVOT v1 ON quality, toxic INTO NAME label VALUE y),
r AS (SELECT *, rank() OVER (PARTITION BY lang, metric, label ORDER BY x) + (count(*) OVER (PARTITION BY lang, metric, label, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY lang, metric, label ORDER BY y) + (count(*) OVER (PARTITION BY lang, metric, label, y) - 1) / 2.0 AS ry FROM v),
k AS (SELECT lang, metric, label, count(*) AS n, CASE WHEN count(*) >= 5 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho, count_if(y = 1)::DOUBLE AS a, count_if(y = 0)::DOUBLE AS b, sum(CASE WHEN y = 1 THEN rx END) AS w, bool_and(y IN (0, 1)) AND min(y) = 0 AND max(y) = 1 AS "binary" FROM r GROUP BY 1, 2, 3),
c AS (SELECT lang, metric, label, x, sum(y) AS p, sum(1 - y) AS q FROM v GROUP BY ALL),
t AS (SELECT lang, metric, label, sum(p) OVER (PARTITION BY lang, metric, label ORDER BY x DESC ROWS UNBOUNDED PRECEDING) - sum(q) OVER (PARTITION BY lang, metric, label ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS ahead FROM c),
best AS (SELECT lang, metric, label, greatest(max(ahead), 0) AS ahead FROM t GROUP BY 1, 2, 3),
o AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS tt, (n - 2)::DOUBLE AS df, CASE WHEN "binary" AND a >= 2 AND b >= 2 THEN (w - a * (a + 1) / 2) / (a * b) END AS auc FROM k JOIN best USING (lang, metric, label))
SELECT lang, metric, label, n, round(rho, 6) + 0.0 AS rho, round({_t_tails('tt', 'df')}, 6) + 0.0 AS p, "binary", round(auc, 6) AS auc, round(1 - auc, 6) AS auc_inverse, CASE WHEN "binary" THEN round((b + ahead) / n, 6) END AS oca FROM o""")
def metric_label_table(spark, sf):
    """Three metrics against both labels by language."""
    return rounded(suites.label_associations(_labelled(spark, sf), ["lang"], ["chars", "bytes", "lines"], ["quality", "toxic"]))


@query(f"WITH {_MEANS} SELECT source, lang, round((score - avg(score) OVER w) / stddev_samp(score) OVER w, 6) + 0.0 AS z FROM m WINDOW w AS (PARTITION BY lang)")
def zscore(spark, sf):
    return rounded(stats.zscores(_stage_means(spark, sf), ["lang"], "score").select("source", "lang", "z"))


@query(f"""WITH {_LAB}, g AS (SELECT doc_id, round(abs(quality - coalesce((chars - min(chars) OVER w) / nullif(max(chars) OVER w - min(chars) OVER w, 0), 0)), 6) AS gap FROM l WINDOW w AS (PARTITION BY lang))
SELECT doc_id, gap, (row_number() OVER (ORDER BY gap DESC, doc_id))::INTEGER AS rank FROM g ORDER BY gap DESC, doc_id LIMIT 50""")
def minmax_disagreement(spark, sf):
    """The fifty largest gaps between label and scaled score (a report: fifty is its length)."""
    rows = stats.minmax(_labelled(spark, sf), ["lang"], "chars").select("doc_id", F.round(F.abs(F.col("quality") - F.col("norm")), 6).alias("gap"))
    top = rows.orderBy(F.desc("gap"), "doc_id").limit(50)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("gap"), "doc_id")))


# --- decomposition --------------------------------------------------------


@query(f"""WITH {_MEANS}, x AS (SELECT score AS v, avg(score) OVER (PARTITION BY source) AS r, avg(score) OVER (PARTITION BY lang) AS c, avg(score) OVER () AS g FROM m),
s AS (SELECT sum(pow(r - g, 2)) AS ss_row, sum(pow(c - g, 2)) AS ss_col, sum(pow(v - r - c + g, 2)) AS ss_inter, sum(pow(v - g, 2)) AS ss_total FROM x)
SELECT round(ss_row, 2) AS ss_row, round(ss_col, 2) AS ss_col, round(ss_inter, 2) AS ss_inter, round(ss_total, 2) AS ss_total, round(ss_row / ss_total, 6) AS frac_row, round(ss_col / ss_total, 6) AS frac_col, round(ss_inter / ss_total, 6) AS frac_inter FROM s""")
def two_way(spark, sf):
    d = tables.two_way(_stage_means(spark, sf), "source", "lang", "score")
    return d.select(*[F.round(c, 2).alias(c) if c.startswith("ss_") else F.round(c, 6).alias(c) for c in d.columns])


def _cube(spark, sf):
    long = tables.unpivot_metrics(_doc_metrics(spark, sf), ["source", "lang"], ["chars", "bytes", "lines"])
    return long.groupBy("source", "lang", "metric").agg(F.avg(F.log2(F.col("score") + 1)).alias("v"))


_CUBE = """d AS (SELECT source, lang, n_chars::DOUBLE AS chars, octet_length(encode(coalesce(text, '')))::DOUBLE AS bytes, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS lines FROM documents),
u AS (UNPIVOT d ON chars, bytes, lines INTO NAME metric VALUE score), c AS (SELECT source, lang, metric, avg(log2(score + 1)) AS v FROM u GROUP BY ALL)"""


@query(f"""WITH {_CUBE}, x AS (SELECT v, avg(v) OVER () AS g, avg(v) OVER (PARTITION BY source) AS a, avg(v) OVER (PARTITION BY lang) AS b, avg(v) OVER (PARTITION BY metric) AS m,
avg(v) OVER (PARTITION BY source, lang) AS ab, avg(v) OVER (PARTITION BY source, metric) AS am, avg(v) OVER (PARTITION BY lang, metric) AS bm FROM c),
s AS (SELECT sum(pow(a - g, 2)) AS source, sum(pow(b - g, 2)) AS lang, sum(pow(m - g, 2)) AS metric, sum(pow(ab - a - b + g, 2)) AS source_lang, sum(pow(am - a - m + g, 2)) AS source_metric,
sum(pow(bm - b - m + g, 2)) AS lang_metric, sum(pow(v - ab - am - bm + a + b + m - g, 2)) AS source_lang_metric, sum(pow(v - g, 2)) AS total FROM x),
e AS (UNPIVOT s ON source, lang, metric, source_lang, source_metric, lang_metric, source_lang_metric INTO NAME effect VALUE ss)
SELECT effect, round(ss, 4) AS ss, round(ss / total, 6) AS fraction FROM e""")
def three_way(spark, sf):
    d = tables.three_way(_cube(spark, sf), ["source", "lang", "metric"], "v")
    return d.select("effect", F.round("ss", 4).alias("ss"), F.round("fraction", 6).alias("fraction"))


_VIEWS = {"all": ["chars", "bytes", "lines"], "sizes": ["chars", "bytes"], "chars_lines": ["chars", "lines"]}
_VIEW_ROWS = ", ".join(f"('{v}', '{g}')" for v, graders in _VIEWS.items() for g in graders)
_EFFECTS = "grader stage unit grader_x_stage grader_x_unit stage_x_unit residual".split()


@query(f"""WITH {_CUBE}, w(view, g) AS (VALUES {_VIEW_ROWS}), k AS (SELECT view, count(*) AS n_graders FROM w GROUP BY 1),
x0 AS (SELECT view, metric AS g, lang AS s, source AS u, v FROM c JOIN w ON g = metric WHERE lang IN ('de', 'en', 'es', 'fr')),
n AS (SELECT view, u, count(*) = 4 * any_value(n_graders) AS whole FROM x0 JOIN k USING (view) GROUP BY 1, 2), nd AS (SELECT view, count_if(whole)::BIGINT AS n_units, count_if(NOT whole)::BIGINT AS n_dropped FROM n GROUP BY 1),
x AS (SELECT x0.* FROM x0 JOIN n USING (view, u) WHERE whole),
e AS (SELECT view, v, avg(v) OVER (PARTITION BY view) AS m, avg(v) OVER (PARTITION BY view, g) AS a, avg(v) OVER (PARTITION BY view, s) AS b, avg(v) OVER (PARTITION BY view, u) AS c,
  avg(v) OVER (PARTITION BY view, g, s) AS ab, avg(v) OVER (PARTITION BY view, g, u) AS ac, avg(v) OVER (PARTITION BY view, s, u) AS bc FROM x),
q AS (SELECT view, sum(pow(a - m, 2)) AS ss_grader, sum(pow(b - m, 2)) AS ss_stage, sum(pow(c - m, 2)) AS ss_unit, sum(pow(ab - a - b + m, 2)) AS ss_grader_x_stage, sum(pow(ac - a - c + m, 2)) AS ss_grader_x_unit,
  sum(pow(bc - b - c + m, 2)) AS ss_stage_x_unit, sum(pow(v - ab - ac - bc + a + b + c - m, 2)) AS ss_residual, sum(pow(v - m, 2)) AS ss_total FROM e GROUP BY 1),
r AS (SELECT *, ss_unit / nullif(ss_total, 0) AS unit_frac_of_total, (ss_grader + ss_grader_x_unit) / nullif(ss_total - ss_unit, 0) AS within_grader, (ss_stage + ss_stage_x_unit) / nullif(ss_total - ss_unit, 0) AS within_stage,
  (ss_grader_x_stage + ss_residual) / nullif(ss_total - ss_unit, 0) AS within_interaction, ss_grader + ss_stage + ss_grader_x_stage AS t FROM q)
SELECT view, n_graders::INTEGER AS n_graders, n_units, n_dropped, {_round(" ".join(f"ss_{n}" for n in _EFFECTS) + " ss_total unit_frac_of_total within_grader within_stage within_interaction")},
round(ss_grader / t, 6) AS cell_grader, round(ss_stage / t, 6) AS cell_stage, round(ss_grader_x_stage / t, 6) AS cell_interaction FROM r JOIN nd USING (view) JOIN k USING (view)""")
def decomposition_views(spark, sf):
    """Metrics grade, languages are stages, sources are units: all metrics, and two panels of two, over the sources that each has whole."""
    return rounded(tables.decompose_views(_cube(spark, sf), "metric", "lang", "source", "v", _VIEWS, ["de", "en", "es", "fr"]))


@query(f"WITH {_CUBE} SELECT metric, lang, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM c GROUP BY 1, 2")
def theta_stage_matrix(spark, sf):
    return rounded(_cube(spark, sf).groupBy("metric", "lang").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")))


@query(f"""WITH {_MEANS}, s AS (SELECT lang, avg(score) AS score FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY lang) AS rank FROM s)
SELECT count_if(a.score > b.score)::BIGINT AS passes, count(*) AS pairs FROM r a JOIN r b ON a.rank < b.rank""")
def ordering_passes(spark, sf):
    means = _stage_means(spark, sf).groupBy("lang").agg(F.avg("score").alias("score")).withColumn("rank", F.row_number().over(Window.orderBy("lang")))
    return tables.ordering_passes(means, "rank", "score")


# --- cross-mode -----------------------------------------------------------


def _mode_bits(spark, sf):
    return pairwise.whole_bits(table(spark, sf, "documents"), "lang", "doc_id", "text")


_MODES = f"""s AS (SELECT lang AS mode, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, coalesce(text, '') AS text FROM documents),
wc AS (SELECT mode, k, word, count(*) AS c FROM (SELECT mode, k, unnest({_words('text')}) AS word FROM s) GROUP BY ALL),
ty AS (SELECT count(DISTINCT word) AS types FROM wc), tot AS (SELECT mode, k, sum(c)::BIGINT AS total FROM wc GROUP BY 1, 2),
sz AS (SELECT mode, count(*) AS n FROM s GROUP BY 1),
pr AS (SELECT c.mode AS ctx, t.mode AS tgt, t.k, c.k AS ctx_k FROM s t CROSS JOIN sz JOIN s c ON c.mode = sz.mode AND c.k = (t.k + 1) % n WHERE c.mode <> t.mode OR c.k <> t.k),
bits AS (SELECT pr.ctx, pr.tgt, pr.k, pr.ctx_k, sum(-w.c * log2((coalesce(h.c, 0) + 0.5) / (total + 0.5 * (types + 1)))) AS bits, sum(w.c * log2(types + 1.0)) AS alone
  FROM pr JOIN wc w ON w.mode = pr.tgt AND w.k = pr.k LEFT JOIN wc h ON h.mode = pr.ctx AND h.k = pr.ctx_k AND h.word = w.word JOIN tot ON tot.mode = pr.ctx AND tot.k = pr.ctx_k, ty GROUP BY ALL),
mx AS (SELECT ctx, tgt, avg(alone - bits) AS mean, stddev_pop(alone - bits) AS std, stddev_pop(alone - bits) / sqrt(count(*)) AS sem FROM bits GROUP BY 1, 2)"""


def _matrix(spark, sf):
    return pairwise.reduction(_mode_bits(spark, sf))


@query(f"WITH {_MODES} SELECT ctx, tgt, {_round('mean std sem', 4)} FROM mx")
def pairwise_reduction(spark, sf):
    return rounded(_matrix(spark, sf), 4)


@query(f"WITH {_MODES}, g AS (SELECT ctx, avg(mean) AS mean, sqrt(sum(sem * sem)) / count(*) AS sem FROM mx GROUP BY 1) SELECT ctx, {_round('mean sem', 4)}, row_number() OVER (ORDER BY g.mean DESC, ctx)::INTEGER AS rank FROM g")
def row_means(spark, sf):
    return rounded(pairwise.margins(_matrix(spark, sf), "ctx"), 4)


@query(f"WITH {_MODES} SELECT a.ctx, a.tgt, round(a.mean - b.mean, 4) + 0.0 AS gap FROM mx a JOIN mx b ON a.ctx = b.tgt AND a.tgt = b.ctx WHERE a.ctx < a.tgt")
def asymmetry(spark, sf):
    return rounded(pairwise.asymmetry(_matrix(spark, sf)), 4)


@query(f"""WITH {_MODES} SELECT round(avg(mean) FILTER (ctx = tgt), 4) AS diagonal, round(avg(mean) FILTER (ctx <> tgt), 4) AS off_diagonal, round(avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END) FILTER (ctx <> tgt), 4) AS frac_positive FROM mx""")
def diagonal_means(spark, sf):
    return rounded(pairwise.diagonal_means(_matrix(spark, sf)), 4)


@query(f"""WITH {_MODES}, c AS (SELECT ctx, tgt, mean FROM mx WHERE ctx <> tgt) SELECT ctx, tgt, round(mean, 4) AS mean, side FROM (
(SELECT *, 'top' AS side FROM c ORDER BY mean DESC, ctx, tgt LIMIT 3) UNION ALL (SELECT *, 'bottom' AS side FROM c ORDER BY mean, ctx, tgt LIMIT 3))""")
def top_bottom_pairs(spark, sf):
    return rounded(pairwise.extremes(settled(_matrix(spark, sf)), 3), 4)


@query(f"""WITH {_MODES}, p AS (SELECT a.mean AS x, b.mean AS y FROM mx a JOIN mx b ON a.ctx = b.tgt AND a.tgt = b.ctx WHERE a.ctx < a.tgt)
SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 4) AS r2 FROM p""")
def symmetry_fit(spark, sf):
    return rounded(pairwise.symmetry_fit(_matrix(spark, sf)), 4)


@query("""WITH t AS (SELECT l_orderkey AS id, l_linenumber - 1 AS t, l_extendedprice / 1000 - 30 AS delta FROM lineitem), n AS (SELECT id, count(*) AS n, sum(delta) AS total FROM t GROUP BY 1)
SELECT id, n, round(CASE WHEN abs(total) > 0.1 THEN share / total END, 4) + 0.0 AS share FROM (SELECT id, any_value(n) AS n, any_value(total) AS total, sum(CASE WHEN t < n // 4 THEN delta ELSE 0 END) AS share FROM t JOIN n USING (id) GROUP BY 1)""")
def token_first_quarter(spark, sf):
    tokens = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("t"), (F.col("l_extendedprice") / 1000 - 30).alias("delta"))
    return rounded(pairwise.first_quarter_share(tokens, ["id"]), 4)


# --- closed forms, fits, bootstraps ---------------------------------------


@query(r"""WITH c AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY 1, 2), n AS (SELECT lang, sum(c)::BIGINT AS n FROM c GROUP BY 1),
k AS (SELECT lang, c, n, unnest(range(least(10, n))) AS k FROM c JOIN n USING (lang))
SELECT lang, k, round(1 - sum(c / n * coalesce(list_product(list_transform(range(k), lambda i: greatest(0.0, (n - c - i) / (n - 1 - i)))), 1.0)), 6) + 0.0 AS p FROM k GROUP BY 1, 2""")
def p_rep(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("c"))
    return rounded(fits.seen_before(counts, ["lang"], "c", 10))


@query()
def predicted_curves(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("c"))
    p = fits.seen_before(counts, ["lang"], "c", 10).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("p"))
    return p.select("lang", fits.additive_curve(F.lit(100.0), F.lit(40.0), F.col("p")).alias("additive"), fits.fractional_curve(F.lit(100.0), F.lit(0.3), F.col("p")).alias("fractional"))


@query()
def fit_exponential(spark, sf):
    return rounded(fits.fit_curves(scorers.prequential(response_sets(spark, sf), ["set_id"]), ["set_id"], "bits"), 3)


@query()
def fit_sigmoid(spark, sf):
    return rounded(fits.fit_curves(scorers.prequential(response_sets(spark, sf), ["set_id"]), ["set_id"], "bits", "sigmoid", 4), 3)


@query()
def fitted_label_tests(spark, sf):
    """E as summed, by the exponential and by the sigmoid fit (as summed where that fails), against a set's size and the quality of the document of its number."""
    curve = settled(scorers.prequential(response_sets(spark, sf), ["set_id"]))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("set_id"), F.col("quality").cast("double").alias("quality"))
    sizes = curve.groupBy("set_id").agg(F.count("*").cast("double").alias("size"))
    e = curves.excess_entropy(curve, ["set_id"]).select("set_id", "e")
    one = suites.fitted_or_discrete(e, fits.fit_curves(curve, ["set_id"], "bits"), ["set_id"], "e", {"e_exp": "e_fit"})
    both = suites.fitted_or_discrete(e, fits.fit_curves(curve, ["set_id"], "bits", "sigmoid", 4), ["set_id"], "e", {"e_sig": "e_fit"}).drop("e").join(one, "set_id")
    rows = both.join(sizes, "set_id").join(labels, "set_id", "left").withColumn("all", F.lit("all"))
    return rounded(suites.label_associations(settled(rows), ["all"], ["e", "e_exp", "e_sig"], ["quality", "size"]).drop("all"), 3)


def _draws(rows: str, row: str, reps: int) -> str:
    """CTE `drawn`: the rows of a CTE for each replicate rep, with u, the number that a row draws."""
    a, b, c, d = resample._MULTIPLIERS
    p = resample.PRIME
    return f"""h0 AS (SELECT *, (({row} % {p}) * {a} + (rep + 1) * {b}) % {p} AS h FROM {rows}, (SELECT unnest(range({reps})) AS rep)),
h1 AS (SELECT *, xor(h, h >> 15) * {c} % {p} AS g FROM h0), drawn AS (SELECT *, xor(g, g >> 13) * {d} % {p} AS u FROM h1)"""


#: Chances of a Poisson number of mean 1 that is at most 0 to 9, times 2^31 - 1.
_POISSON = "[790015084, 1580030168, 1975037710, 2106706891, 2139624186, 2146207645, 2147304888, 2147461637, 2147481231, 2147483408]"
_TAKEN = f"taken AS (SELECT *, len(list_filter({_POISSON}, lambda x: u >= x)) AS w FROM drawn)"


def _spread(name: str, digits: int = 6) -> str:
    return f"round(stddev_samp({name}), {digits}) + 0.0 AS {name}_se, round(quantile_cont({name}, 0.025), {digits}) + 0.0 AS {name}_low, round(quantile_cont({name}, 0.975), {digits}) + 0.0 AS {name}_high"


@query(f"""{_PAIR}, x AS (SELECT regexp_extract(source, '[0-9]+')::BIGINT AS id, a, b FROM p), {_draws("x", "id", 10_000)}, {_TAKEN},
r AS (SELECT sum(w * a) / nullif(sum(w * b), 0) AS ratio FROM taken WHERE w > 0 GROUP BY rep)
SELECT (SELECT count(*) FROM x) AS n, (SELECT round(sum(a) / sum(b), 6) FROM x) AS ratio, {_spread("ratio")} FROM r""")
def bootstrap_ratio(spark, sf):
    pairs = _pairs(spark, sf).withColumn("id", F.regexp_extract("source", "[0-9]+", 0).cast("long"))
    return rounded(resample.bootstrap_ratio(pairs, [], "a", "b", "id", 10_000))


@query(f"""WITH x AS (SELECT lang, doc_id, n_chars::DOUBLE AS x FROM documents), {_draws("x", "doc_id", 1_000)}, {_TAKEN},
r AS (SELECT lang, sum(w * x) / sum(w) AS mean FROM taken WHERE w > 0 GROUP BY lang, rep), g AS (SELECT lang, {_spread("mean")} FROM r GROUP BY 1)
SELECT lang, count(*) AS n, round(avg(x), 6) AS mean, any_value(mean_se) AS mean_se, any_value(mean_low) AS mean_low, any_value(mean_high) AS mean_high FROM x JOIN g USING (lang) GROUP BY 1""")
def bootstrap_mean(spark, sf):
    return rounded(resample.bootstrap_mean(table(spark, sf, "documents"), ["lang"], "n_chars", "doc_id", 1_000))


@query(f"""WITH x AS (SELECT lang, d.doc_id, n_chars::DOUBLE / 1000 AS x, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS y FROM documents d JOIN labels USING (doc_id)), {_draws("x", "doc_id", 1_000)}, {_TAKEN},
m AS (SELECT lang, rep, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM taken WHERE w > 0 GROUP BY 1, 2),
v AS (SELECT lang, xx - sx * sx / n AS cxx, xy - sx * sy / n AS cxy, yy - sy * sy / n AS cyy, xx, yy FROM m),
r AS (SELECT lang, CASE WHEN cxx > 1e-9 * xx THEN cxy / cxx END AS slope, CASE WHEN cxx > 1e-9 * xx AND cyy > 1e-9 * yy THEN cxy * cxy / (cxx * cyy) END AS r2 FROM v),
g AS (SELECT lang, {_spread("slope")}, {_spread("r2")} FROM r GROUP BY 1)
SELECT lang, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, any_value(COLUMNS('(slope|r2)_.*')) FROM x JOIN g USING (lang) GROUP BY 1""".replace("any_value(COLUMNS('(slope|r2)_.*'))", ", ".join(f"any_value({n}_{e}) AS {n}_{e}" for n in ("slope", "r2") for e in ("se", "low", "high"))))
def bootstrap_slope(spark, sf):
    """Lines against thousands of characters of labelled documents, by language."""
    points = _labelled(spark, sf).withColumn("kilo", F.col("chars") / 1000)
    return rounded(resample.bootstrap_slope(points, ["lang"], "kilo", "lines", "doc_id", 1_000))


def _sized_curves(spark, sf):
    sets = response_sets(spark, sf)
    return scorers.prequential(sets, ["set_id"]).join(sets.groupBy("set_id").agg(F.count("*").alias("m")), "set_id")


@query(f"""{_BASE}, x AS (SELECT m, set_id, k, bits FROM curve JOIN (SELECT set_id, count(*) AS m FROM sets GROUP BY 1) USING (set_id)), {_draws("x", "set_id", 1_000)}, {_TAKEN},
r AS (SELECT m, k, sum(w * bits) / sum(w) AS mean FROM taken WHERE w > 0 GROUP BY m, k, rep), g AS (SELECT m, k, {_spread("mean", 4)} FROM r GROUP BY 1, 2)
SELECT m, k, count(*) AS draws, round(avg(bits), 4) + 0.0 AS mean, any_value(mean_se) AS mean_se, any_value(mean_low) AS mean_low, any_value(mean_high) AS mean_high FROM x JOIN g USING (m, k) GROUP BY 1, 2""")
def bootstrap_curves(spark, sf):
    """Mean curves of conversations with as many responses, with their bands."""
    return rounded(resample.bootstrap_curves(_sized_curves(spark, sf), ["m"], "set_id", "bits", 1_000), 4)


@query()
def bootstrap_fit(spark, sf):
    return rounded(resample.bootstrap_fit(_sized_curves(spark, sf), ["m"], "set_id", "bits", 1_000), 3)


_RHO = """rk AS (SELECT {g}, rank() OVER (PARTITION BY {g} ORDER BY a) + (count(*) OVER (PARTITION BY {g}, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {g} ORDER BY b) + (count(*) OVER (PARTITION BY {g}, b) - 1) / 2.0 AS rb FROM {t}),
rhos AS (SELECT {g}, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 12) END AS rho FROM rk GROUP BY ALL)"""


@query(f"""WITH {_LAB}, {_draws("l", "doc_id", 200)}, s AS (SELECT *, row_number() OVER (PARTITION BY lang, rep ORDER BY u, doc_id) AS place, count(*) OVER (PARTITION BY lang, rep) AS held FROM drawn),
pts AS (SELECT lang, n, rep, chars AS a, lines AS b FROM s, (SELECT unnest([5, 10, 25, 50]) AS n) WHERE place <= n AND held >= n), {_RHO.format(g="lang, n, rep", t="pts")}
SELECT lang, n, count(rho) AS reps, round(avg(rho), 6) + 0.0 AS rho, round(stddev_pop(rho), 6) + 0.0 AS std, round(quantile_cont(rho, 0.025), 6) + 0.0 AS low, round(quantile_cont(rho, 0.975), 6) + 0.0 AS high FROM rhos GROUP BY 1, 2""")
def subsample_rho(spark, sf):
    rhos = resample.subsampled_points(_labelled(spark, sf), ["lang"], "chars", "lines", "doc_id", (5, 10, 25, 50))
    return rounded(resample.rho_range(rhos, ["lang"]))


@query(f"""WITH x AS (SELECT lang, source, doc_id, n_chars::DOUBLE AS x FROM documents), {_draws("x", "doc_id", 200)}, ref AS (SELECT source, avg(x) AS b FROM x WHERE lang = 'en' GROUP BY 1),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, rep ORDER BY u, doc_id) AS place FROM drawn),
pts AS (SELECT lang, n, rep, source, avg(x) AS a, any_value(b) AS b FROM s JOIN ref USING (source), (SELECT unnest([3, 5, 10, 20]) AS n) WHERE place <= n GROUP BY lang, n, rep, source), {_RHO.format(g="lang, n, rep", t="pts")},
d AS (SELECT o.lang, o.n, o.rho, e.rho AS base FROM rhos o JOIN rhos e ON e.lang = 'en' AND o.lang <> 'en' AND o.n = e.n AND o.rep = e.rep),
f AS (SELECT lang, n, rho, 1 AS own FROM d UNION ALL SELECT lang, n, base, 0 FROM d),
q AS (SELECT lang, n, own, rank() OVER w + (count(*) OVER (PARTITION BY lang, n, rho) - 1) / 2.0 AS r FROM f WHERE rho IS NOT NULL WINDOW w AS (PARTITION BY lang, n ORDER BY rho)),
c AS (SELECT lang, n, sum(t * t * t - t) AS ties FROM (SELECT lang, n, count(*)::DOUBLE AS t FROM f WHERE rho IS NOT NULL GROUP BY lang, n, rho) GROUP BY 1, 2),
u AS (SELECT lang, n, sum(own)::DOUBLE AS n1, sum(1 - own)::DOUBLE AS n0, sum(r) FILTER (own = 1) - sum(own) * (sum(own) + 1) / 2.0 AS u FROM q GROUP BY 1, 2),
z AS (SELECT lang, n, u, (u - n1 * n0 / 2 - 0.5) / nullif(sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 0) AS z FROM u JOIN c USING (lang, n)),
g AS (SELECT lang, n, avg(rho) AS rho, avg(base) AS base_rho, avg(rho - base) AS delta, quantile_cont(rho - base, 0.025) AS delta_low, quantile_cont(rho - base, 0.975) AS delta_high FROM d GROUP BY 1, 2)
SELECT lang, n, {_round("rho base_rho delta delta_low delta_high")}, u::DOUBLE AS u, round(z, 6) + 0.0 AS z, round({_upper_tail("z")}, 6) + 0.0 AS p FROM g JOIN z USING (lang, n)""")
def subsample_efficiency(spark, sf):
    """How well a few documents of each source tell how long its English ones are, for each other language against English itself."""
    docs = table(spark, sf, "documents")
    truth = docs.where("lang = 'en'").groupBy("source").agg(F.avg(F.col("n_chars").cast("double")).alias("truth"))
    rhos = resample.subsampled_means(docs, ["lang"], "source", "n_chars", "doc_id", truth, "truth", (3, 5, 10, 20))
    return rounded(resample.efficiency(rhos, "lang", "en"))


@query("SELECT lang, round(avg(n_chars), 4) AS mean, avg(n_chars) > 2000 AS passed FROM documents GROUP BY 1")
def threshold_checks(spark, sf):
    return rounded(stats.threshold_checks(table(spark, sf, "documents"), ["lang"], "n_chars", 2000), 4)


@query(f"""{_BASE}, x AS (SELECT set_id % 3 AS part, k, bits FROM curve), g AS (SELECT part, k, count(*) AS n, avg(bits) AS mean, stddev_pop(bits) AS sd, stddev_pop(bits) / sqrt(count(*)) AS sem FROM x GROUP BY 1, 2)
SELECT part, k, n, {_round("mean sd sem", 4)}, round(mean - sd, 4) + 0.0 AS sd_low, round(mean + sd, 4) + 0.0 AS sd_high, round(mean - sem, 4) + 0.0 AS sem_low, round(mean + sem, 4) + 0.0 AS sem_high FROM g""")
def curve_bands(spark, sf):
    """Mean curve of three parts of the conversations, which have curves of any length, with both bands."""
    curve = scorers.prequential(response_sets(spark, sf), ["set_id"])
    return rounded(curves.bands(curve.withColumn("part", F.col("set_id") % 3), ["part"], "bits"), 4)


@query(f"""{_ALL_SCORES}, l AS (SELECT *, (mean_byte_length > 1000)::INTEGER AS label FROM r), u AS (SELECT n, label, unnest(['e', 'e_rate', 'd_c_an']) AS metric, unnest([e, e_rate, d_c_an]) AS v FROM l),
g AS (SELECT n AS m, metric, avg(v) FILTER (label = 1) AS high_mean, avg(v) FILTER (label = 0) AS low_mean, count(v) FILTER (label = 1) AS n_high, count(v) FILTER (label = 0) AS n_low FROM u GROUP BY 1, 2)
SELECT m, metric, {_round("high_mean low_mean", 4)}, n_high, n_low, round(high_mean - low_mean, 4) + 0.0 AS diff FROM g WHERE n_high > 0 AND n_low > 0""")
def e_rate_separation(spark, sf):
    """Excess entropy, in all and per byte, of sets with long and with short responses."""
    s = _scores(spark, sf).withColumn("label", (F.col("mean_byte_length") > 1000).cast("int")).withColumnRenamed("n", "m")
    return rounded(curves.separation(s, ["m"], "label", ["e", "e_rate", "d_c_an"]), 4)


@query()
def fitted_floor(spark, sf):
    curve = _sized_curves(spark, sf)
    scores = _scores(spark, sf).withColumnRenamed("n", "m")
    return rounded(curves.fitted_floor_means(curve, scores, ["set_id"], ["m"]), 3)


@query(f"{_FULL}, {_CURVE_SCORES} SELECT n AS m, count(*) AS sets, round(avg(a_n / nullif(a_1, 0)), 4) AS drop_ratio FROM scores GROUP BY n")
def drop_ratio(spark, sf):
    s = curves.excess_entropy(scorers.prequential(response_sets(spark, sf), ["set_id"]), ["set_id"])
    return rounded(s.groupBy(F.col("n").alias("m")).agg(F.count("*").alias("sets"), F.avg(F.try_divide("a_n", "a_1")).alias("drop_ratio")), 4)


@query(f"""WITH {_MEANS}, a AS (SELECT avg(score) FILTER (lang = 'en') AS lo, avg(score) FILTER (lang = 'fr') AS hi FROM m), g AS (SELECT lang, avg(score) AS v FROM m GROUP BY 1)
SELECT lang, round((v - lo) / nullif(hi - lo, 0), 4) + 0.0 AS position FROM g, a""")
def norm_position(spark, sf):
    m = _stage_means(spark, sf)
    anchors = m.agg(F.avg(F.when(F.col("lang") == "en", F.col("score"))).alias("lo"), F.avg(F.when(F.col("lang") == "fr", F.col("score"))).alias("hi"))
    g = m.groupBy("lang").agg(F.avg("score").alias("v"))
    return rounded(g.join(F.broadcast(anchors)).select("lang", F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")).alias("position")), 4)


@query(f"""{_FULL} SELECT round(quantile_cont(h, 0.05), 4) AS p5, round(quantile_cont(h, 0.95), 4) AS p95, round(pow(2, -quantile_cont(h, 0.5)), 4) AS c_median, count(*) AS n FROM (SELECT bits / bytes AS h FROM alone WHERE bytes > 0)""")
def coherence_percentiles(spark, sf):
    alone = scorers.prequential(response_sets(spark, sf), ["set_id"], alone=True).where("bytes > 0").select((F.col("bits") / F.col("bytes")).alias("h"), F.lit(1).alias("one"))
    q = ranks.quantiles(alone, ["one"], "h", {"p5": 0.05, "p95": 0.95, "middle": 0.5}).join(alone.groupBy("one").agg(F.count("*").alias("n")), "one")
    return rounded(q.select("p5", "p95", F.pow(F.lit(2.0), -F.col("middle")).alias("c_median"), "n"), 4)


@query(f"""WITH {_MEANS}, a AS (SELECT source, rank() OVER (ORDER BY avg(score) DESC) AS r FROM m GROUP BY 1), b AS (SELECT source, rank() OVER (ORDER BY max(score) DESC) AS r FROM m GROUP BY 1)
SELECT count_if(a.r <> b.r)::BIGINT AS moved, count(*) AS n FROM a JOIN b USING (source)""")
def rank_sensitivity(spark, sf):
    m = _stage_means(spark, sf).groupBy("source").agg(F.avg("score").alias("a"), F.max("score").alias("b"))
    ranked = m.select(F.rank().over(Window.orderBy(F.desc("a"))).alias("ra"), F.rank().over(Window.orderBy(F.desc("b"))).alias("rb"))
    return ranked.agg(F.count_if(F.col("ra") != F.col("rb")).alias("moved"), F.count("*").alias("n"))


@query(f"""WITH {_MEANS}, r AS (SELECT lang, source, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM m)
SELECT lang, source, round(score, 4) AS score FROM r WHERE rn = n // 4 + 1""")
def quartile_pick(spark, sf):
    w = Window.partitionBy("lang")
    r = _stage_means(spark, sf).select("lang", "source", "score", F.row_number().over(w.orderBy(F.desc("score"), "source")).alias("rn"), F.count("*").over(w).alias("n"))
    return rounded(r.where(F.col("rn") == F.floor(F.col("n") / 4) + 1).select("lang", "source", "score"), 4)


@query("SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'over_limit' ELSE 'scored' END AS status, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def processing_status(spark, sf):
    status = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 20_000, "over_limit").otherwise("scored")
    return table(spark, sf, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("SELECT lang, count(*) AS samples, count(*) * 60 AS calls, (sum(length(text)) * 60)::BIGINT AS tokens, round(sum(length(text)) * 60 * 0.12 / 1000000, 6) AS cost FROM documents GROUP BY 1")
def cost_estimate(spark, sf):
    size = F.sum(F.char_length("text"))
    return rounded(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("samples"), (F.count("*") * 60).alias("calls"), (size * 60).alias("tokens"), (size * 60 * 0.12 / 1_000_000).alias("cost")))
