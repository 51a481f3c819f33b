"""What the findings of round 3 found, on small tables."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from polyvox.functions import text as T
from polyvox.llm import components, jaccard
from polyvox.operators import fits, lexical, pairwise
from polyvox.plans import scorers


def test_capital_is_one_letter(spark):
    given = ["ßheit", "élan", "ﬁne", "ᾳx", "ᾈx", "ŉx", "ẞx", "", "1a", "a", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    found = [r[0] for r in rows.orderBy("i").select(T.capitalized(rows.t)).collect()]
    assert found == ["ẞheit", "Élan", "ﬁne", "ᾼx", "ᾈx", "ŉx", "ẞx", "", "1a", "A", None]


def _plain_ngrams(rows, sizes):
    grams = {(g, n): [] for g, _ in rows for n in sizes}
    for g, words in rows:
        for n in sizes:
            grams[g, n] += [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    return {key: (len({*found}), len(found)) for key, found in grams.items()}


def test_ngrams_of_contexts(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "a", "a", "bb", "bb", "ccc", "é", "\t", "x\x00y", "long" * 90, "dd", "ee"]
    texts = [(rng.choice(["p", "q", None]), [rng.choice(words) for _ in range(rng.randrange(30))]) for _ in range(200)]
    texts += [("p", ["same", "bb", "ccc"] * 9)] * 20 + [("p", ["a"] * 40), ("r", []), ("q", ["bb"])]
    for at_once in (50, 10_000):
        monkeypatch.setattr(lexical, "WORDS_AT_ONCE", at_once)
        rows = spark.createDataFrame([(g, " ".join(w)) for g, w in texts], "g string, text string")
        found = lexical.distinct_ngrams(rows, ["g"], lambda t: F.filter(F.split(t, " "), lambda w: w != ""), (1, 2, 3, 5)).collect()
        assert {(r.g, r.n): (r.uniq, r.total) for r in found} == _plain_ngrams(texts, (1, 2, 3, 5))


def test_ngrams_of_a_group_with_none(spark):
    """A group whose texts are shorter than a size has 0 of it, also where it shares a bucket's batch with others."""
    rows = spark.createDataFrame([("p", "a b c"), ("q", "a"), ("r", "")], "g string, text string")
    found = lexical.distinct_ngrams(rows, ["g"], T.ws_words, (1, 2)).collect()
    assert {(r.g, r.n): (r.uniq, r.total, r.distinct) for r in found if r.g != "p"} == {("q", 1): (1, 1, 1.0), ("q", 2): (0, 0, 0.0), ("r", 1): (0, 0, 0.0), ("r", 2): (0, 0, 0.0)}


def test_ngrams_travel_as_few_words():
    """Five sizes of grams take less than four words for each word of the text."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(1, 9))) for _ in range(20_000)]
    texts = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([words])], names=["_g", "_words"])
    batches = [*lexical._contexts([texts], 5)]
    assert len(words) < sum(pc.sum(b.column("_n")).as_py() for b in batches) < 4 * len(words)


def test_whole_bits(spark):
    """As conditional_bits of whole_pairs, with modes of unlike sizes, one with a single sample, repeated numbers, texts without words."""
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaabbc"), " ".join(rng.choices(["x", "y", "zz", "é", "w\u2028w", "q"], k=rng.randrange(9)))) for i in range(60)]
    rows += [(60, "a", None), (61, "b", " \n "), (61, "b", "x y"), (62, "d", "x\tx"), (63, None, "only here"), (-5, "c", "zz x")]
    samples = spark.createDataFrame(rows, "doc_id long, mode string, text string")
    numbered = pairwise.numbered(samples.fillna({"text": ""}), "mode", "doc_id", "text")
    words = numbered.select("mode", "k", F.explode(T.ws_words(F.col("text"))).alias("word")).groupBy("mode", "k", "word").agg(F.count("*").alias("c"))
    wanted = pairwise.conditional_bits(pairwise.whole_pairs(numbered.select("mode", "k"), "mode", "k"), words)
    plain = lambda df: {(r.ctx, r.tgt, r.k, r.ctx_k): (round(r.bits, 6), round(r.alone, 6)) for r in df.collect()}
    found = pairwise.whole_bits(samples, "mode", "doc_id", "text")
    assert found.count() == wanted.count()
    assert plain(found) == plain(wanted)


def test_matrix_is_read_once(spark):
    """Both directions of a pair come from one pass: before, the matrix was made twice and joined."""
    rows = spark.createDataFrame([("a", "b", 3.0), ("b", "a", 1.0), ("a", "a", 9.0), ("a", "c", 5.0), ("c", "b", 2.0), ("b", "c", 7.0)], "ctx string, tgt string, mean double")
    for report in (pairwise.asymmetry, pairwise.symmetry_fit):
        assert "Join" not in report(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.ctx, r.tgt): r.gap for r in pairwise.asymmetry(rows).collect()} == {("a", "b"): 2.0, ("b", "c"): 5.0}


def test_span_overlap_by_bins(spark):
    """As every token against every span, also over borders of bins and for empty ones; the tokens are never broadcast."""
    rng = random.Random(6)
    place = lambda: rng.choice([rng.randrange(4000), 1024 * rng.randrange(4), 1024 * rng.randrange(4) + 1])
    tokens = [(rng.randrange(3), t, *sorted((place(), place())), float(t % 5)) for t in range(150)] + [(0, 150, 2048, 2048, 1.0)]
    spans = [(rng.randrange(3), k, *sorted((place(), place()))) for k in range(40)] + [(0, 40, 2048, 2048), (0, 41, 2000, 2100)]
    wanted = {}
    for g, k, a, b in spans:
        hits = [(t, bits) for h, t, c, d, bits in tokens if h == g and d > a and c < b]
        if hits:
            wanted[g, k] = (min(hits)[0], max(hits)[0] + 1, sum(x for _, x in hits))
    left = spark.createDataFrame(tokens, "g long, t long, c_start long, c_end long, bits double")
    found = scorers.span_overlap(left, spark.createDataFrame(spans, "g long, k long, s_start long, s_end long"), ["g"])
    assert {(r.g, r.k): (r.first, r.stop, r.bits) for r in found.collect()} == wanted
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_sigmoids_find_the_same_middle(monkeypatch):
    """Of curves of 150 slots few middles are looked at one by one, and the fit is that of all of them."""
    rng, k = np.random.default_rng(7), np.arange(1.0, 151)
    down = lambda beta, k0: 20 + 90 / (1 + np.exp(beta * (k - k0)))
    shapes = [down(0.2, 40), down(3.0, 90.25), down(0.02, 260), down(0.5, -5), 5 + k, np.full(150, 7.0), np.zeros(150), 80 * np.exp(-0.3 * k), np.r_[np.full(149, 3.0), 0.0]]
    curves = [np.maximum(0, s + rng.normal(0, noise, 150)) for s in shapes for noise in (0.0, 4.0)]
    looked = []
    errors = fits._nonneg_errors
    monkeypatch.setattr(fits, "_nonneg_errors", lambda *a: looked.append(1) or errors(*a))
    quick = [fits.sigmoid_fit(k, y) for y in curves]
    assert len(looked) < 150 * len(curves)
    monkeypatch.setattr(fits, "LONG", 10**9)
    for y, found in zip(curves, quick, strict=True):
        np.testing.assert_equal(found, fits.sigmoid_fit(k, y))


def test_curves_are_dealt_out(spark):
    """A few bytes of curves aren't fitted in one task."""
    rows = spark.range(64).select(F.col("id").alias("g"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), (F.lit(9.0 - i) + F.col("id")).alias("v")) for i in range(1, 4)])).alias("p")).select("g", "p.*")
    found = fits.fit_curves(rows, ["g"], "v").select("g", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 64 and len({r.task for r in found}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_jaccard_workers_hold_little():
    """Sending the prefixes of 20 MB of texts takes less than 40 MB of a worker."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i:06d}" for i in range(50_000)])
    texts = [" ".join(words[rng.integers(0, 50_000, 500)]) for _ in range(5_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 1000])], names=["text"]) for i in range(0, 5_000, 1000)]
    send = jaccard._posting_sender(5, 80, 0, bytes(1 << jaccard.SLOT_BITS), 64)
    tracemalloc.start()
    rows = sum(len(b) for b in send(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 40e6


def _brute_components(edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


def test_components_by_tasks(spark, monkeypatch):
    rng = random.Random(5)
    chain = rng.sample(range(-300, 300), 120)
    edges = [*zip(chain, chain[1:], strict=False), *((1000, 1001 + k) for k in range(80)), *((rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)), (5, 5)]
    rng.shuffle(edges)
    for at_once in (7, 60, 200_000):
        monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
        table = spark.createDataFrame(edges, "a long, b long").repartition(9)
        found = [tuple(r) for r in components.components(table).collect()]
        assert dict(found) == _brute_components(edges) and len({*found}) == len(found), at_once


def test_few_edges_take_few_jobs(spark):
    table = spark.createDataFrame([(k + 1, k) for k in range(40)], "a long, b long").repartition(9)
    spark.sparkContext.setJobGroup("few edges", "few edges")
    try:
        assert components.components(table).count() == 41
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 10  # of counting edges, contracting them, and the count here
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jaccard_join_takes_few_jobs(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(120):
        words = list(base[i % 6])
        words[rng.randrange(60)] = f"x{i // 12}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.sparkContext.setJobGroup("join", "join")
    try:
        assert len({r.component_id for r in jaccard.jaccard_components(docs).collect()}) == 27
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("join")) <= 220  # 281 when each graph took rounds of shuffles
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
