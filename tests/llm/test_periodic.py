"""Periodic runs against all stretches of small sequences, and the query against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyvox.llm import periodic, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words, min_words=12):
    """Every stretch, its smallest period, and whether a neighbour extends it."""
    n, out = len(words), []
    for period in range(1, n // 2 + 1):
        start = 0
        while start + period < n:
            stop = start + period
            while stop < n and words[stop] == words[stop - period]:
                stop += 1
            length = stop - start
            smaller = any(all(words[i] == words[i + q] for i in range(start, stop - q)) for q in range(1, period))
            grows = start > 0 and words[start - 1] == words[start - 1 + period]
            if length >= max(min_words, 2 * period) and not smaller and not grows:
                out.append((start, length, period))
            start += 1
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("frequent", [None, 0, 3, float("inf")])
def test_runs_of(monkeypatch, frequent):
    monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", 5)
    rng = random.Random(3)
    for case in range(250):
        ids = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(0, 70))]
        if case % 2 and ids:  # a planted period
            a, p = rng.randrange(len(ids)), rng.randrange(1, 12)
            ids[a:] = [ids[a + (i - a) % p] if a + (i - a) % p < len(ids) else 0 for i in range(a, len(ids))]
        for least in (2, 12):
            assert periodic.runs_of(np.array(ids, dtype=np.int32), least, frequent) == brute_runs(ids, least), ids


def test_lag_matches_of_frequent_and_rare_words():
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(3000) < 0.3, 0, rng.integers(1, 400, 3000)).astype(np.int32)
    want = [int((ids[: len(ids) - q] == ids[q:]).sum()) for q in range(len(ids) // 2 + 1)]
    for frequent in (None, 0, 20, float("inf")):
        assert periodic.lag_matches(ids, frequent).tolist() == want


def test_one_word_over_and_over_is_scanned_once(monkeypatch):
    scans, real = [], periodic.islands
    monkeypatch.setattr(periodic, "islands", lambda ids, lag, least: scans.append(lag) or real(ids, lag, least))
    assert periodic.runs_of(np.zeros(50_000, dtype=np.int32)) == [(0, 50_000, 1)]
    assert periodic.runs_of(np.tile(np.arange(7, dtype=np.int32), 3000)) == [(0, 21_000, 7)]
    assert scans == [1, 7]


def odd_texts():
    rng = random.Random(9)
    line = "alpha beta  gamma\tdelta\n"
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a " * 13, line * 3, line * 4, "x " + line * 30 + "y", "É é " * 9, "same same " * 40, "w" * 30_000]
    for _ in range(40):
        words = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 90))]
        texts.append(rng.choice([" ", "\n", "\x0b "]).join(words))
    return [*texts, texts[9], texts[9]]


def test_periodic_runs(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = df.select("*", F.lit(1).alias("runs"), F.lit("c").alias("collapsed"), F.lit(2).alias("doc"), F.col("doc_id").alias("a.b"))
    got = periodic.periodic_runs(df).collect()
    want = []
    for i, t in enumerate(texts):
        words = WORDS.findall(t or "")
        runs = brute_runs(words)
        want.append((i if i % 7 else None, t, len(words), [tuple(r) for r in runs], " ".join(collapsed(words, runs))))
    key = lambda r: repr(r)
    assert sorted([(r.doc.doc_id, r.doc.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=key) == sorted(want, key=key)
    assert got[0].doc["a.b"] == got[0].doc.doc_id and got[0].doc.runs == 1
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    texts = odd_texts()
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(5, texts[20]), (5, texts[20]), (None, texts[20])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = WORDS.findall(t or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *best, milli, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(collapsed(words, runs))), n))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
