"""The audit against every order played through on every document."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polyvox.llm import filter_audit, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def failing(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        out.append((i, s or "", {k for k, v in fails.items() if v}))
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out, docs = [], failing(rows)
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        total = Counter()
        found = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                lost = [i for i, f in left if letter in f]
                gone = sum(bool(f & set(order[: step - 1])) and letter in f for _, f in mine)
                left = [(i, f) for i, f in left if letter not in f]
                total[letter] += len(lost)
                found.append((part, order, step, len(left), len(lost), gone, sum(f == {letter} for _, f in mine), sum(i in good for i in lost), sum(i in toxic for i in lost)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Ab", "CD", "É", "ÀÈ"]
    texts = [" ".join(rng.choices(words[: rng.choice([5, 80, 404])], k=rng.choice([0, 10, 199, 200, 260]))) + rng.choice(["", "", " #", "|", " ABCDEFGHIJKLMNOPQRS"]) for _ in range(60)]
    texts += [None, "", " ", None, "A" * 2 + "x" * 98, "AAA" + "x" * 97]
    out = [(i * 2, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    out += [(300 + i, rng.choice(texts), "hot") for i in range(80)]
    return [*out, out[3], out[3], (None, texts[0], "a"), (None, texts[0], None), (0, texts[9], "a")]


def test_audit(spark, rows):
    labels = [(i * 2, i % 2, i % 5 == 0) for i in range(200)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    labels = [(i, q, int(t) if t is not None else None) for i, q, t in labels]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    odd = docs.select("*", *(F.lit(1).alias(c) for c in ("part", "bits", "h1", "good", "label_id", "first", "a.b")))
    for df in (docs, odd):
        assert sorted(tuple(r) for r in filter_audit.audit(df, spark.createDataFrame(labels, LABELS)).collect()) == brute(rows, labels)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], DOCS), labels)
    assert sorted(tuple(r) for r in one.collect()) == brute([(1, None, None)], [])


def test_outcomes():
    orders, found = filter_audit.outcomes()
    assert len(set(orders)) == 120 and found["kept"].shape == (32, 600)
    assert found["kept"][0].all() and not found["removed"][0].any() and not found["kept"][31].any()
    assert (found["removed"].reshape(32, 120, 5).sum(axis=2)[1:] == 1).all()  # what fails something is removed once in each order


def test_query_on_many_parts(spark, tmp_path, rows):
    many = [(i, t, f"part{i}") for i, t, _ in rows[:12]] * 1 + [(1000 + i, "x", f"p{i % 300}") for i in range(600)]
    spark.createDataFrame(many, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1001, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(tuple(r) for r in queries.op12_filter_audit(spark, str(tmp_path)).collect()) == brute(many, [(1001, 1, 1)])
