"""Each operator against a plain version on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyvox.llm import chat, common, jaccard, license_scan, line_dedup, mixing, packing, quality, queries, substring, topk, urlfilter
from polyvox.llm.components import components
from polyvox.llm.queries import tokenizer_path

WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "h1 string, n_dropped int, kept string, rank int, drops string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def texts(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empty and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=64))
    out = []
    for i in range(n):
        kind = i % 6
        words = rng.choices(vocabulary, k=rng.choice([3, 40, 130, 400]))
        if kind == 1 and out:
            base = (rng.choice(out) or "").split()
            out.append(" ".join(base))
            continue
        if kind == 2 and out:
            base = (rng.choice(out) or "").split()
            for _ in range(max(0, len(base) // 60)):
                base[rng.randrange(len(base))] = "changed"
            out.append("\n".join(" ".join(base[k : k + 12]) for k in range(0, len(base), 12)))
            continue
        if kind == 3:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        out.append("\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)))
    return [*out, None, "", " \t\n", "one", "one", "One", "two words", "\n\n", "x" * 50_000, "long line of a very long text\n" * 4000, "İstanbul É\x0b ÀB\r"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns under names that the operators use themselves."""
    return df.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA.split(", ")), F.lit(1).alias("component"), F.lit("a").alias("doc"), F.lit(2).alias("position"))


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def same(got, want):
    null = lambda r: tuple((x is None, x) if x is not None else (True, "") for x in r)
    assert sorted(map(null, got)) == sorted(map(null, want))


def special(rows):
    """Rows with a null id, repeated rows, and an id that two texts share."""
    return [*rows, (None, rows[0][1], None, None, None), rows[5], rows[5], (rows[7][0], rows[8][1], "en", "s0", 1)]


def test_line_dedup(spark, table):
    for rows in (table, special(table)):
        got = line_dedup.line_dedup(clashing(frame(spark, rows))).select("doc.doc_id", "n_lines", "n_dropped", F.coalesce("kept", F.lit("")))
        same([tuple(r) for r in got.collect()], brute_lines(rows))


def test_line_dedup_other_thresholds(spark):
    rows = [(i, "a line that repeats\n" + f"own line number {i}", "en", "s", 1) for i in range(3)]
    out = lambda k: [r.n_dropped for r in line_dedup.line_dedup(frame(spark, rows), min_docs=k).orderBy("doc.doc_id").collect()]
    assert (out(2), out(3), out(4)) == ([0, 1, 1], [0, 1, 1], [0, 0, 0])


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert line_dedup.line_dedup(empty).count() == quality.quality(empty).count() == substring.substring_dedup(empty).count() == 0
    assert jaccard.jaccard_components(empty).count() == license_scan.scan_licenses(empty).count() == mixing.mix(empty).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat.read_back(chat.prefix_target_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def brute_substrings(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window, prefix", [(50, 10), (12, 5), (50, 50)])
def test_substring_dedup(spark, table, window, prefix):
    for rows in (table, special(table)):
        got = substring.substring_dedup(clashing(frame(spark, rows)).repartition(5), window, prefix)
        same([tuple(r) for r in got.collect()], brute_substrings(rows, window))


@pytest.mark.parametrize("words", [60, 400])
def test_substring_dedup_in_small_groups(spark, table, monkeypatch, words):
    """Groups that hold next to nothing: all prefixes are lengthened, up to whole windows."""
    monkeypatch.setattr(substring, "BATCH_BYTES", 2000)
    monkeypatch.setattr(substring, "GROUP_WORDS", words)
    got = substring.substring_dedup(frame(spark, table).repartition(3), 20, 5)
    same([tuple(r) for r in got.collect()], brute_substrings(table, 20))


@pytest.mark.parametrize("around", [0, 15])
def test_substring_dedup_of_a_passage_in_every_document(spark, monkeypatch, around):
    """No group is held beyond its share, whether the passage stands in different surroundings or not."""
    rng = random.Random(4)
    other = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = other(45)
    rows = [(i, f"{other(around)} {shared} {other(around)}", "en", "s", 1) for i in range(150)]
    held = []
    real = substring.later_windows
    monkeypatch.setattr(substring, "later_windows", lambda stretches, docs, window: held.append(sum(map(len, stretches))) or real(stretches, docs, window))
    for name, value in (("BATCH_BYTES", 500), ("GROUP_WORDS", 300)):
        monkeypatch.setattr(substring, name, value)
    got = substring.substring_dedup(frame(spark, rows).repartition(3), 20, 5)
    same([tuple(r) for r in got.collect()], brute_substrings(rows, 20))

    def batch(found):
        return pa.RecordBatch.from_pylist([{**dict(zip(substring._NAMES, r, strict=True))} for r in found], schema=pa.schema(list(zip(substring._NAMES, substring._TYPES, strict=True))))

    lines = [(1, 7, i, i, 0, 26, shared.encode()) for i in range(150)]
    out = [r for b in substring._grouper(20, 8)(iter([batch(lines[:70]), batch(lines[70:])])) for r in b.to_pylist()]
    assert max(held) <= 300 and sum(r["kind"] == 0 for r in out) > 100
    assert sum(r["kind"] == 1 for r in out) <= 26 * 30


def test_tree_nodes():
    rng = random.Random(3)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(500)]
    for depth in (1, 2, 3, 5, 8, 13):
        node = substring.tree_nodes(words, depth)
        of = {}
        for i in range(len(words) - depth + 1):
            assert of.setdefault(tuple(words[i : i + depth]), node[i]) == node[i]
        assert len(set(of.values())) == len(of) and len(node) == len(words) - depth + 1


def test_word_hashes():
    rng = random.Random(8)
    words = ["".join(rng.choices("abé\x00ß日", k=rng.choice([1, 2, 3, 9]))).encode() for _ in range(60_000)] + [b"x" * 200_000, b"y" * 65_536]
    text = b"".join(w + rng.choice([b" ", b"\n\t", b"\x0b"]) for w in words)
    got = common.word_hashes(text).tolist()
    assert len(got) == len(words) and len(set(got)) == len(set(words)) == len(set(zip(words, got, strict=True)))
    for w in rng.sample(words, 50) + words[-2:]:
        assert common.word_hashes(b" " + w + b" ").tolist() == [got[words.index(w)]]
    assert not len(common.word_hashes(b"")) and not len(common.word_hashes(b" " * 200_000))


def shingle_set(text):
    w = WORDS.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    ids = [r[0] for r in rows]
    sets = [shingle_set(r[1]) for r in rows]
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(rows)):
        for y in range(x):
            if ids[x] is not None and ids[y] is not None and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(ids[x]), find(ids[y])))
                    parent[b] = a
    return [(i, len(s), (i if not s else find(i)) if i is not None else None) for i, s in zip(ids, sets, strict=True)]


def test_jaccard_components(spark, table):
    for rows in (table, special(table)):
        got = jaccard.jaccard_components(clashing(frame(spark, rows)).repartition(4))
        same([tuple(r) for r in got.collect()], brute_components(rows))


def test_jaccard_chains_of_near_copies(spark):
    """Chains whose ends are far apart, groups of near copies, and many texts around one common passage."""
    rng = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(40):
        rows.append((len(rows), " ".join(base), "en", "s", 1))
        base[(k * 7) % 120] = f"new{k}"
    common = [f"c{k}" for k in range(60)]
    for _ in range(60):
        own = [f"u{rng.random()}" for _ in range(rng.choice([2, 8, 30]))]
        rows.append((len(rows), " ".join(common + own), "en", "s", 1))
    rng.shuffle(rows)
    got = jaccard.jaccard_components(frame(spark, rows).repartition(6))
    same([tuple(r) for r in got.collect()], brute_components(rows))


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)}


def brute_quality(text):
    t = text or ""
    w = WORDS.findall(t)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, table):
    for rows in (table, special(table)):
        got = quality.quality(clashing(frame(spark, rows))).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        same([tuple(r) for r in got], [(r[0], *brute_quality(r[1])) for r in rows])


def test_quality_lines(spark):
    prose = [" ".join(f"word{9 * k + j}" for j in range(9)) + "." for k in range(12)]
    menu = "Home | About us | Products | Contact | Log in"
    rows = [
        (1, "\n".join(prose), "en", "s", 1),
        (2, "\n".join([menu, *prose, "All rights reserved."]), "en", "s", 1),
        (3, "\n".join([*prose[:5], *[f"{menu} | item{k} | other{k} | third{k}" for k in range(20)]]), "en", "s", 1),
        (4, " ".join(f"word{k}### " for k in range(90)), "en", "s", 1),
    ]
    got = {r.doc.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[1].cleaned == got[2].cleaned == "\n".join(prose)


def test_license_scan(spark, table):
    told = [
        "Released under the MIT License. See Apache-License and CC BY 4.0; CC-BY!",
        "gnu  general,public\nLICENSE gnu general public license",
        "x " * 500 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met" + " y" * 300,
        "permission to use a house",
    ]
    rows = [*table, *((900 + k, t, "en", "s", 1) for k, t in enumerate(told)), (None, told[0], None, None, None), table[3]]
    want = []
    for i, t, *_ in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        starts, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    out = license_scan.scan_licenses(clashing(frame(spark, rows)))
    same([tuple(r) for r in out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()], want)
    extra = {r.doc_id: (r.labels, r.score) for r in out.where("doc_id >= 900").collect()}
    assert extra[900] == ("apache,cc-by,mit", 1.0) and extra[902][0] == "bsd" and 0.8 <= extra[902][1] <= 1 and extra[903] == ("", 0.0)


def plain_matches(words, templates, threshold=0.8):
    """Best containment by label, of every block in full; of versions that overlap, the one that has most."""
    hits = []
    for label, text in templates:
        own = license_scan.words_of(text.encode())
        tokens, size = set(own), len(own)
        must = {w for w in re.split("[-.]", label.encode().decode()) if size < 20 and w.encode() in tokens}
        for start in range(0, max(1, len(words) - size), size):
            held = tokens & set(words[start : start + 2 * size])
            if len(held) / len(tokens) >= threshold - 1e-9 and {w.encode() for w in must} <= held:
                hits.append((label, tokens, start, start + 2 * size, len(held) / len(tokens)))
    family = lambda label: re.search("[0-9]", label) and label.split("-")[0]
    want = {}
    for label, tokens, start, stop, share in hits:
        rivals = [h for h in hits if family(label) and family(h[0]) == family(label) and h[0] != label and h[2] < stop and start < h[3]]
        if not any(h[4] > share or (h[4] == share and tokens < h[1]) for h in rivals):
            want[label] = max(want.get(label, 0), share)
    return want


def test_license_filters_lose_nothing():
    rng = random.Random(3)
    every = [w for _, text in license_scan.TEMPLATES for w in license_scan.words_of(text.encode())]
    order = Counter(every)
    table = license_scan.Templates(license_scan.TEMPLATES, order, 0.8)
    for k in range(300):
        label, text = rng.choice(license_scan.TEMPLATES)
        words = [w for w in license_scan.words_of(text.encode()) if rng.random() > 0.15]
        around = rng.choices(every if k % 2 else [b"x"], k=rng.choice([0, 3, 170, 900]))
        words = around[: len(around) // 3] + words + around[len(around) // 3 :]
        assert table.matches(words) == plain_matches(words, license_scan.TEMPLATES)


def test_every_license_filter_removes_blocks():
    rng = random.Random(8)
    every = sorted({w for _, text in license_scan.TEMPLATES for w in license_scan.words_of(text.encode())})
    table = license_scan.Templates(license_scan.TEMPLATES, Counter(rng.choices(every, k=5000)), 0.8)
    for size in (3, 10, 40, 300):
        for _ in range(40):
            words = rng.choices(every, k=size)
            assert table.matches(words) == plain_matches(words, license_scan.TEMPLATES)
    assert min(table.removed[f] for f in ("length", "prefix", "position")) > 0


def test_license_versions_do_not_contradict_one_another():
    table = license_scan.Templates(license_scan.TEMPLATES, {}, 0.8)
    found = lambda text: {x for x in table.matches(license_scan.words_of(text.encode())) if any(c.isdigit() for c in x)}
    around = lambda text: f"{'some text before ' * 30}{text}{' and some after' * 30}"
    for version in "23":
        assert found(around(f"This work is licensed under the GNU General Public License, version {version}.")) == {f"gpl-{version}.0"}
    for kind in ("", "-sa", "-nc"):
        assert found(around(f"Licensed under CC BY{kind.upper()} 4.0.")) == {f"cc-by{kind}-4.0"}
    assert found(around("This work is licensed under the GNU General Public License.")) == set()
    assert found(around("Licensed under CC BY.")) == set()
    for label, text in license_scan.TEXTS:
        if label.startswith(("gpl", "cc-", "apache")):
            assert found(around(text)) == {label}
    two = around("Licensed under CC BY 4.0.") + around("Licensed under CC BY-SA 4.0.")
    assert found(two) == {"cc-by-4.0", "cc-by-sa-4.0"}


def test_licenses_are_found_wherever_they_stand(spark):
    """Whole texts, a word in ten lost, across the borders of blocks and behind much else."""
    rng = random.Random(9)
    rows, want = [], {}
    for i, (label, text) in enumerate(license_scan.TEXTS):
        words = [w.decode() for w in license_scan.words_of(text.encode())]
        for k, before in enumerate((0, 7, 101, 20_000)):
            kept = [w for n, w in enumerate(words) if len(words) < 20 or n % 10 != k]
            rows.append((10 * i + k, " ".join(["filler"] * before + kept + ["end"] * rng.randrange(300)), "en", "s", 1))
            want[10 * i + k] = label
    rows.append((9999, "an apache flew under the general license of public work " * 30, "en", "s", 1))
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert {i: want[i] for i in want if want[i] not in got[i].labels.split(",") or got[i].score < 0.8} == {}
    assert got[9999].labels == "" and got[9999].score < 0.8
    with pytest.raises(ValueError):
        license_scan.Templates([("a", "word " * 3_000_000)], {}, 0.8)


def test_chat(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", r"<\|im_end|> <\\| \n", "", None, "<", "|", "a\nb", "é<|", "%0A%25"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "rô\nle%0A", "<|im_start|>", None]), rng.choice(odd)) for c in (1, 2, None) for t in range(25)]
    rows += [(3, None, "assistant", "x"), (3, 1, "user", None), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, "user", "no reply")]
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append(((t is not None, t or 0), r or "", x or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.append((c, len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "example": F.lit("x")})
    examples = chat.prefix_target_examples(df)
    same([tuple(r)[:5] for r in chat.read_back(examples).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()], want)
    full = chat.context_and_target(examples).where("conv_id = 4").orderBy("example").collect()
    assert [r.target for r in full] == ["same", "same"]
    assert full[1].context == "<|im_start|>assistant\nsame<|im_end|>\n<|im_start|>assistant\n"
    for r in chat.context_and_target(examples).where("conv_id = 1").collect():
        before = groups[1][: r.example]
        assert r.target == groups[1][r.example][2] and r.context.count(chat.START) == len(before) + 1 and r.context.count(chat.END) == len(before)
    assert Counter(r.conv_id for r in examples.where("target_start is not null").collect()) == Counter(c for c, turns in groups.items() for _, role, _ in turns if role == "assistant")
    chars = {r[0]: r[1] for r in examples.groupBy("conv_id").agg(F.sum(F.length("text"))).collect()}
    assert chars == {r.conv_id: r.formatted_chars for r in chat.read_back(examples).collect()}


def test_chat_of_many_turns(spark):
    """Each reply's context is all of the conversation before it, however long."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} <|im_end|> " + "x" * 200) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.read_back(chat.prefix_target_examples(df)).collect()
    each = [len(f"<|im_start|>{r}\n{x}<|im_end|>\n") + 1 for _, _, r, x in rows]
    assert [(r.n_turns, r.loss_chars, r.formatted_chars) for r in got] == [(600, sum(len(x) for _, _, r, x in rows if r == "assistant"), sum(sum(each[: t + 1]) for t in range(1, 600, 2)))]


def test_url_filter(spark):
    urls = [
        "http://a.EXAMPLE.org/es/1", "https://example.org/en/1x", "https://example.org/en/2", "ftp://x.com/fr/?q#z", "x://www.de.com/de/a?b", "http://com/fr/",
        "http://xexample.org/es/", "http://example.org", "http://example.org?x=/es/", "no mark", "", None, "http://", "http:///es/", "a://example.org./es/", "http://EXAMPLE.com/De/",
    ]
    rules = [*urlfilter.RULES, ("block", "deep.a.net", "/"), ("allow", "a.net", "/x/y"), ("block", "a.net", "/x")]
    urls += ["http://a.net/x/yz", "http://a.net/xx", "http://b.deep.a.net/x/y", "http://a.net/y"]

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
            host, path = lower(rest.split("/", 1)[0]), "/" + rest.split("/", 1)[1] if "/" in rest else ""
        fits = [(len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"

    rows = [(k, u, "html") for k, u in enumerate(urls)] + [(None, urls[0], None), (0, urls[0], "html")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = urlfilter.filter_urls(df, rules)
    same([tuple(r) for r in got.collect()], [(i, *judge(u)) for i, u, _ in rows])


def test_url_rules_deep_and_many(spark):
    """A path of 5,000 segments, and 100,000 rules that end below one directory."""
    deep = "/" + "a/" * 5_000
    rules = [("block", "deep.org", deep), ("allow", "deep.org", deep + "b"), ("allow", "x.org", "/p/"), *(("block", "x.org", f"/p/{n}") for n in range(100_000))]
    urls = [f"http://deep.org{deep}", f"http://deep.org{deep}bc", f"http://deep.org{deep[:-1]}", "http://x.org/p/99999/q", "http://x.org/p/1234567", "http://w.x.org/p/x", "http://x.org/p", "http://org/p/1"]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(pages, rules, "none").collect()}
    assert got == {
        0: (f"deep.org{deep}", "block"), 1: (f"deep.org{deep}b", "allow"), 2: (None, "none"), 3: ("x.org/p/99999", "block"),
        4: ("x.org/p/12345", "block"), 5: ("x.org/p/", "allow"), 6: (None, "none"), 7: (None, "none"),
    }


def test_url_trie_against_prefixes():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("ab/", k=rng.randrange(5)))
    hosts = ["a", "b.a", "c.b.a", "a.b", ""]
    for _ in range(200):
        rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((rng.choice(hosts), word()) for _ in range(8))}.values())
        trie = urlfilter.Trie(rules)
        for _ in range(20):
            host, path = rng.choice(hosts), word()
            fits = [(h.count(".") + 1, len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert trie.longest(host, path) == (max(fits)[2:] if fits else None)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.integers(-3, 4, 8) / 8) for i in range(400)] + [(500 + i, np.ones(8) * 0.3) for i in range(60)]
    rows = [(i, [float(x) for x in v]) for i, v in vectors]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, []), (1201, [0.5] * 3), (7, rows[7][1]), (8, [9.0] * 8), (50, [0.1] * 8)]
    valid = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid[i].append(np.floor(np.pad(np.array(v, dtype=np.float32).astype(float), (0, 8 - len(v))) * 256))
    want = []
    for q in valid:
        if q % 50 == 0:
            best = sorted((-max(int(a @ b) for a in valid[q] for b in valid[c]), c) for c in valid if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    same([tuple(r) for r in topk.top_k(df.repartition(3)).collect()], want)


def test_top_k_few_rows_and_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 5), 1.0]) for i in range(0, 300, 25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(df, k=20).collect()))
    for name, value in (("QUERIES_PER_ROW", 2), ("QUERIES_PER_PACK", 1), ("ROWS_PER_STRIPE", 3), ("ROWS_PER_BLOCK", 2)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.top_k(df, k=20).collect())) == whole
    assert len(whole) == 6 * 11


def test_top_k_of_large_components(spark):
    """Exact beyond the integers of doubles; beyond the range of a long the score is the end of that range."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([1, -1]) * (2.0**40 + rng.randrange(1000) / 4), float(rng.randrange(10**6)), 0.5]) for i in range(0, 60, 2)]
    rows += [(i, [float(rng.randrange(10**5)) * 1.25, 2.0**36, -1.0]) for i in range(1, 60, 2)] + [(100, [1e300, 0.0, 0.0])]
    exact = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        scores = {c: min(max(sum(a * b for a, b in zip(exact[q], exact[c], strict=True)), -(2**63)), 2**63 - 1) for c in exact if c != q}
        want += [(q, n + 1, c, scores[c]) for n, c in enumerate(sorted(scores, key=lambda c: (-scores[c], c))[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 2, None: 3}, {"s0": 2.5, "s2": 0.25}])
def test_mixing(spark, weights):
    rng = random.Random(1)
    rows = [(i, f"text {i}", "en", rng.choice(["s0"] * 9 + ["s1", "s2", None]), 1) for i in range(700)]
    rows += [rows[0], rows[0], (None, None, None, None, None)]
    out = mixing.mix(clashing(frame(spark, rows)), weights, block_docs=4).collect()
    assert Counter(r.doc.doc_id for r in out) == Counter(r[0] for r in rows)
    assert len({r.position for r in out}) == len(rows)
    slots = {r.slot: (r.src, r.block) for r in out}
    assert len(set(slots.values())) == len(slots) and all(r.release <= r.slot < r.deadline for r in out)
    assert [(r.src, r.block, r.slot) for r in out] == [(r.src, r.block, r.position // 4) for r in out]
    check_shares(slots, {s: (weights or {}).get(s, 1) for s in ("s0", "s1", "s2", None)})


def check_shares(slots, weights):
    """No source is a block off its share before one runs out; after that, the others are less than two off theirs of what they have between them."""
    total = Counter(s for s, _ in slots.values())
    every, seen, now, past = sum(weights.values()), Counter(), 0, 0
    for t in sorted(slots):
        gone = {s for s in weights if seen[s] == total[s]}
        assert gone or t == now  # no slot is empty as long as all have blocks
        seen[slots[t][0]] += 1
        now += 1
        if not gone:
            assert all(abs(seen[s] - now * weights[s] / every) < 1 for s in weights)
        left = {s: weights[s] for s in weights if seen[s] < total[s]}
        past += len(left) > 1
        assert all(abs(seen[s] - sum(seen[x] for x in left) * w / sum(left.values())) < 2 for s, w in left.items())
    assert past


def test_mixing_of_a_thousand_sources(spark):
    rng = random.Random(3)
    weights = {f"s{i}": rng.choice([0.5, 1.5, 2, 7]) for i in range(0, 1000, 3)}
    rows = [(n, "t", "en", f"s{i}", 1) for n, i in enumerate(i for i in range(1000) for _ in range(rng.randint(1, 3) * 8))]
    out = mixing.mix(frame(spark, rows), weights, block_docs=1).collect()
    slots = {r.slot: (r.src, r.block) for r in out}
    assert len(slots) == len(rows) and all(r.release <= r.slot < r.deadline for r in out)
    all_weights = {f"s{i}": weights.get(f"s{i}", 1) for i in range(1000)}
    total, every, seen = Counter(r.src for r in out), sum(all_weights.values()), Counter()
    for t in range(len(slots)):
        if any(seen[s] == total[s] for s in seen):
            break
        seen[slots[t][0]] += 1
        assert all(abs(seen[s] - (t + 1) * w / every) < 1 for s, w in all_weights.items())
    assert t > 1000


def test_whole_parts():
    assert mixing.whole_parts({"a": 2.5, "b": 1}) == ({"a": 5, "b": 2}, 2)
    assert mixing.whole_parts({"a": 8, "b": 4}) == ({"a": 8, "b": 4}, 1)
    named, other = mixing.whole_parts({"a": 1 / 3, "b": 1e-9})
    assert named["b"] == 1 and abs(named["a"] / other - 1 / 3) < 0.01
    for wrong in (0, -1):
        with pytest.raises(ValueError):
            mixing.whole_parts({"a": wrong})


def test_source_mixing_is_weighted(spark, tmp_path):
    """In the first cycle of the registered query each source has its parts."""
    rows = [(i, f"text {i}", "en", f"src{i % 4}", 1) for i in range(4 * 16 * 8)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_source_mixing(spark, str(tmp_path)).where("slot < 15").select("source", "slot").distinct().collect()
    assert Counter(r.source for r in out) == {"src0": 8, "src1": 4, "src2": 2, "src3": 1}


def test_plan_bins():
    rng = random.Random(6)
    for capacity, n in ((20, 300), (100, 2000), (2048, 3000)):
        counts = Counter(rng.randint(1, capacity) for _ in range(n)) + Counter({capacity // 3: 500})
        bins = packing.plan_bins(dict(counts), capacity)
        held = Counter()
        for lengths, copies in bins:
            assert sum(lengths) <= capacity and copies > 0
            for x in lengths:
                held[x] += copies
        assert held == counts
        left = np.array([counts[k] for k in range(capacity + 1)])
        assert sum(c for _, c in bins) <= sum(c for _, c in packing._best_fit(left, capacity)) * 1.005


def fewest_bins(pieces, capacity):
    """The least number of bins, by trying every place for every piece."""
    best = len(pieces)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + pieces[i] <= capacity and bins[b] not in bins[:b]:
                place(i + 1, [*bins[:b], bins[b] + pieces[i], *bins[b + 1 :]])
        place(i + 1, [*bins, pieces[i]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best


def test_plan_bins_against_all_plans():
    rng, over = random.Random(2), 0
    for _ in range(300):
        pieces = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        more = sum(c for _, c in packing.plan_bins(Counter(pieces), 12)) - fewest_bins(pieces, 12)
        assert 0 <= more <= 1
        over += more
    assert over <= 15


def test_sums():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 30) for _ in range(25))
    for gap in range(1, 31):
        for longest in range(1, 31):
            found = list(packing.SumIndex(counts, 40).fillers(gap, longest))
            there = [x for x in counts if x <= longest]
            want = {(a,) for a in there if a == gap}
            want |= {(a, b) for a in there for b in there if a >= b and a + b == gap}
            want |= {(a, b, c) for a in there for b in there for c in there if a >= b >= c and a + b + c == gap}
            assert sorted(found) == sorted(want)


def test_packing(spark, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [*special(table), (7000, "a <|endoftext|> b ½² ǅ \u3000 'S don't 12.5  \n\n x\x1cy ßẞ 日本 e\u0301", "en", "s", 1)]
    out = packing.pack(clashing(frame(spark, rows)), tokenizer_path()).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % 2048 or 2048
        stops = [len(ids)] if len(ids) <= 2048 else [*range(cut, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
