"""Each stage of the pipeline against its plain version, on rows with nulls, repeats and junk, and on the smallest tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from test_operators import brute_components, brute_lines, brute_quality, clashing, frame, special, texts

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def by_text(rows):
    return Counter((r[0], r[1]) for r in rows)


def check_stages(spark, docs, tmp_path):
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == columns, name
            after = rows_of(docs)
        if number == 0:
            passed = [r for r in before if not brute_quality(r[1])[-1]]
            assert {r[0] for r in after} <= {r[0] for r in passed}
        elif number == 1:
            want = Counter((i, kept) for (i, _, _, kept) in brute_lines(before))
            assert Counter((i, t or "") for i, t in by_text(after).elements()) == want
            assert all(r[4] == len(r[1]) for r in after if r[1] is not None and (r[0], r[1]) not in by_text(before))
        elif number == 2:
            stays = {i for i, _, c in brute_components(before) if i is None or c == i}
            assert by_text(after) == by_text([r for r in before if r[0] in stays])
        elif number == 3:
            assert Counter(before) == Counter(after)
        else:
            got = docs.collect()
            assert {r.doc_id for r in got} == {r[0] for r in before}
            used = Counter()
            for r in got:
                used[r.sequence_id] += r.length
            assert all(0 < n <= 2048 for n in used.values())
    return docs


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts(3, 80))]
    check_stages(spark, clashing(frame(spark, special(rows))), tmp_path)


def test_stages_on_no_rows(spark, tmp_path):
    assert check_stages(spark, frame(spark, []), tmp_path).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = check_stages(spark, docs, tmp_path)
    out = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, out.drop("sequence_id", "offset").collect())) == Counter(map(tuple, last.drop("sequence_id", "offset").collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_clean_documents_stay(spark):
    """Labelled documents of good quality that pass the base rules are kept with their text as it is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id", "left_semi")
    kept = {r.doc_id: r.text for r in corpus_pipeline.clean(spark, docs, SF).collect()}
    clean = [r for r in good.collect() if not brute_quality(r.text)[-1]]
    assert all(r.doc_id in kept for r in clean)
    assert sum(kept[r.doc_id] == r.text for r in clean) >= 0.99 * len(clean)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_keeps_the_mix(spark, tmp_path, monkeypatch):
    """Sequences of run() follow the mix, run of positions by run."""
    monkeypatch.setattr(corpus_pipeline.packing.pack_in_order, "__defaults__", (2048, 16))
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    real = corpus_pipeline.mixing.mix

    def mix(rows, weights):
        assert len(set(weights.values())) > 1
        out = real(rows, weights)
        seen.update((r.doc_id, r.position) for r in out.select("doc.doc_id", "position").collect())
        return out

    monkeypatch.setattr(corpus_pipeline.mixing, "mix", mix)
    rows = corpus_pipeline.run(spark, SF).collect()
    place = {d: n for n, d in enumerate(sorted(seen, key=seen.get))}
    runs = {}
    for r in rows:
        runs.setdefault(r.sequence_id, []).append(place[r.doc_id])
    assert sorted(runs) == list(range(len(runs)))
    assert all(len({p // 16 for p in at}) == 1 for at in runs.values())
    assert [min(runs[s]) // 16 for s in sorted(runs)] == sorted(min(at) // 16 for at in runs.values())
    firsts = [min(runs[s]) for s in sorted(runs)]
    assert firsts == sorted(firsts)


def test_names_with_dots_and_backticks(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", len(text), 1, 2), (2, text, "en", "s", len(text), 3, 4), (3, "other " + text[:300], "en", "s", 306, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert sorted(kept.columns) == sorted(docs.columns)
        assert {r["doc_id"]: (r["a.b"], r["c`d"]) for r in kept.collect()}.items() <= {1: (1, 2), 2: (3, 4), 3: (5, 6)}.items()


def test_files_in_the_order_of_their_numbers():
    names = [f"part-{n:05d}-{tag}.parquet" for n, tag in ((0, "z"), (9, "b"), (99_999, "y"), (100_000, "a"), (1_000_000, "a"))]
    assert sorted(reversed(names), key=corpus_pipeline._file_order) == names
