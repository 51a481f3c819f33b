"""Readers, sinks, text expressions, generators, streaming and the command line on small files."""

import json

import pytest
from pyspark.sql import functions as F

from polyvox.functions import text as T
from polyvox.sources import generators, readers, sinks


def test_response_log(spark, tmp_path):
    rows = [(0.5, 1, 2, "p", "b"), (0.5, 1, 1, "p", "a"), (0.5, 1, 2, "p", "c"), (1.0, 1, 1, "q", "d")]
    lines = [json.dumps(dict(zip(("scale", "prompt_idx", "response_idx", "prompt", "response"), r, strict=True))) for r in rows]
    (tmp_path / "log.jsonl").write_text("\n\n".join(lines))
    sets = readers.ordered_sets(readers.response_log(spark, str(tmp_path / "log.jsonl"))).orderBy("scale").collect()
    assert [(r.scale, r.prompt, r.responses) for r in sets] == [(0.5, "p", ["a", "c"]), (1.0, "q", ["d"])]


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text('sample_id,sidecar_key,resp_10,resp_2,metric_a,label_value\ns1,,"ten\nlines","two, ""x""",,1\ns2,k2,b,,0.5,oops\n', encoding="utf-8")
    df = readers.wide_csv(spark, str(tmp_path / "w.csv"))
    assert readers.response_columns(df) == ["resp_2", "resp_10"]
    got = {(r.sample_id, r.k, r.response) for r in readers.unpivot_responses(df, ["sample_id"]).collect()}
    assert got == {("s1", 1, 'two, "x"'), ("s1", 2, "ten\nlines"), ("s2", 2, "b")}
    metrics = {r.sample_id: (r.metric_a, r.label_value) for r in readers.typed_metrics(df, ["sample_id"]).collect()}
    assert metrics == {"s1": (None, 1.0), "s2": (0.5, None)}
    assert {r.key for r in readers.keyed(df).collect()} == {"s1", "k2"}


def test_sidecar_and_names(spark, tmp_path):
    (tmp_path / "x.sidecar.json").write_text(json.dumps({"__run_config__": {}, "a": {"c": 0.5, "curve": [1.0, 2.0]}, "b": {"c": None}}))
    got = {r.key: (r.c, r.curve) for r in readers.sidecar(spark, str(tmp_path / "x.sidecar.json"), "c: double, curve: array<double>").collect()}
    assert got == {"a": (0.5, [1.0, 2.0]), "b": (None, None)}
    for t in ("0.5", "1.5"):
        (tmp_path / f"T_{t}.json").write_text(json.dumps({"d": float(t)}))
    found = readers.by_file_name(spark, str(tmp_path), "T_*.json", "d double", "temperature", r"T_([0-9.]+)\.json").collect()
    assert {(r.temperature, r.d) for r in found} == {("0.5", 0.5), ("1.5", 1.5)}


def test_text_tables_and_keys(spark, tmp_path):
    (tmp_path / "t.txt").write_text("== first\nrho  0.5\nnoise\n== second\nrho  0.7\n")
    got = readers.tagged_lines(spark, str(tmp_path / "t.txt"), r"^== (\w+)", r"^(\w+)\s+([0-9.]+)$", ["name", "value"]).orderBy("at").collect()
    assert [(r.section, r.name, r.value) for r in got] == [("first", "rho", "0.5"), ("second", "rho", "0.7")]
    (tmp_path / "a.tex").write_text("\\cite{x, y} % \\cite{no}\n\\citep[see][p. 1]{z} 5\\% \\cite*{w}")
    assert {r.key for r in readers.cite_keys(spark, str(tmp_path / "a.tex")).collect()} == {"x", "y", "z", "w"}
    (tmp_path / "a.bib").write_text("@article{x,\n title={a}}\n@comment{q}\n@book{y,\n}\n@misc{x,\n}")
    assert {r.key: r.entries for r in readers.bib_keys(spark, str(tmp_path / "a.bib")).collect()} == {"x": 2, "y": 1}


def test_tensor_and_completions(spark, tmp_path):
    df = spark.createDataFrame([("m", [[1.0, 2.0], [3.0, 4.0]])], "model string, v array<array<double>>")
    assert {(r.i, r.j, r.value) for r in readers.tensor(df, "v", ["i", "j"]).collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)}
    spark.createDataFrame([("a", "p", ["x", "y"])], "id string, prompt string, completions array<string>").write.parquet(str(tmp_path / "c"))
    assert [(r.k, r.response) for r in readers.completions(spark, str(tmp_path / "c")).orderBy("k").collect()] == [(1, "x"), (2, "y")]


def test_seeded_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in readers.seeded_sample(df, "k", 10, 7).collect()]
    assert a == [r.k for r in readers.seeded_sample(df.repartition(7), "k", 10, 7).collect()] and len(set(a)) == 10
    assert a != [r.k for r in readers.seeded_sample(df, "k", 10, 8).collect()]


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (None, "n")], "k long, v string")
    assert sorted(map(tuple, sinks.append_new(df, path, ["k"]).collect()), key=str) == [(1,), (2,), (None,)]
    more = spark.createDataFrame([(2, "again"), (3, "c"), (None, "n")], "k long, v string")
    assert [r.k for r in sinks.append_new(more, path, ["k"]).collect()] == [3]
    assert sinks.append_new(more, path, ["k"]).count() == 0
    assert sorted((tuple(r) for r in sinks.appended(spark, path).collect()), key=str) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]


def test_a_write_that_stops_is_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "k long, v double").repartition(4)
    failing = df.withColumn("v", F.when(F.col("k") == 13, F.raise_error(F.lit("stopped")).cast("double")).otherwise(F.col("v")))
    sinks.append_new(df.where("k < 5"), path, ["k"])
    with pytest.raises(Exception, match="stopped"):
        sinks.append_new(failing, path, ["k"])
    assert sinks.appended(spark, path).count() == 5
    assert sinks.append_new(df, path, ["k"]).count() == 15 and sinks.appended(spark, path).count() == 20


def test_citations_through_included_files(spark, tmp_path):
    (tmp_path / "parts" / "deep").mkdir(parents=True)
    (tmp_path / "main.tex").write_text("\\cite{a}\n\\input{parts/one} % \\input{parts/unused}\n\\include{./parts/two.tex}")
    (tmp_path / "parts" / "one.tex").write_text("\\citep{b, c} \\input{deep/three}")
    (tmp_path / "parts" / "two.tex").write_text("\\input{one}\\input{../main}")  # back again
    (tmp_path / "parts" / "deep" / "three.tex").write_text("\\cite{d}\\input{../two}\\input{../../parts/one}")
    (tmp_path / "parts" / "unused.tex").write_text("\\cite{z}")
    files = {r.path.rsplit(f"{tmp_path}/")[-1]: r.found for r in readers.included_files(spark, str(tmp_path), "main.tex").collect()}
    assert files == {"main.tex": True, "parts/one.tex": True, "parts/two.tex": True, "parts/deep/three.tex": True}
    got = {(r.file, r.key) for r in readers.reached_cite_keys(spark, str(tmp_path), "main.tex").collect()}
    assert got == {("main.tex", "a"), ("one.tex", "b"), ("one.tex", "c"), ("three.tex", "d")}
    (tmp_path / "parts" / "two.tex").write_text("\\input{gone}")
    with pytest.raises(Exception, match="no file"):
        readers.reached_cite_keys(spark, str(tmp_path), "main.tex").collect()
    with pytest.raises(FileNotFoundError):
        readers.included_files(spark, str(tmp_path), "other.tex")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", "x", 1.0), ("s2", "y", 2.0)], "sample_id string, metric_e_t string, v double")
    scores = spark.createDataFrame([("s1", 0.123456789)], "sample_id string, e double")
    sinks.enriched_csv(df, scores, "sample_id", "t", {"e": "e"}, str(tmp_path / "csv"))
    got = {r.sample_id: r.metric_e_t for r in readers.wide_csv(spark, str(tmp_path / "csv")).collect()}
    assert got == {"s1": "0.123457", "s2": None}
    sinks.split_skips(df, F.when(F.col("v") > 1, "limit"), str(tmp_path / "ok"), str(tmp_path / "skip"), 0.5)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == spark.read.parquet(str(tmp_path / "skip")).count() == 1
    sinks.nested_json(df.withColumn("scale", F.lit(1.0)), "scale", "sample_id", ["v"], str(tmp_path / "json"))
    nested = spark.read.json(str(tmp_path / "json")).collect()[0]
    assert nested.aggregate.v == 1.5 and [p.v for p in nested.per_prompt] == [1.0, 2.0]
    assert [r.line for r in sinks.latex_rows(df.orderBy("sample_id"), ["sample_id", "v"], 1).collect()] == [r"s1 & 1.0 \\", r"s2 & 2.0 \\"]
    told = []
    sinks.manifest({"b": 1, "a": "é"}, told.append)
    assert json.loads(told[0]) == {"a": "é", "b": 1}
    assert sinks.splice("x<!-- BEGIN n -->old<!-- END n -->y", "n", "new") == "x<!-- BEGIN n -->\nnew\n<!-- END n -->y"
    with pytest.raises(ValueError, match="no markers"):
        sinks.splice("x", "n", "new")


def test_labels(spark):
    at = [0, 25, 26, 51, 52, 701, 702]
    got = [r.x for r in spark.createDataFrame([(i,) for i in at], "i long").select(T.response_label(F.col("i")).alias("x")).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_layouts(spark):
    row = spark.createDataFrame([("p", ["x", "y"])], "p string, r array<string>").select(
        T.instruct_layout(F.col("p"), F.col("r")).alias("a"), T.completion_layout(F.col("p"), F.col("r")).alias("b")
    ).first()
    assert row.a == "p\n\nResponse A: x\n\nResponse B: y" and row.b == "1. p x\n\n2. p y"


def test_utf8_prefix(spark):
    text = "aé€😀z"
    df = spark.createDataFrame([(text, n) for n in range(13)], "t string, n int")
    for r in df.select("n", T.utf8_prefix(F.col("t"), F.col("n")).alias("x")).collect():
        assert r.x == text.encode()[: r.n].decode("utf-8", "ignore")


def test_words_and_forms(spark):
    df = spark.createDataFrame([(" a.b\n c  d. ",), ("",)], "t string")
    got = df.select(T.dot_words(F.col("t")).alias("d"), T.ws_words(F.col("t")).alias("w"), T.ngrams(T.ws_words(F.col("t")), 2).alias("g")).collect()
    assert (got[0].d, got[0].w, got[0].g) == (["ab", "c", "d"], ["a.b", "c", "d."], ["a.b c", "c d."]) and got[1].g == got[1].w == []
    p = spark.createDataFrame([(0.0004,), (0.25,), (float("nan"),), (None,)], "p double").select(T.p_value_text(F.col("p")).alias("x"), T.signed_text(F.col("p"), 1).alias("s")).collect()
    assert [r.x for r in p] == ["<0.001", "0.250", "--", "--"] and p[1].s == "+0.3"


def test_generators(spark):
    assert generators.mode_count(4, 20, 3) == generators.mode_count(4, 20, 3)
    assert len(set(generators.unique_templates(60, 1))) == 60
    with pytest.raises(ValueError, match="modes"):
        generators.mode_count(5, 4, 0)
    assert sorted(generators.scrambled(["a b c d"], 1)[0].split()) == list("abcd")
    assert all(60 <= len(x) <= 100 for x in generators.noise(20, 2)) and len(generators.incoherent_modes(9, 1)) == 9


def test_more_modes_cost_more(spark):
    """What the scores are for: the last response of a set costs more bits per byte the more modes the set has."""
    from polyvox.operators import curves
    from polyvox.plans import scorers

    sets = generators.grid(spark, {"one": lambda s: generators.mode_count(1, 16, s), "many": lambda s: generators.mode_count(12, 16, s)}, 8)
    keys = ["condition", "draw"]
    scored = curves.excess_entropy(scorers.prequential(sets, keys), keys)
    means = {r.condition: r.a for r in scored.groupBy("condition").agg(F.avg("a_n_per_byte").alias("a")).collect()}
    assert means["many"] > means["one"]


def test_command_line(spark, tmp_path):
    from polyvox import __main__ as cli

    rows = [{"scale": s, "prompt_idx": 1, "response_idx": i, "prompt": "p", "response": f"word{i % 2} more"} for s in (0.5, 1.0) for i in range(4)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for permutations in (1, 3):
        cli.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / f"out{permutations}"), permutations)
        out = spark.read.json(str(tmp_path / f"out{permutations}")).collect()
        assert {r.scale for r in out} == {0.5, 1.0} and all(r.aggregate.d_c_an > 0 for r in out)


def test_streaming(spark, tmp_path):
    from polyvox.streaming import incremental

    source = tmp_path / "in"
    source.mkdir()
    schema = "set_id long, k long, response string, at timestamp"
    write = lambda name, rows: (source / name).write_text("\n".join(json.dumps({"set_id": s, "k": k, "response": r, "at": f"2024-01-01T00:00:{k:02d}Z"}) for s, k, r in rows))
    write("a.json", [(1, 1, "x"), (1, 2, "y z"), (1, 2, "y z")])

    def drain():
        stream = incremental.once_per_key(spark.readStream.schema(schema).json(str(source)), ["set_id", "k"], "at", "1 hour")
        incremental.drain(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        return sorted((r.set_id, r.k) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drain() == [(1, 1), (1, 2)]
    write("b.json", [(1, 2, "y z"), (2, 3, "new")])
    assert drain() == [(1, 1), (1, 2), (2, 3)]
    windows = incremental.windowed_lengths(spark.read.schema(schema).json(str(source)), "at", "1 hour", "1 minute").collect()
    assert sum(r.n for r in windows) == 5
