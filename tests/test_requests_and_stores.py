"""Keys of whole requests, answering in batches, recording runs, matrices, file digests and observed inputs."""

import datetime
import functools
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import answering, answers, catalog, commits, inputs, maintenance, records
from tessera.sources.npy import read_npy, write_npy


def _when():
    """The day and the time of a run."""
    return F.lit(datetime.date(2024, 5, 6)), F.lit(datetime.datetime(2024, 5, 6))


def test_whole_requests_are_keyed_as_json(spark):
    r = random.Random(4)
    number = lambda: r.choice([0.1, 1.0, -0.0, 1e16, 1e-7, 2.0**-44, 5e-324, 1.7976931348623157e308, 1e22, 123456789.125, r.random(), r.gauss(0, 1) * 10 ** r.randint(-300, 300)])
    text = lambda: "".join(r.choice(["a", "é", "\n", '"', "\\", "\x00", "\u2028", "😀", "/", "\x7f"]) for _ in range(r.randint(0, 6)))
    rows = []
    for n in range(3000):
        stop = None if r.random() < 0.1 else [text() for _ in range(r.randint(0, 3))]
        rows.append((n, text(), (number(), r.choice([None, 1, -(2**62)]), stop, r.random() < 0.5, [number() for _ in range(r.randint(0, 3))]), {text() or "k": number() for _ in range(r.randint(0, 3))}))
    schema = "n int, prompt string, sampling struct<temperature: double, max_tokens: long, stop: array<string>, stream: boolean, bias: array<double>>, more map<string, double>"
    df = spark.createDataFrame(rows, schema)
    got = {x.n: (x.j, x.k) for x in df.select("n", answers.canonical_json(F.struct("prompt", "sampling", "more")).alias("j"), answers.whole_request_key({"prompt": F.col("prompt"), "sampling": F.col("sampling"), "more": F.col("more")}).alias("k")).collect()}
    for n, prompt, s, more in rows:
        want = json.dumps({"prompt": prompt, "sampling": dict(zip(("temperature", "max_tokens", "stop", "stream", "bias"), s, strict=True)), "more": more}, sort_keys=True, separators=(",", ":"))
        assert got[n] == (want, hashlib.sha256(want.encode()).hexdigest())
    loose = spark.createDataFrame([('{"b": [1, 2.50, {"z": null, "a": 1e3}], "a": "x"}',)], "t string").select(answers.canonical_json(F.parse_json("t")).alias("j")).first().j
    assert json.loads(loose) == {"a": "x", "b": [1, 2.5, {"a": 1000, "z": None}]} and loose.startswith('{"a":"x","b":[1,2.5,{"a":')


def _requests(spark, questions, count=True, k=2):
    corpus = spark.createDataFrame([(1, "ac-1", "AC-1", "one", [1.0, 0.0]), (2, "ac-2", "AC-2", "two", [0.0, 1.0]), (3, "ac-1", "AC-1", "three", [0.9, 0.1])], "chunk_id int, control_id string, label string, text string, embedding array<double>")
    encode = lambda q: q.withColumn("q", F.when(F.col("question").contains("two"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    model = answering.Model("m", "1", F.struct(F.lit(0.25).alias("temperature"), F.lit(9).alias("max_tokens")))
    return answering.requests(spark.createDataFrame(questions, "q_id string, question string"), corpus, encode, model, "answer", "Say.", k, (lambda p: p.withColumn("tokens", F.length("prompt"))) if count else None)


def test_answering_in_one_batch(spark):
    asked = _requests(spark, [("a", "about one"), ("b", "about two"), ("c", "about one")])
    rows = {r.q_id: r for r in asked.collect()}
    prompt = "Say.\n\n[AC-1]\none\n\n[AC-1]\nthree\n\nQuestion: about one"
    key = hashlib.sha256(json.dumps({"purpose": "answer", "model": "m", "model_version": "1", "prompt": prompt, "sampling": {"temperature": 0.25, "max_tokens": 9}}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert (rows["a"].prompt, rows["a"].key, rows["a"].control_ids, rows["a"].counted_prompt_tokens) == (prompt, key, ["ac-1", "ac-1"], len(prompt)) and rows["c"].key == key
    assert {r.counted_prompt_tokens for r in _requests(spark, [("a", "x")], count=False).collect()} == {None}
    recordings = spark.createDataFrame([(key, ["See [AC-1],", "[ac-2] and [ZZ-9]; again [AC-01]."])], "key string, answer_lines array<string>")
    controls = spark.createDataFrame([("ac-1",), ("ac-2",)], "id string")
    out, seen = answering.observed(answering.answer_all(asked, recordings, controls))
    got = {r.q_id: r for r in out.collect()}
    assert [(c.cited_as, c.canonical, c.exists, c.retrieved, c.valid) for c in got["a"].citations] == [("AC-1", "ac-1", True, True, True), ("ac-2", "ac-2", True, False, False), ("ZZ-9", "zz-9", False, False, False)]
    assert (got["a"].invalid, got["a"].n_citations, got["b"].answered, got["b"].decline, got["b"].citations, got["b"].invalid) == (2, 3, False, "no recorded answer", [], 0)
    assert seen.get == {"questions": 3, "answered": 2, "declined": 1, "citations": 6, "invalid": 4, "prompt_tokens": sum(r.counted_prompt_tokens for r in got.values())}
    entries = spark.createDataFrame([("e", "i", "d", ["corpus"])], "name string, identity string, digest string, invalidates array<string>")
    with pytest.raises(ValueError, match="e: digest"):
        answering.answer_all(asked, recordings, controls, (entries, spark.createDataFrame([("e", "i", "other")], "name string, identity string, digest string")))
    with pytest.raises(Exception, match="a question's id twice"):
        _requests(spark, [("a", "x"), ("a", "y")]).collect()


def test_a_recording_run_asks_for_each_key_once(spark, tmp_path):
    root, log = str(tmp_path / "r"), tmp_path / "asked"
    log.mkdir()

    def client(fail):
        def load():
            def complete(key, prompt):
                if "two" in prompt.split("Question")[1] and fail and len(list(log.glob("*"))) >= 1:
                    raise RuntimeError("the provider is down")
                n = len(list(log.glob(f"{key}*")))
                (log / f"{key}-{n}").write_text(prompt)
                return f"said {key}\nand more", "m", "1.1", 10, 2

            return complete

        return load

    questions = [("a", "about one"), ("b", "about two"), ("c", "about one")]
    asked = _requests(spark, questions).coalesce(1).sortWithinPartitions("q_id")
    with pytest.raises(Exception, match="provider is down"):
        answering.record_generations(asked, root, client(True), "generation", *_when())
    assert commits.entry(spark, f"{root}/recordings") is None
    done = answering.record_generations(asked, root, client(False), "generation", *_when())
    assert done == {"recorded": 3, "skipped": 0, "orphans": 0, "prompt_tokens": 20, "completion_tokens": 4}
    assert len(list(log.glob("*"))) == 2  # what the failed run was told isn't asked for again
    held = {r.key: r for r in answering.recorded(spark, root).collect()}
    first = next(r for r in held.values() if r.question == "about one")
    assert first.answer_lines == [f"said {first.key}", "and more"] and (first.purpose, first.model_version, first.control_ids) == ("generation", "1.1", ["ac-1", "ac-1"]) and answering.recorded(spark, root).columns == [x.split()[0] for x in records.RECORDING.split(", ")]
    again = answering.record_generations(asked, root, client(False), "generation", *_when())
    assert again == {"recorded": 0, "skipped": 3, "orphans": 0, "prompt_tokens": 0, "completion_tokens": 0} and len(list(log.glob("*"))) == 2
    fewer = answering.record_generations(_requests(spark, questions[:1]), root, client(False), "generation", *_when(), force=True)
    assert (fewer["recorded"], fewer["skipped"], fewer["orphans"]) == (1, 0, 1) and len(list(log.glob("*"))) == 3
    assert answering.answer_all(asked, answering.recorded(spark, root), spark.createDataFrame([("ac-1",)], "id string")).filter("answered").count() == 3


def test_calls_are_never_replaced(tmp_path):
    calls = answering.Calls(str(tmp_path / "calls"))
    assert calls.get("k") is None and calls.put("k", ["one"]) == ["one"] == calls.put("k", ["two"]) == calls.get("k")
    assert [p.name for p in (tmp_path / "calls").iterdir()] == ["k.json"]


def test_log_lines(spark):
    rows = spark.createDataFrame([("1", "x", None), ("2", "y", "Boom")], "id string, message string, failed string")
    got = records.log_lines(rows.select("id", "message", "failed"), _when()[1], F.lit("answered"), error=F.col("failed")).orderBy("id").collect()
    assert [(r.level, r.message, r.field_message, r.error, r.stack) for r in got] == [("INFO", "answered", "x", None, None), ("ERROR", "answered", "y", "Boom", None)]


def test_matrices_round_trip(spark, tmp_path):
    r = np.random.default_rng(2)
    x = r.normal(size=(1000, 7)).astype("<f4")
    x[3, 2], x[4, 1], x[5, 0] = np.nan, -0.0, np.inf
    np.save(tmp_path / "one.npy", x)
    df = read_npy(spark, str(tmp_path / "one.npy"), 7 * 4 * 90)
    assert df.rdd.getNumPartitions() == 12
    read = lambda d: np.array([v.vector for v in d.orderBy("row").collect()], dtype="<f4")
    assert read(df).tobytes() == x.tobytes()
    write_npy(df.repartition(5), str(tmp_path / "many"), 7)
    assert read(read_npy(spark, str(tmp_path / "many"))).tobytes() == x.tobytes()
    assert b"".join(np.load(tmp_path / "many" / s["file"]).tobytes() for s in json.loads((tmp_path / "many" / "_index.json").read_text())["shards"]) == x.tobytes()
    for bad, match in ((df.filter("row <> 7"), "rows don't run on"), (df.withColumn("vector", F.expr("if(row = 9, slice(vector, 1, 2), vector)")), "isn't of 7 numbers")):
        with pytest.raises(Exception, match=match):
            write_npy(bad, str(tmp_path / "bad"), 7)
        with pytest.raises(Exception, match="no vectors"):
            read_npy(spark, str(tmp_path / "bad")).collect()
    np.save(tmp_path / "none.npy", x[:0])
    assert read_npy(spark, str(tmp_path / "none.npy")).count() == 0


def test_query_stores_refused(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(3, 2)
    good = {"embedder_name": "m", "embedder_revision": "r", "dimensions": 2, "recorded_on": "2024-01-01", "queries": [{"question": q, "row": n} for n, q in enumerate("abc")]}

    def store(index=good, array=x, raw=None):
        folder = tmp_path / f"s{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        if index is not None:
            (folder / "index.json").write_text(index if isinstance(index, str) else json.dumps(index))
        if raw is not None:
            (folder / "vectors.npy").write_bytes(raw)
        elif array is not None:
            np.save(folder / "vectors.npy", array)
        return records.read_query_store(spark, str(folder), "m", "r", 2).orderBy("row").collect()

    assert [(v.question, v.row, v.embedding) for v in store()] == [("a", 0, [0, 1]), ("b", 1, [2, 3]), ("c", 2, [4, 5])]
    queries = lambda *pairs: {**good, "queries": [{"question": q, "row": n} for q, n in pairs]}
    for bad, match in (
        (dict(index=None), "no recorded query vectors"), (dict(array=None), "no vectors at"), (dict(index="{"), "not an index"), (dict(index={**good, "queries": [{"question": "a"}]}), "not an index"), (dict(index={**good, "embedder_name": "n"}), "recorded with embedder_name"),
        (dict(index={**good, "embedder_revision": "q"}), "recorded with embedder_revision"), (dict(index={**good, "dimensions": 3}, array=np.zeros((3, 3), "<f4")), "recorded with dimensions"), (dict(raw=b"not numpy"), "isn't a readable array"), (dict(raw=b"\x93NUMPY\x01\x00v\x00{"), "isn't a readable array"),
        (dict(array=x.astype("<f8")), "not float32"), (dict(array=x[:2]), "an array of 2 by 2"), (dict(array=np.zeros((3, 3), "<f4")), "an array of 3 by 3"), (dict(index=queries(("a", 0), ("b", 0), ("c", 2))), "a row twice"), (dict(index=queries(("a", 0), ("b", 1), ("c", 3))), "(rows with gaps|another width)"),
        (dict(index=queries(("a", 0), ("a", 1), ("c", 2))), "a question twice"),
    ):
        with pytest.raises(Exception, match=match):
            store(**bad)
    asked = spark.createDataFrame([("b", [2.0, 3.0]), ("a", [0.0, 1.0]), ("c", [4.0, 5.0])], "question string, embedding array<float>")
    records.write_query_store(asked, str(tmp_path / "w"), good)
    assert [(v.question, v.row, v.embedding) for v in records.read_query_store(spark, str(tmp_path / "w"), "m", "r", 2).orderBy("row").collect()] == [("a", 0, [0, 1]), ("b", 1, [2, 3]), ("c", 2, [4, 5])]


def test_files_of_any_size_are_digested(spark, tmp_path):
    (tmp_path / "d").mkdir()
    with (tmp_path / "d" / "big file%20").open("wb") as f:
        f.write(b"head")
        f.truncate((2 << 30) + 5)  # over what a row can hold
    (tmp_path / "d" / "small").write_bytes(b"x")
    want = hashlib.sha256(b"head")
    for at in range(4, (2 << 30) + 5, 64 << 20):
        want.update(bytes(min(64 << 20, (2 << 30) + 5 - at)))
    got = {r.size: r.sha256 for r in sources.file_digests(spark, str(tmp_path / "d")).collect()}
    assert got == {(2 << 30) + 5: want.hexdigest(), 1: hashlib.sha256(b"x").hexdigest()}


def _document(prose="Do {{ insert: param, p }}.", value="x"):
    control = {"id": "ac-1", "title": "T", "props": [{"name": "label", "value": "AC-1"}, {"name": "label", "class": "zero-padded", "value": "AC-01"}, {"name": "sort-id", "value": "ac-01"}], "params": [{"id": "p", "values": [value]}], "parts": [{"name": "statement", "prose": prose}, {"name": "assessment", "prose": "look at it"}]}
    return {"catalog": {"uuid": "u", "metadata": {"title": "t", "version": "1", "last-modified": "m", "oscal-version": "1"}, "groups": [{"id": "g", "title": "G", "controls": [control]}]}}


def test_each_change_moves_its_own_entry(spark, monkeypatch):
    digests = functools.cache(inputs.catalog_digests)  # a document's tables are digested once
    monkeypatch.setattr(inputs, "catalog_digests", digests)

    @functools.cache
    def tables_of(text):
        return catalog.catalog_tables(spark.createDataFrame([(0, text)], "root long, document string"))

    def seen(document=None, **changed):
        tables = tables_of(json.dumps(document or _document()))
        pins = {"release": {"release": "r1", "sha256": "s"}, "resolution_version": "1", "chunker_version": "1", "embedder": {"name": "m", "revision": "abcdefghij"}, "template_version": "1", "template": "t", "tokenizer": {"encoding": "e", "n": 1}}
        return inputs.corpus_inputs(tables, **{**pins, **changed})

    first = seen()
    was = {r.name: r for r in inputs.observe(spark, first).collect()}
    assert was["judge_prompt"].digest is None and was["embedder"].identity == "m @ abcdefgh" and len(was) == 7
    entries = inputs.manifest_of(spark, first, maintenance.COSTS).cache()
    assert {r.name: r.invalidates for r in entries.collect()}["catalog"] == ["corpus", "generation", "counts"]
    spoken, unspoken = _document(value="y"), _document()
    unspoken["catalog"]["groups"][0]["controls"][0]["parts"][1]["prose"] = "look again"
    for now, moved in (
        (seen(release={"release": "r1", "sha256": "other"}), {"catalog": "digest"}), (seen(resolution_version="2"), {"parameter_resolution": "identity"}), (seen(chunker_version="2"), {"chunker": "identity"}),
        (seen(embedder={"name": "m", "revision": "abcdefghzz"}), {"embedder": "digest"}), (seen(template="u"), {"prompt_template": "digest"}), (seen(tokenizer={"encoding": "e", "n": 2}), {"tokenizer": "digest"}), (seen(judge="j"), {"judge_prompt": "appeared"}),
        (seen(spoken), {"parameter_resolution": "digest", "chunker": "digest"}), (seen(unspoken), {"parameter_resolution": "digest"}), (seen(), {}),
    ):
        assert {r.name: r.state for r in maintenance.compare_manifest(entries, inputs.observe(spark, now)).collect()} == moved
    for bad, match in (({"a": inputs.Input(None, None, ("b",)), "b": inputs.Input(None, None, ("a",))}, "feeds itself"), ({"a": inputs.Input(None, None, ("z",))}, "isn't known")):
        with pytest.raises(ValueError, match=match):
            inputs.invalidated(bad, maintenance.COSTS)
