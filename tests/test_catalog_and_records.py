"""Catalogs, chunks, ingest, recordings, recorded vectors, manifests and digests: what is refused, and results by plain Python."""

import datetime
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers, catalog, commits, encoders, maintenance, records, search


def catalog_of(controls, **top):
    about = {"title": "t", "version": "1", "last-modified": "d", "oscal-version": "o"}
    return {"catalog": {"uuid": "u", "metadata": about, "groups": [{"id": "g", "title": "G", "controls": controls}], **top}}


def control(name, parts=(), **more):
    label = name.upper()
    props = [{"name": "label", "class": "zero-padded", "value": "0" + label}, {"name": "label", "value": label}, {"name": "label", "value": "later"}, {"name": "sort-id", "value": "s-" + name}]
    return {"id": name, "title": "Title of " + name, "props": props + more.pop("props", []), "parts": list(parts), **more}


def tables(spark, *documents):
    rows = [(n, json.dumps(d)) for n, d in enumerate(documents)]
    return catalog.catalog_tables(spark.createDataFrame(rows, "root long, document string").select("root", F.parse_json("document").alias("document")))


def test_catalog_walk(spark):
    deep = control("ab-1.1.1", props=[{"name": "status", "value": 3}])
    inner = control("ab-1.1", controls=[deep], props=[{"name": "status", "value": "withdrawn"}])
    params = [{"id": "p1", "values": ["v", 2]}, {"id": "p2", "select": {"choice": ["a", "b"]}, "label": 7}, {"id": "p3", "select": "odd", "guidelines": [{"prose": ""}, "x", {"prose": " ; "}, {"prose": "say; "}], "props": [{"name": "alt-identifier", "value": "q"}]}]
    parts = [{"name": "guidance", "prose": "g", "parts": "odd"}, {"id": "ab-1_smt", "name": "statement", "parts": [{"name": "item", "prose": "x", "props": [{"name": "label", "value": "a."}], "parts": [{"name": "item", "prose": "y"}]}]}]
    t = tables(spark, catalog_of([control("ab-1", parts, params=params, controls=[inner])]), catalog_of([control("ab-1")]))
    rows = {(r.root, r.id): r for r in t.controls.collect()}
    assert [(r.base_id, r.is_enhancement, r.withdrawn) for r in (rows[0, "ab-1"], rows[0, "ab-1.1"], rows[0, "ab-1.1.1"])] == [("ab-1", False, False), ("ab-1", True, True), ("ab-1.1", True, False)]
    assert (rows[0, "ab-1"].label, rows[0, "ab-1"].padded_label, rows[0, "ab-1"].sort_id) == ("AB-1", "0AB-1", "s-ab-1")
    assert [(r.name, r.depth, r.top_name, r.prose, r.label) for r in t.parts.orderBy("root", "path").collect()] == [("guidance", 0, "guidance", "g", None), ("statement", 0, "statement", None, None), ("item", 1, "statement", "x", "a."), ("item", 2, "statement", "y", None)]
    got = {r.param: (r.label, r["values"], r.how_many, r.choices, r.guidelines, r.alt_identifier) for r in t.parameters.collect()}
    assert got == {"p1": (None, ["v", "2"], None, None, [], None), "p2": (None, [], "one", ["a", "b"], [], None), "p3": (None, [], None, None, [" ; ", "say; "], "q")}
    shown = {r.param: r.rendered for r in catalog.rendered(t.parameters).collect()}
    assert shown == {"p1": "v, 2", "p2": "[selection (one): a; b]", "p3": "[organization-defined say]"}


@pytest.mark.parametrize(("document", "message"), [
    ({"profile": 1}, "no top-level catalog"), (catalog_of([], groups=[]), "without groups"), (catalog_of([], uuid=""), "has no uuid"), (catalog_of([], metadata={"title": "t"}), "has no version"), (catalog_of([{"id": "a"}]), "has no title"),
    (catalog_of([control("a", [{"id": "x"}])]), "has no name"), (catalog_of(["x"]), "isn't an object"), (catalog_of([control("a"), control("a")]), "a control twice"),
    (catalog_of([control("a", params=[{"id": "p"}]), control("b", params=[{"id": "p"}])]), "a parameter twice"),
])
def test_catalogs_refused(spark, document, message):
    with pytest.raises(Exception, match=message):
        t = tables(spark, document)
        for df in (t.metadata, t.groups, t.controls, t.parts, t.parameters):
            df.collect()


def test_chunks(spark):
    parts = [{"name": "guidance", "prose": "why {{ insert: param, p }} ."}, {"name": "guidance", "prose": " "}, {"name": "assessment", "prose": "no"}, {"id": "ab-1_smt", "name": "statement", "prose": "do", "parts": [{"name": "item", "props": [{"name": "label", "value": "(a)"}], "prose": "one  two"}, {"name": "item", "prose": ""}]}]
    gone = control("ab-2", props=[{"name": "status", "value": "withdrawn"}])
    t = tables(spark, catalog_of([control("ab-1", parts, params=[{"id": "p", "values": ["this"]}], controls=[gone])]))
    (row,) = catalog.chunk_catalog(t).collect()
    assert (row.chunk_id, row.part_path, row.base_control_id) == ("ab-1:smt+guidance+guidance", "smt+guidance+guidance", "ab-1")
    assert row.text == "AB-1 Title of ab-1\n\nControl:\ndo\n(a) one two\n\nDiscussion:\nwhy this.\n\nDiscussion:"
    with pytest.raises(Exception, match="no statement or guidance"):
        catalog.chunk_catalog(tables(spark, catalog_of([control("ab-1", [{"name": "assessment", "prose": "x"}])]))).collect()
    bare = {"id": "ab-9", "title": "t", "parts": [{"name": "statement", "prose": "x"}]}
    with pytest.raises(Exception, match="not all published forms"):
        catalog.chunk_catalog(tables(spark, catalog_of([bare]))).collect()


def test_repeated_keys_fail(spark):
    two = spark.createDataFrame([("ac-2",), ("ac-2",)], "id string")
    with pytest.raises(Exception, match="a control twice"):
        catalog.resolve(spark.createDataFrame([("AC-2",)], "text string"), two).collect()
    with pytest.raises(Exception, match="a parameter twice"):
        catalog.resolve_markers(spark.createDataFrame([(1, "a {{ insert: param, p }} b")], "id int, text string"), spark.createDataFrame([("p", "X"), ("p", "Y")], "param string, rendered string")).collect()
    with pytest.raises(Exception, match="repeated: k"):
        answers.replay(spark.createDataFrame([("k",)], "key string"), spark.createDataFrame([("k", ["a"]), ("k", ["b"])], "key string, answer_lines array<string>")).collect()
    with pytest.raises(Exception, match="not recorded: z"):
        answers.replay_all(spark.createDataFrame([("z",)], "key string"), spark.createDataFrame([("k", ["a"])], "key string, answer_lines array<string>")).collect()
    one = spark.createDataFrame([("ac-2",)], "id string")
    with pytest.raises(Exception, match="no such control"):
        catalog.required_controls(spark.createDataFrame([("zz-9",)], "text string"), one).collect()


def test_guards_of_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [r.vec_id for r in search.top_k(v, q, 5).collect()] == [1, 4]
    with pytest.raises(Exception, match="a vector of width 1, not 2"):
        search.top_k(v.unionByName(spark.createDataFrame([(3, [1.0])], v.schema)), q, 5).collect()
    with pytest.raises(ValueError, match="the corpus is empty"):
        search.top_k(v.filter("vec_id = 2"), q, 5, refuse_empty=True)
    assert search.top_k(v.limit(0), q, 5).count() == 0
    for blank in (None, "", " \t\n"):
        with pytest.raises(ValueError, match="blank"):
            search.asked_question(blank)
    assert search.asked_question(" x ") == " x "


@pytest.mark.parametrize(("text", "wanted"), [("AC-2. 3", "ac-2.3"), ("ac-2 . 14", "ac-2.14"), ("Ac 02 ( 03 )", "ac-2.3"), ("ac-2. ", None), ("ac-2(3", None), ("see AC-2", None)])
def test_identifiers(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.canonical_id(F.col("t"))).first()[0] == wanted


@pytest.mark.parametrize(("text", "wanted"), [("x" * 300, "..."), ("ab " * 100, ("ab " * 79).strip() + " ..."), ("y" * 200 + " " + "z" * 100, "y" * 200 + " ..."), ("w" * 240, "w" * 240), (" a \n b ", "a b")])
def test_preview_by_hand(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.preview(F.col("t"))).first()[0] == wanted


FROM = {"name": "m", "revision": "r", "dimensions": 2, "chunker_version": "1", "chunker_digest": "c", "resolution_version": "1", "catalog_sha256": "s"}


def test_ingest(spark, tmp_path):
    root = str(tmp_path / "corpus")
    at = lambda day: F.lit(datetime.datetime(2024, 1, day))
    chunks = lambda *ids: spark.createDataFrame([(i, "text " + i) for i in ids], "chunk_id string, text string")
    vectors = lambda *ids: spark.createDataFrame([(i, [1.0, float(n)]) for n, i in enumerate(ids)], "chunk_id string, embedding array<float>")
    assert maintenance.read_provenance(spark, root) is None
    first = maintenance.ingest(chunks("b", "a"), vectors("a", "b"), root, FROM, at(1)).first()
    body = {i: hashlib.sha256(i.encode() + b"\x1f" + struct.pack("<2f", 1.0, n) + b"\x1e").hexdigest() for n, i in enumerate("ab")}
    bucket = {r.chunk_id: r.b for r in chunks("a", "b").selectExpr("chunk_id", "pmod(xxhash64(chunk_id), 64) b").collect()}
    digest = hashlib.sha256("".join(f"{bucket[i]}\x1f{body[i]}\x1e" for i in sorted("ab", key=bucket.get)).encode()).hexdigest()
    assert (first.written, first.deleted, first.vector_bytes, first.corpus_digest, first.previous_digest) == (2, 0, 16, digest, None)
    again = maintenance.ingest(chunks("b", "c"), vectors("b", "c"), root, FROM, at(2)).first()
    assert (again.written, again.deleted, again.previous_digest) == (2, 1, digest)
    assert {r.chunk_id: r.created_at.day for r in maintenance.corpus_of(spark, root).collect()} == {"b": 1, "c": 2}
    found = maintenance.read_provenance(spark, root)
    assert (found.name, found.dimensions, found.chunks, found.corpus_digest) == ("m", 2, 2, again.corpus_digest)
    for bad, message in ((lambda: maintenance.ingest(chunks(), vectors(), root, FROM, at(3)), "no chunks"), (lambda: maintenance.ingest(chunks("a", "b"), vectors("a"), root, FROM, at(3)), "no vector for b"),
                         (lambda: maintenance.ingest(chunks("a", "a"), vectors("a"), root, FROM, at(3)), "a chunk twice"), (lambda: maintenance.ingest(chunks("a"), vectors("a"), root, FROM | {"dimensions": 3}, at(3)), "of width 2"),
                         (lambda: maintenance.ingest(chunks("a"), vectors("a"), root, {"dimensions": 2}, at(3)), "lacks")):
        with pytest.raises(Exception, match=message):
            bad()
    assert maintenance.read_provenance(spark, root).corpus_digest == again.corpus_digest and {r.chunk_id for r in maintenance.corpus_of(spark, root).collect()} == {"b", "c"}


CALL = {"key": "k1", "purpose": "generation", "question": "q", "control_ids": ["a", "a"], "model": "m", "model_version": "v", "recorded_on": "2024-05-06", "usage_prompt_tokens": 3, "usage_completion_tokens": 4, "counted_prompt_tokens": 5, "answer_lines": ["one", "", "two"]}


def test_recordings(spark, tmp_path):
    (tmp_path / "k1").mkdir()
    (tmp_path / "k1" / "k1.json").write_text(json.dumps(CALL))
    row = records.read_recordings(spark, str(tmp_path / "k1"), "generation").first()
    assert (row.key, row.recorded_on, row.answer_lines, row.control_ids) == ("k1", datetime.date(2024, 5, 6), ["one", "", "two"], ["a", "a"])
    records.write_recordings(records.read_recordings(spark, str(tmp_path / "k1")), str(tmp_path / "table"))
    assert records.recorded_calls(spark, str(tmp_path / "table")).first().asDict() == row.asDict()
    with pytest.raises(Exception, match="of another purpose"):
        records.read_recordings(spark, str(tmp_path / "k1"), "judge").collect()
    for name, text, message in (("k2", json.dumps(CALL), "filed under another name"), ("k3", json.dumps({**CALL, "key": "k3", "more": 1}), "not a recording"), ("k4", "{", "not a recording"), ("k5", json.dumps({"key": "k5"}), "not a recording")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match=message):
            records.read_recordings(spark, str(folder)).collect()


def test_questions(spark):
    read = lambda *q: records.read_questions(spark.createDataFrame([(json.dumps({"_comment": "x", "version": 1, "questions": list(q)}),)], "j string").select(F.parse_json("j").alias("document")), ["direct", "none"])
    one = {"id": "a", "class": "direct", "text": "why?", "because": "so"}
    got = read(one, {**one, "id": "b", "text": "how?", "class": "none"})
    assert [r.id for r in records.questions_of(got, "none").collect()] == ["b"]
    for bad, message in (([one, {**one, "text": "x"}], "an id twice"), ([one, {**one, "id": "b"}], "a question twice"), ([{**one, "class": "odd"}], "no such class"), ([{"id": "a", "class": "direct", "text": "t"}], "without because")):
        with pytest.raises(Exception, match=message):
            read(*bad).collect()


def test_query_vectors(spark):
    rows = [("zeta", [1.0, 2.0]), ("Zeta", [3.0, 4.0]), ("éta", [5.0, 6.0]), ("", [7.0, 8.0]), ("zeta ", [9.0, 1.0])]
    df = spark.createDataFrame(rows, "question string, embedding array<double>")
    stored = records.query_vectors(df, 2)
    assert {r.question: r.row for r in stored.collect()} == {q: n for n, (q, _) in enumerate(sorted(rows))}
    index = {"embedder_name": "m", "embedder_revision": "r", "dimensions": 2}
    good = records.checked_query_vectors(stored, index, "m", "r", 2)
    assert good.count() == 5
    for bad, message in ((lambda: records.query_vectors(df.union(df.limit(1)), 2), "a question twice"), (lambda: records.query_vectors(df, 3), "no vector of the width"), (lambda: records.checked_query_vectors(stored, {**index, "embedder_name": "x"}, "m", "r", 2), "recorded with embedder_name"),
                         (lambda: records.checked_query_vectors(stored.filter("row <> 2"), index, "m", "r", 2), "rows with gaps"), (lambda: records.checked_query_vectors(stored, {**index, "dimensions": 3}, "m", "r", 3), "another width"),
                         (lambda: records.checked_query_vectors(stored.withColumn("row", F.lit(0).cast("long")), index, "m", "r", 2), "a row twice"), (lambda: records.checked_query_vectors(df.withColumn("row", F.lit(0)), index, "m", "r", 2), "aren't float32")):
        with pytest.raises(Exception, match=message):
            bad().collect()
    asked = spark.createDataFrame([("zeta",), ("new",)], "question string")
    got = {r.question: (r.recorded, r.embedding) for r in records.encoded(asked, good, lambda rest: rest.withColumn("embedding", F.array(F.lit(0.5), F.lit(0.5)))).collect()}
    assert got == {"zeta": (True, [1.0, 2.0]), "new": (False, [0.5, 0.5])}
    assert records.vectors_are_recorded(df.select("question"), stored) and not records.vectors_are_recorded(asked, stored)


def test_report_log_and_lines(spark, tmp_path):
    wanted = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, key string")
    was, done = spark.createDataFrame([("a",), ("z",)], "key string"), spark.createDataFrame([("b", 5, 1), ("c", 7, 2)], "key string, usage_prompt_tokens int, usage_completion_tokens int")
    assert tuple(records.recording_report(wanted, was, done).first()) == (2, 1, 1, 12, 3)
    assert records.recording_report(wanted, was, done, force=True).first().skipped == 0
    assert sorted(r.key for r in records.to_record(wanted, was).collect()) == ["b", "c"] and records.to_record(wanted, was, force=True).count() == 3
    log = records.answer_log(spark.createDataFrame([("1", True, 2, 1)], "id string, answered boolean, citations int, invalid int"), F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5)), F.lit(0.12345)).first()
    assert (log["at"], log.ms) == ("2024-01-02T03:04:05.000Z", 123.5)
    records.write_json_lines(spark.createDataFrame([("é", 1)], "b string, a int"), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ['{"a":1,"b":"é"}']
    ranked = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 3, "x")], "q_id int, rank int, control_id string")
    assert records.retrieved_ids(ranked).first().ids == ["y", "x", "x"]
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert maintenance.stored_bytes(spark, str(tmp_path / "t")).first()["bytes"] > 0


def test_manifest(spark):
    parse = lambda entries: spark.createDataFrame([(json.dumps({"entries": entries}),)], "j string").select(F.parse_json("j").alias("document"))
    entry = lambda digest, *kinds: {"identity": "v1", "digest": digest, "invalidates": list(kinds), "covers": "x"}
    all_ = {"b": entry("d", "corpus"), "a": entry("d", "corpus"), "c": entry("d", "corpus", "judge"), "e": entry("d", "counts", "judge", "generation"), "f": entry(None), "same": entry("d", "corpus")}
    entries = maintenance.manifest_entries(parse(all_), list(all_))
    seen = spark.createDataFrame([(n, "v1", "d" if n == "same" else "x") for n in all_], "name string, identity string, digest string")
    assert [r.name for r in maintenance.compare_manifest(entries, seen).collect()] == ["c", "a", "b", "e", "f"]
    with pytest.raises(ValueError, match="c: digest"):
        maintenance.check_manifest(entries, seen)
    maintenance.check_manifest(entries.filter("name = 'same'"), seen)
    for known, given, message in ((["a"], {"a": entry("d"), "z": entry("d")}, "nothing computes: z"), (["a", "y"], {"a": entry("d")}, "without an entry: y"), (["a"], {"a": entry("d", "odd")}, "no such cost: odd")):
        with pytest.raises(Exception, match=message):
            maintenance.manifest_entries(parse(given), known).collect()
    with pytest.raises(Exception, match="not observed: a"):
        maintenance.compare_manifest(entries, seen.filter("name <> 'a'")).collect()


def test_digests(spark):
    rows = [("g", n, f"t{n}" if n % 3 else None) for n in (0, 1, 5, 12, 27)] + [("h", 3, "x")]
    df = spark.createDataFrame(rows, "s string, k long, x string").repartition(3)
    body = lambda some: b"".join(f"{i}\x1f{k}\x1f{x or ''}\x1e".encode() for i, (_, k, x) in enumerate(some))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    of = lambda s: [r for r in rows if r[0] == s]
    assert {r.s: r.digest for r in maintenance.ordered_digest(df, ["k"], ["k", "x"], "s").collect()} == {s: sha(body(of(s))) for s in "gh"}
    cut = lambda s: {n: [r for r in of(s) if r[1] // 10 == n] for n in sorted({r[1] // 10 for r in of(s)})}
    want = {s: (len(cut(s)), sha("".join(f"\x1f{n}\x1f{sha(body(some))}\x1e" for n, some in cut(s).items()).encode())) for s in "gh"}
    assert {r.s: (r.ranges, r.digest) for r in maintenance.ranged_digest(df, "k", ["k", "x"], "s", 10).collect()} == want
    assert spark.range(1).select(T.multi_digest(F.lit("a"), F.lit(None))).first()[0] == sha(b"a\x1e\x1e")
    assert maintenance.schema_health(spark.createDataFrame([], "version int"), 3).first().applied is None


def test_retrieve_count_and_look_up(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], "chunk_id string, text string, embedding array<float>")
    got = search.retrieve(corpus, "why?", lambda _: [0.0, 2.0], 2, k=5).orderBy("rank").collect()
    assert [(r.chunk_id, r.text, r["rank"], r.k, r.question) for r in got] == [("b", "y", 1, 5, "why?"), ("a", "x", 2, 5, "why?")] and got[0].score == pytest.approx(1.0)
    for bad, message in ((lambda: search.retrieve(corpus, " ", lambda _: [0.0], 2, k=0), "at least 1"), (lambda: search.retrieve(corpus, " ", lambda _: [0.0], 2), "blank"), (lambda: search.retrieve(corpus, "q", lambda _: [0.0], 2), "of width 1"), (lambda: search.retrieve(corpus.limit(0), "q", lambda _: [0.0, 1.0], 2), "empty")):
        with pytest.raises(ValueError, match=message):
            bad()
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    assert {r.id: r.tokens for r in encoders.counted(texts, "text", lambda: lambda some: [len(t.split()) for t in some]).collect()} == {1: 2, 2: 0}
    with pytest.raises(Exception, match="the counter gave"):
        encoders.counted(texts, "text", lambda: lambda some: [1, 2, 3]).collect()
    controls = spark.createDataFrame([("ac-2",)], "id string")
    assert {r.id: r.known for r in catalog.known_controls(spark.createDataFrame([("ac-2",), ("AC-2",), (None,)], "id string"), controls).collect()} == {"ac-2": True, "AC-2": False, None: False}
    assert catalog.checked_count(controls, 1).count() == 1
    with pytest.raises(ValueError, match="1 chunks, not 2"):
        catalog.checked_count(controls, 2)
    asked, index, root = spark.createDataFrame([("b",), ("a",)], "question string"), {"embedder_name": "m", "embedder_revision": "r", "dimensions": 1}, str(tmp_path / "q")
    encode = lambda df: df.withColumn("embedding", F.array(F.length("question").cast("float")))
    assert [records.record_query_vectors(asked, encode, root, index), records.record_query_vectors(asked, encode, root, index)] == [True, False]
    assert records.record_query_vectors(asked, encode, root, index, force=True) and records.record_query_vectors(asked.limit(1), encode, root, index) and records.record_query_vectors(asked.limit(1), encode, root, {**index, "embedder_revision": "s"})


# ---- a catalog's walk, parameters and index at their edges


def _doc(*controls, parts=()):
    return {"catalog": {"uuid": "u", "metadata": {"title": "t", "version": "1", "last-modified": "m", "oscal-version": "1"}, "groups": [{"id": "g", "title": "G", "parts": list(parts), "controls": list(controls)}]}}


def _control(id_="ac-1", label="AC-1", padded="AC-01", sort_id="ac-01", status=None, **more):
    props = [{"name": "label", "value": label}, {"name": "label", "class": "zero-padded", "value": padded}, {"name": "sort-id", "value": sort_id}, *([{"name": "status", "value": status}] if status else [])]
    return {"id": id_, "title": "T", "props": [p for p in props if p["value"]], "parts": [{"name": "statement", "prose": "Do it."}], **more}


def _tables(spark, *documents):
    return catalog.catalog_tables(spark.createDataFrame([(n, json.dumps(x)) for n, x in enumerate(documents)], "root long, document string"))


def test_parts_of_groups_and_one_walk(spark):
    t = _tables(spark, _doc(_control(), parts=[{"id": "g_ovw", "name": "overview", "prose": "All.", "parts": [{"name": "item"}]}]))
    assert [(r.control_id, r.name, r.depth, r.prose) for r in t.parts.orderBy("path").collect()] == [("ac-1", "statement", 0, "Do it."), (None, "overview", 0, "All."), (None, "item", 1, None)]
    assert catalog.chunk_catalog(t).select("text").collect()[0].text == "AC-1 T\n\nControl:\nDo it."
    for df in (t.controls, t.parts, catalog.chunk_catalog(t), catalog.resolution_digest(t)):
        assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
    for bad in (_doc(_control(), parts=[{"id": "x"}]), _doc(_control(), parts=["x"])):
        with pytest.raises(Exception, match="a part (has no name|isn't an object)"):
            _tables(spark, bad)
    with pytest.raises(ValueError, match="two documents are 0"):
        catalog.catalog_tables(spark.createDataFrame([(0, json.dumps(_doc(_control())))] * 2, "root long, document string"))


def _shown(spark, *params):
    t = _tables(spark, _doc(_control(params=list(params))))
    return {r.param: r.rendered for r in catalog.rendered(t.parameters).collect()}


def test_choices_and_guidelines_are_resolved_and_then_stripped(spark):
    m = lambda x: "{{ insert: param, " + x + " }}"
    got = _shown(
        spark,
        {"id": "v", "values": ["5 days."]}, {"id": "blank", "values": [" "]}, {"id": "lv", "values": ["see " + m("v")]}, {"id": "ll", "label": "time " + m("v")},
        {"id": "c", "select": {"choice": ["  a ", "b\n", " " + m("v")]}}, {"id": "none", "select": {"how-many": "one-or-more", "choice": []}},
        {"id": "g1", "guidelines": [{"prose": "within " + m("v")}]}, {"id": "g2", "guidelines": [{"prose": " " + m("blank") + " ;. "}, {"prose": "then this;\n"}, {"prose": m("nope")}]},
        {"id": "g3", "guidelines": [{"prose": " ;. "}]}, {"id": "n", "select": {"how-many": "one-or-more", "choice": [m("c"), m("g1")]}}, {"id": "x"}, {"id": "o", "label": "Organization-defined thing"},
    )
    assert got == {
        "v": "5 days.", "blank": " ", "lv": "see " + m("v"), "ll": "[organization-defined time " + m("v") + "]", "c": "[selection (one): a; b; 5 days.]", "none": "[organization-defined selection]",
        "g1": "[organization-defined within 5 days]", "g2": "[organization-defined then this;]", "g3": "[organization-defined value]",
        "n": "[selection (one or more): [selection (one): a; b; 5 days.]; [organization-defined within 5 days]]", "x": "[organization-defined value]", "o": "[Organization-defined thing]",
    }


def test_chains_of_parameters(spark):
    link = lambda n, to: {"id": f"p{n}", "select": {"choice": ["{{ insert: param, p%s }}" % to]}}
    chain = [{"id": "p0", "values": ["x"]}, *(link(n, n - 1) for n in range(1, 9))]
    assert _shown(spark, *chain)["p8"] == "[selection (one): " * 8 + "x" + "]" * 8
    for bad in ([*chain, link(9, 8)], [link(1, 2), link(2, 1)], [link(1, "nope")]):
        with pytest.raises(ValueError, match="unknown, circular or too deep"):
            _shown(spark, *bad)
    deep = catalog.rendered(_tables(spark, _doc(_control(params=chain))).parameters)
    flat = catalog.rendered(_tables(spark, _doc(_control(params=chain[:2]))).parameters)
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Join")
    assert joins(deep) == joins(flat) == 0


@pytest.mark.parametrize(
    ("controls", "match"),
    [
        ([_control(label=None)], "not all published forms: ac-1"), ([_control(), _control()], "a control twice: ac-1"), ([_control(), _control("ac-2", "ac-1", "AC-02", "ac-02")], "a form names two controls: ac-1 is ac-1 and ac-2"),
        ([_control(), _control("ac-2", "AC-2", None, "ac-02", status="withdrawn")], "not all published forms: ac-2"), ([_control(label="Straße"), _control("ac-2", "STRASSE", "AC-02", "ac-02", status="withdrawn")], "a form names two controls: strasse"),
    ],
)
def test_an_index_that_cannot_be_is_refused(spark, controls, match):
    with pytest.raises(Exception, match=match):
        catalog.chunk_catalog(_tables(spark, _doc(*controls)))


def test_resolving_by_published_labels(spark):
    rows = [("x-1", "Straße 7", "ſ-07", "k-07"), ("ac-2", "AC-2", "AC-02", "ac-02")]
    controls = spark.createDataFrame(rows, "id string, label string, padded_label string, sort_id string")
    index = catalog.control_index(controls)
    asked = ["STRASSE 7", " straße 7\n", "S-07", "K-07", "x-1", "X-01", "ac-02(01)", "AC 2", "ac-02", "", " ", None, "strase 7"]
    got = catalog.resolve(spark.createDataFrame([(n, t) for n, t in enumerate(asked)], "n int, text string"), controls, index=index).collect()
    assert {r.n: r.resolved for r in got} == dict(enumerate(["x-1"] * 5 + [None, None, "ac-2", "ac-2", None, None, None, None]))
    with pytest.raises(Exception, match="no such control: strase 7"):
        catalog.required_controls(spark.createDataFrame([("strase 7",)], "text string"), controls, index=index).collect()


def test_case_folding_is_that_of_python(spark):
    import sys
    from tessera.functions.text import casefolded

    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    rows = spark.createDataFrame([(x + "a",) for x in points], "t string").select("t", casefolded(F.col("t")).alias("f")).collect()
    assert [r.t for r in rows if r.f != r.t.casefold()] == []


# ---- commits


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v long, x string")


def _state(spark, root, version=None):
    return {r.k: (r.v, r.x, r.created_at.day) for r in commits.table(spark, root, version).collect()}


def _day(n):
    return F.lit(datetime.datetime(2024, 1, n))


def test_merges_write_what_changed(spark, tmp_path):
    root = str(tmp_path / "t")
    first = commits.merge(_rows(spark, *((f"k{n}", n, "a") for n in range(200))), root, "k", _day(1), buckets=16, facts={"of": "one"})
    assert (first["version"], first["inserted"], first["touched"], first["rows"]) == (1, 200, 16, 200)
    files = lambda: {p for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    before = files()
    two = commits.merge(_rows(spark, ("k3", 3, "b"), ("new", 0, "c"), ("k4", 4, "a")), root, "k", _day(2), deletes=_rows(spark, ("k5", 0, ""), ("k999", 0, "")))
    assert (two["inserted"], two["changed"], two["deleted"], two["unchanged"], two["rows"]) == (1, 1, 1, 198, 200) and two["touched"] <= 3
    assert sum(p.stat().st_size for p in files() - before) < sum(p.stat().st_size for p in before) / 3
    now = _state(spark, root)
    assert now["k3"] == (3, "b", 1) and now["new"] == (0, "c", 2) and now["k4"] == (4, "a", 1) and "k5" not in now and len(now) == 200
    assert len(_state(spark, root, 1)) == 200 and _state(spark, root, 1)["k3"] == (3, "a", 1)  # an old version is still whole
    # the same again changes and writes nothing; the digest is that of a table written at once
    same = commits.merge(commits.table(spark, root).drop("created_at"), root, "k", _day(3), complete=True)
    assert (same["touched"], same["version"], same["digest"]) == (0, 3, two["digest"]) and commits.entry(spark, root).facts == {"of": "one"}
    other = commits.merge(commits.table(spark, root).drop("created_at"), str(tmp_path / "u"), "k", _day(3), buckets=16)
    assert other["digest"] == two["digest"]
    gone = commits.merge(_rows(spark, ("k7", 7, "a")), root, "k", _day(4), complete=True)
    assert (gone["deleted"], gone["rows"]) == (199, 1) and _state(spark, root) == {"k7": (7, "a", 1)}
    assert commits.vacuum(spark, root) > 0 and _state(spark, root) == {"k7": (7, "a", 1)} and len(files()) == 1


def test_commits_are_whole_and_one_writer_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert commits.entry(spark, root) is None
    with pytest.raises(ValueError, match="nothing was committed"):
        commits.table(spark, root)
    commits.merge(_rows(spark, ("a", 1, "x")), root, "k", _day(1), facts={"n": 1}, expected=0)
    add, seen = commits._added, []

    def slow(*args):  # before the entry is added, a reader sees the version before it; meanwhile another writer commits
        seen.append((_state(spark, root), commits.entry(spark, root).facts))
        if len(seen) == 1:
            commits.merge(_rows(spark, ("b", 2, "y")), root, "k", _day(2), facts={"n": 2})
        return add(*args)

    monkeypatch.setattr(commits, "_added", slow)
    with pytest.raises(commits.Conflict):
        commits.merge(_rows(spark, ("a", 9, "z")), root, "k", _day(3), facts={"n": 3}, expected=1)
    assert _state(spark, root) == {"a": (1, "x", 1), "b": (2, "y", 2)} and commits.entry(spark, root).facts == {"n": 2}
    seen.clear()
    done = commits.merge(_rows(spark, ("a", 9, "z")), root, "k", _day(3), facts={"n": 3})  # loses once, and goes on from the winner's
    assert seen[0] == ({"a": (1, "x", 1), "b": (2, "y", 2)}, {"n": 2}) and done["version"] == 4
    assert _state(spark, root) == {"a": (9, "z", 1), "b": (2, "y", 2)} and commits.entry(spark, root).facts == {"n": 3}
    monkeypatch.setattr(commits, "_added", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError, match="crash"):
        commits.merge(_rows(spark, ("q", 1, "q")), root, "k", _day(4), complete=True)
    assert _state(spark, root) == {"a": (9, "z", 1), "b": (2, "y", 2)}


def test_merges_refused_and_repeated(spark, tmp_path):
    root = str(tmp_path / "t")
    for bad, match in (([("a", 1, "x"), ("a", 1, "x")], "a key twice"), ([(None, 1, "x")], "a null key")):
        with pytest.raises(Exception, match=match):
            commits.merge(_rows(spark, *bad), root, "k", _day(1))
    commits.merge(_rows(spark, ("a", 5, "x"), ("b", 1, "x")), root, "k", _day(1), tag=("s", 0))
    again = commits.merge(_rows(spark, ("a", 6, "y")), root, "k", _day(2), tag=("s", 0))
    assert again["version"] == 1 and _state(spark, root)["a"] == (5, "x", 1)
    commits.merge(_rows(spark, ("a", 4, "old"), ("b", 2, "new")), root, "k", _day(2), newer="v", tag=("s", 1))
    assert _state(spark, root) == {"a": (5, "x", 1), "b": (2, "new", 1)}
    with pytest.raises(ValueError, match="the table has the columns"):
        commits.merge(spark.createDataFrame([("a", 1)], "k string, w long"), root, "k", _day(3))
    with pytest.raises(ValueError, match="the table's key is k"):
        commits.merge(_rows(spark, ("a", 1, "x")), root, "x", _day(3))
    wide = commits.merge(spark.createDataFrame([("a", 1)], "k string, w long"), root, "k", _day(3), complete=True)
    assert wide["changed"] == 1 and [tuple(r)[:2] for r in commits.table(spark, root).collect()] == [("a", 1)]


def test_a_stored_corpus_is_held_against_its_pins(spark, tmp_path):
    root = str(tmp_path / "c")
    pins = {c: FROM[c] for c in ("name", "revision", "dimensions")} | {"chunks": 2}
    assert maintenance.verify_corpus(spark, root, pins) == "nothing was ingested"
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    maintenance.ingest(chunks, vectors, root, FROM, _day(1))
    assert maintenance.verify_corpus(spark, root, pins) is None
    assert maintenance.verify_corpus(spark, root, pins | {"name": "other"}) == "name: 'm', not 'other'"
    assert maintenance.verify_corpus(spark, root, pins | {"chunks": 3}) == "chunks: 2, not 3"
    part = next(p["path"] for p in commits.entry(spark, root).parts.values())
    changed = spark.read.parquet(part).withColumn("embedding", F.expr("transform(embedding, x -> x + 1)")).collect()
    spark.createDataFrame(changed, spark.read.parquet(part).schema).write.mode("overwrite").parquet(part)
    assert "other rows than were ingested" in maintenance.verify_corpus(spark, root, pins)
    with pytest.raises(Exception, match="a stored key twice"):
        maintenance.upsert(spark.createDataFrame([("a", 1), ("a", 2)], "k string, c int"), spark.createDataFrame([("a",)], "k string"), "k", "c", F.lit(3)).collect()


def test_catalog_joins_are_dealt_by_key(spark, monkeypatch):
    """No side that grows with the documents goes through the driver, whatever its compressed files weigh."""
    plans, own = [], catalog.saved
    monkeypatch.setattr(catalog, "saved", lambda df, *more, **by: (plans.append(df), own(df, *more, **by))[1])
    part = lambda n: {"name": "statement", "prose": "do {{ insert: param, p%d }} now" % n}
    params = lambda n: [{"id": f"p{n}", "values": ["v"]}, {"id": f"q{n}", "select": {"choice": ["{{ insert: param, p%d }}" % n]}}]
    t = tables(spark, catalog_of([control(f"ab-{n}", [part(n)], params=params(n)) for n in range(3)]))
    out = [catalog.resolution_digest(t), catalog.chunk_catalog(t)]
    said = [df._jdf.queryExecution().executedPlan().toString() for df in [*plans, *out]]
    assert sum("Join" in x for x in said) > 3 and not any("Broadcast" in x for x in said)
    assert len(out[0].collect()) == 1
    assert [r.text.rsplit("\n", 1)[1] for r in out[1].orderBy("path").collect()] == ["do v now"] * 3


def test_nearest_rows_in_bounded_pieces():
    """A worker holds some of the queries' distances at a time, and k rows of each query leave it; NaN is last, ties go by key."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    x, q = r.integers(0, 3, (4096, 3)).astype(float), r.integers(1, 3, (3000, 3)).astype(float)
    lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), lists(x)], names=["id", "v"])
    asked = pa.table({"q_id": np.arange(3000), "q": lists(q)})
    tracemalloc.start()
    found = pa.Table.from_batches(search._nearest(iter([rows]), asked, 5, False, ["q_id", "id", "distance"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(found) == 5 * 3000
    with np.errstate(invalid="ignore"):
        for n in range(0, 3000, 97):
            far = 1.0 - (x * q[n]).sum(axis=1) / (np.sqrt((q[n] * q[n]).sum()) * np.sqrt((x * x).sum(axis=1)))
            assert found.slice(5 * n, 5)["id"].to_pylist() == np.lexsort((np.arange(4096), far))[:5].tolist()


def test_encoders_get_batches_of_bounded_size(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: str(spark.conf.get(k)) for k in keys}

    def bounded(texts, make):
        if len(texts) > 4096 or sum(map(len, texts)) > 5 << 20:
            raise ValueError(f"{len(texts)} texts at once")
        return make(texts)

    try:
        for n, size in ((6000, 1), (40, 1 << 20)):
            rows = spark.range(0, n, 1, 1).select(F.repeat(F.lit("x"), size).alias("text"))
            for made in (encoders.embed, encoders.counted):
                spark.conf.set(keys[0], "10000"), spark.conf.set(keys[1], str(1 << 30))
                if made is encoders.embed:
                    out = made(rows, "text", lambda: lambda t: bounded(t, encoders.seeded(2)), 2)
                else:
                    out = made(rows, "text", lambda: lambda t: bounded(t, lambda x: [len(y) for y in x]))
                assert out.filter(F.col(out.columns[-1]).isNotNull()).count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
