"""Every query with SQL against DuckDB on the smallest tables, and the cases that the tables don't have."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tessera import plans, sources
from tessera.functions import text as T
from tessera.functions.vectors import cosine_distance, unit
from tessera.operators import catalog, commits, search
from tessera.operators.answers import answer_segments, json_string, parse_citations
from tessera.operators.encoders import embed, seeded

DATA = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "embeddings", "labels", "part", "benchmark", "region", "nation", "customer")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, con, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(plans.SQL[name])
    assert columns == sorted(found.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(_plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert ours == theirs


def test_zero_vectors_sort_last(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = search.top_k(v, spark.createDataFrame([([1.0, 0.0],)], "q array<float>"), 5).collect()
    assert [r.vec_id for r in rows] == [1, 3, 2] and math.isnan(rows[-1].score)
    with pytest.raises(ValueError, match="at least 1"):
        search.top_k(v, v.selectExpr("embedding q"), 0)


def test_cosine_and_unit(spark):
    row = spark.range(1).select(cosine_distance(F.expr("array(3f, 4f)"), F.expr("array(4f, 3f)")).alias("d"), unit(F.expr("array(3f, 4f)")).alias("u"), unit(F.expr("array(0f)")).alias("z")).first()
    assert row.d == pytest.approx(1 - 24 / 25) and row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0]


def test_unknown_marker_and_shared_form_fail(spark):
    prose = spark.createDataFrame([(1, "x {{ insert: param, nope }}")], "id int, text string")
    with pytest.raises(Exception, match="no such parameter"):
        catalog.resolve_markers(prose, spark.createDataFrame([("a", "b")], "param string, rendered string")).collect()
    with pytest.raises(Exception, match="two controls"):
        catalog.control_index(spark.createDataFrame([("ac-2",), ("AC-2",)], "id string")).collect()


def test_nested_markers(spark):
    p = spark.createDataFrame([("a", "x {{ insert: param, b }} , y"), ("b", "{{ insert: param, c }} days"), ("c", "z"), ("n", None)], "param string, rendered string")
    assert {r.param: r.rendered for r in catalog.nested_parameters(p).collect()} == {"a": "x z days, y", "b": "z days", "c": "z", "n": None}
    for bad in ([("a", "{{ insert: param, a }}")], [("a", "{{ insert: param, nope }}")]):
        with pytest.raises(Exception, match="unknown, circular or too deep"):
            catalog.nested_parameters(spark.createDataFrame(bad, "param string, rendered string")).collect()


@pytest.mark.parametrize(("text", "wanted"), [("Keep {{insert: param, p}} next to {{ insert: param, p }} ; or", "Keep X next to X; or"), ("{{ insert: param, p }}{{ insert: param, p }}", "XX"), ("[ {{ insert: param, p }} ]", "[X]"), ("[AB-1](#x) . Left as it is", "[AB-1](#x) . Left as it is"), ("", "")])
def test_marker_seams(spark, text, wanted):
    prose = spark.createDataFrame([(1, text)], "id int, text string")
    assert catalog.resolve_markers(prose, spark.createDataFrame([("p", "X")], "param string, rendered string")).first().resolved == wanted


@pytest.mark.parametrize(("text", "wanted"), [("a\u00a0b", "a b"), ("a  \t b ; c", "a b; c"), ("a\n\n\n\nb", "a\n\nb"), ("a\n \n \nb  ", "a\n\nb"), ("  ", "")])
def test_normal_space(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.normal_space(F.col("t"))).first()[0] == wanted


@pytest.mark.parametrize("text", ["one", "one\n", "one\n\n", "\none", "a\rb", "a\r\nb", ""])
def test_answer_lines_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.answer_of(T.answer_lines(F.col("t")))).first()[0] == text


def test_json_strings(spark):
    texts = ["", "a", 'q"\\/', "\n\r\t\b\f\x00\x1f\x7f", "é\u2028😀x", "\\u00e9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in rows} == {t: json.dumps(t) for t in texts}


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    v = spark.createDataFrame([(n, [float(n % 5), 1.0]) for n in range(30)], "vec_id long, embedding array<float>")
    found = search.batch_top_k(v, v.selectExpr("vec_id q_id", "embedding q"), 2).collect()
    assert {(r.q_id, r["rank"], r.vec_id) for r in found} == {(n, k + 1, n % 5 + 5 * k) for n in range(30) for k in (0, 1)}
    odd = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 0.0])], "name string, embedding array<float>")
    rows = search.batch_top_k(odd, odd.filter("name < 'c'").selectExpr("name q_id", "embedding q"), 5, key="name", but_itself=True).orderBy("q_id", "rank").collect()
    assert [(r.q_id, r.name) for r in rows] == [("a", "d"), ("a", "b"), ("b", "a"), ("b", "d")] and math.isnan(rows[1].score)
    assert search.batch_top_k(odd.limit(0), odd.filter("name = 'a'").selectExpr("name q_id", "embedding q"), 5, key="name").count() == 0
    assert search.batch_top_k(odd, odd.limit(0).selectExpr("name q_id", "embedding q"), 5, key="name").count() == 0
    hits, sizes = search.judged(v.selectExpr("vec_id % 3 q_id", "vec_id", "cast(vec_id / 3 as int) + 1 rank"), spark.createDataFrame([(0, 3), (1, 1), (1, 99), (2, 99)], "q_id long, vec_id long"))
    m = {r.k: tuple(r)[1:] for r in search.ranking_measures(hits, sizes, [1, 2]).collect()}
    assert m[1] == pytest.approx((0.5 / 3, 1 / 3, 1 / 3)) and m[2] == pytest.approx((1.5 / 3, 1 / 3, 1.5 / 3))


def test_segments_without_citations(spark):
    a = spark.createDataFrame([(1, "[x] and [y]"), (2, "[ac-1][ac-1]"), (3, "")], "id int, answer string")
    rows = {(r.id, r.pos): (r.kind, r.text) for r in answer_segments(a, parse_citations(a)).collect()}
    assert rows == {(1, 0): ("text", "[x] and [y]"), (2, 0): ("citation", "ac-1"), (2, 1): ("citation", "ac-1")}


def test_sources(spark, tmp_path):
    (tmp_path / "1_first.sql").write_bytes(b"a\r\nb")
    (tmp_path / "2_second.sql").write_bytes(b"c")
    (tmp_path / "notes.txt").write_bytes(b"x")
    rows = sources.scripts(spark, str(tmp_path)).orderBy("version").collect()
    assert [(r.version, r.name) for r in rows] == [(1, "first"), (2, "second")]
    (tmp_path / "4_gap.sql").write_bytes(b"d")
    with pytest.raises(Exception, match="run on from 1"):
        sources.scripts(spark, str(tmp_path)).collect()
    (tmp_path / "x.json").write_text('{"a": [1]}')
    assert sources.whole_json(spark, str(tmp_path / "x.json")).selectExpr("variant_get(document, '$.a[0]', 'int') a").first().a == 1
    assert sources.file_digests(spark, str(tmp_path / "notes.txt")).first().sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_publish_and_stream(spark, tmp_path):
    from tessera.streaming import upsert_stream

    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(2, 2, "c"), (3, 1, "d")]]):
        spark.createDataFrame(rows, "k int, v int, x string").write.mode("append").parquet(str(tmp_path / "in"))
        changes = spark.readStream.schema("k int, v int, x string").parquet(str(tmp_path / "in"))
        upsert_stream(changes, str(tmp_path / "corpus"), "k", "v", str(tmp_path / "check")).awaitTermination(60)
    assert sorted(map(tuple, commits.table(spark, str(tmp_path / "corpus")).drop("created_at").collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]


def test_encoder_width_is_checked(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert len(embed(df, "t", lambda: seeded(4), 4).first().embedding) == 4
    with pytest.raises(Exception, match="the encoder gave"):
        embed(df, "t", lambda: seeded(4), 5).collect()
