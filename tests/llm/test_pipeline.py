"""The pipeline stage by stage against plain Python, its edge cases, and the SQL of the queries that have some."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import bpe, decontaminate, pipeline, quality, queries
from test_operators import brute_gone, docs, edit_distance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    r = random.Random(11)
    words = ["".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(150)]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    junk = lambda n: " ".join(r.choice(["$$", "##!", "X|X", "@@@"]) for _ in range(n))
    passage, items = prose(40), [(n, prose(25)) for n in range(4)] + [(4, None), (None, "x y z"), (5, "ab")]
    rows = []
    for n in range(150):
        t = prose(r.randint(20, 70))
        if n % 10 == 3:
            t = junk(r.randint(20, 60))
        elif n % 10 == 5:
            t += "\n" + passage + " " + prose(3)
        elif n % 10 == 7:
            p = items[n % 4][1].split()
            p[3] = p[3][:-1] + "x"
            t += " " + " ".join(p).upper() + " end"
        elif n % 10 == 9:
            near = rows[-4][1].split()
            near[-1] = "other"
            t = " ".join(near)
        rows.append((n, t))
    rows += [(200, None), (201, ""), (202, "  \n"), (203, "one"), (None, prose(30)), (None, None), (204, rows[0][1]), (204, rows[0][1]), (205, rows[1][1].upper()), (206, prose(2500)), (207, "tie"), (207, "tie two")]
    labels = [(n, int(n % 10 != 3)) for n in range(150)] + [(None, 1), (3, None)]
    return rows, labels, items


def kept_of(rows):
    """One row of each component of documents whose sets of five words are alike, with the smallest id; null ids stay."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)]))
    root = list(range(len(rows)))
    while True:
        before = list(root)
        for x, p in enumerate(sets):
            for y in range(x):
                if root[x] != root[y] and 5 * len(p & sets[y]) >= 4 * len(p | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
        root = [root[k] for k in root]
        if root == before:
            break
    least = {}
    for c, (i, _) in zip(root, rows):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    out = [x for x in rows if x[0] is None]
    for i in sorted(set(least.values())):
        out.append(min((x for x in rows if x[0] == i), key=lambda x: (x[1] is not None, (x[1] or "").encode())))
    return out


def without_gone(rows):
    out = []
    for (i, t), (_, words, gone) in zip(rows, brute_gone(rows, lambda t: (t or "").encode().split(), 13)):
        out.append((i, b" ".join(w for w, g in zip(words, gone) if not g).decode() if any(gone) else t))
    return out


def clean_of(rows, items):
    normal = [(k, decontaminate.normal(p.encode())) for k, p in items if k is not None and p]

    def found(t):
        t = decontaminate.normal((t or "").encode())
        return any(edit_distance(p, t) <= decontaminate.edits_within(p) if len(p) >= decontaminate.GRAM else p in t for _, p in normal)

    return [x for x in rows if not found(x[1])]


def test_pipeline_by_plain_python(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.word_vocabulary())
    rows, labels, items = tables()
    full = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    full.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = quality.fit(full, known)
    state = [x for x in rows if float(model.score(quality.statistics((x[1] or "").encode())[None])[0]) >= quality.THRESHOLD]
    assert 0 < sum(x[0] is not None and x[0] < 150 and x[0] % 10 == 3 for x in rows) - sum(x[0] is not None and x[0] < 150 and x[0] % 10 == 3 for x in state)
    counts = [len(rows), len(state)]
    held = full
    key = lambda x: (str(x[0]), x[1] is not None, x[1] or "")
    for (name, stage), plain in zip(pipeline.STAGES[:-1], (lambda _: state, kept_of, without_gone, lambda x: clean_of(x, items))):
        state = plain(state)
        held = stage(spark, held, str(tmp_path))
        assert held.columns == full.columns
        assert sorted(((r.doc_id, r.text) for r in held.collect()), key=key) == sorted(state, key=key), name
        counts.append(len(state))
    assert counts[1] < counts[0] and counts[3] < counts[2] and counts[5] < counts[4]
    want = []
    for i, t in state:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_stages_at_their_edges(spark, tmp_path):
    """Empty tables, tables without labels or items, clashing column names: each stage has a result with the columns it got."""
    rows, labels, items = tables()
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clashing = docs(spark, rows[:12] + rows[150:])
    for name, stage in pipeline.STAGES[:-1]:
        empty = stage(spark, clashing.limit(0), str(tmp_path))
        assert empty.columns == clashing.columns and empty.count() == 0
        found = stage(spark, clashing, str(tmp_path))
        assert found.columns == clashing.columns and 0 < found.count() <= clashing.count(), name
    assert pipeline.STAGES[-1][1](spark, clashing.limit(0), "").count() == 0 and pipeline.STAGES[-1][1](spark, clashing, "").count() == clashing.count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        try:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        except duckdb.Error:
            pytest.skip("no driver tables")
    df = queries.QUERIES[name](spark, folder)
    found = con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()), key=key)


def test_held_out_rows_by_crc(spark):
    """The queries of both classifiers say of each row whether it was learned from."""
    for name in ("op3_language_id", "op6_quality"):
        for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
