"""Operators 11 to 13 against plain Python: nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, quality_rules, whitening

CLASHING = "doc_id long, source string, lang string, n_chars long, text string, hash string, pos int, level int, path string"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], CLASHING).repartition(partitions)


# ---- 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, pos):
    out = []
    for level in levels[:-1]:
        out.append((pos & 1, level[pos ^ 1] if pos ^ 1 < len(level) else None))
        pos >>= 1
    return out


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in groups[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    for rank, name in enumerate(names):
        for pos, r in enumerate(groups[name]):
            path = siblings(trees[name], pos) + siblings(top, rank)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for right, other in path:
                h = sha(h) if other is None else sha(other, h) if right else sha(h, other)
            yield r[0], leaf(r), trees[name][-1][0], top[-1][0], sha(*(x for _, x in path if x)), h, not hit


def proved(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("levels", [2, 8])
def test_manifest_of_documents(spark, levels):
    langs = ["en"] * 5 + ["de", "fr", "é", "zz", None, ""]
    rows = [(i, f"s{i % 3}" if i % 4 else None, langs[i % 11], None if i % 9 == 0 else i, f"text {i}\n" * (i % 5)) for i in range(60)]
    rows += [(5, "s", "en", 5, "again"), (5, "s", "en", 5, "again"), (5, "s", "en", 5, "other"), (None, None, None, None, None), (None, "s", "en", 1, "é" * 40_000), (-3, "s", "en", 1, None), (99, "a", "lone", 1, "")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = proved(merkle.prove_documents(table(spark, rows), hit, levels=levels))
    assert found == sorted(expected(rows), key=str)
    assert {x[-1] for x in found} == {True, False} and len({x[3] for x in found}) == 1


def test_manifest_of_many_leaves_in_one_group(spark):
    rows = [(i, "s", "en" if i % 97 else None, i, str(i)) for i in range(700)]
    assert proved(merkle.prove_documents(table(spark, rows))) == sorted(((*x[:5], x[3], True) for x in expected(rows)), key=str)


def test_manifest_of_few_rows(spark):
    for rows in ([(1, "s", "en", 1, "t")], [(1, "s", None, 1, "t"), (1, "s", "", 1, "t")]):
        assert proved(merkle.prove_documents(table(spark, rows))) == sorted(((*x[:5], x[3], True) for x in expected(rows)), key=str)
    assert merkle.prove_documents(table(spark, [(1, "s", "en", 1, "t")]).limit(0)).count() == 0


def test_proofs_of_wanted_leaves(spark, tmp_path):
    rows = [(i, "s", "en" if i % 3 else "de", i, str(i)) for i in range(90)]
    whole = merkle.manifest(merkle.document_leaves(table(spark, rows)), str(tmp_path), levels=2)
    wanted = whole.leaves.filter("doc_id in (7, 8, 60)").select("group", "n", "pos", "doc_id", "hash")
    proofs = whole.proofs(wanted).drop("n").join(wanted, ["group", "pos"]).collect()
    assert {r.doc_id for r in proofs} == {7, 8, 60}
    for r in proofs:
        fold = lambda h, r=r: merkle.fold(h, bytes(r.path), r.n, r.pos, r.groups, r.rank)
        assert fold(bytes(r.hash)) == bytes(r.root) and fold(b"\0" * 32) != bytes(r.root)
        with pytest.raises(ValueError, match="another length"):
            merkle.fold(bytes(r.hash), bytes(r.path) + b"\0" * 32, r.n, r.pos, r.groups, r.rank)
    assert {int(p.name.removeprefix("level=")) for p in (tmp_path / "trees").glob("level=*")} == set(range(7))
    with pytest.raises(Exception, match="no such coordinate"):
        whole.proofs(wanted.limit(1).withColumn("pos", F.lit(60).cast("long"))).collect()


# ---- 12


def vectors(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, n int, component int, x double").repartition(partitions)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def whitened(spark, rows, k, partitions=3):
    """Checked against an eigendecomposition of the covariance."""
    found = whitening.whiten(vectors(spark, rows, partitions), k).collect()
    left = [(i, v) for i, v in rows if usable(v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in left])
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, x.shape[1])
    assert len(found) == n * k and {r.component for r in found} == set(range(1, k + 1)) and {r.n for r in found} == {n}
    deviation = defaultdict(set)
    for (i, _), row in zip(left, x.tolist(), strict=True):
        deviation[i].add(sum((n * a - b) ** 2 for a, b in zip(row, s.tolist(), strict=True)))
    assert all(r.deviation in deviation[r.vec_id] for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.component].append((r.vec_id is not None, r.vec_id or 0, r.whitened))
    for c, ours in by.items():
        if e[c - 1] > 1e-9 * max(e[0], 1e-300):
            theirs = centred @ q[:, c - 1] / np.sqrt(e[c - 1])
            want = sorted((i is not None, i or 0, float(t)) for (i, _), t in zip(left, theirs, strict=True))
            sign = 1 if np.sign(max(want, key=lambda r: abs(r[2]))[2]) == np.sign(max(ours, key=lambda r: abs(r[2]))[2]) else -1
            assert np.allclose([r[2] for r in sorted((*r[:2], sign * r[2]) for r in ours)], [r[2] for r in want], atol=1e-6)
        else:
            assert {r[2] for r in ours} == {0.0}
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-9
    for r in found:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), abs=1e-9) if e.sum() > 0 else r.explained == 0
    return found


def test_whitening(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(300, 7)) * np.array([9, 5, 3, 2, 1, 0.5, 0.2]) + 4)]
    rows += [(1000, None), (1001, [1.0] * 6 + [None]), (1002, [1.0] * 6 + [float("nan")]), (1003, [1.0] * 6 + [float("inf")]), (1004, [-0.0] * 7), (1004, [-0.0] * 7), (None, [2.0] * 7)]
    whitened(spark, rows, 4)
    whitened(spark, rows, 32, partitions=40)  # merges of merges, with empty partitions


def test_whitening_without_variance(spark):
    whitened(spark, [(1, [1.0, 2.0])], 5)
    whitened(spark, [(i, [1.0, 2.0]) for i in range(5)], 5)
    whitened(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], 5)
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="vectors of"):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])], 1)).count()


def test_merging_loses_nothing():
    r = np.random.default_rng(5)
    x = r.integers(-1000, 1000, size=(500, 6)) + 10**9
    parts = [whitening.Summary.of(p) for p in np.array_split(x, 13)]
    one = parts[0]
    for p in parts[1:]:
        one = one.merge(p)
    c = x - x.mean(axis=0)
    assert one.n == 500 and one.sums == x.sum(axis=0).tolist()
    assert np.allclose((one.vectors.T * one.values**2) @ one.vectors, c.T @ c, rtol=1e-10)
    w = whitening.Whitening.of(one)
    assert w.deviations(x[:3]) == [sum((500 * int(a) - s) ** 2 for a, s in zip(row, one.sums, strict=True)) for row in x[:3]]
    with pytest.raises(OverflowError):
        w.deviations(x[:1] * 10**6)


# ---- 13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = defaultdict(list)
    for i, w in enumerate(windows):
        many[w].append(i)
    covered = {i + k for at in many.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def judged(line):
    """The rule that a line fails, in plain Python."""
    marks, words, body = r"[!?#*$%&<>|=_~^+»·/\\«-]", WORD.findall(line), line.strip(" \t\n\x0b\x0c\r")
    noise = len(re.findall(marks + "{2,}", line)) + sum(1 for w in words if re.fullmatch(marks, w))
    if noise * 25 > len(line):
        return "navigation" if 2 * sum(1 for w in words if re.fullmatch(r"[|>»·/<«-]+", w)) > noise else "punctuation"
    if len(line) <= 40 and line.lower().strip(" ").startswith(quality_rules.NAVIGATION) and body[-1] not in ".!?":
        return "navigation"
    if len(line) <= 250 and any(p in line.lower() for p in quality_rules.BOILERPLATE):
        return "boilerplate"
    if body[-1] not in quality_rules.CLOSERS and (len(line) < 40 or not re.search(quality_rules.MARKED, line)):
        return "punctuation"
    return None


LINES = [
    "Home | About | Contact | Help", "Read more", "read more about it, said the man.", "Licensed under the Apache License, Version 2.0.", "A plain line, which ends as it should.", "a fragment", "BUY!! NOW!! IT!! IS!! CHEAP!!",
    "wörd*** after$$$ word%%% with### noise", "A long line without any closing mark, but with a comma in the middle of it", "a long line without any mark at all that goes on and on and on for a while", "  \t", "", "Ends in a quote.»", "ends in tabs.\t\t", "x - y - z, and so on, for as long as it takes to be a line of prose.", "«", "\x0b", "𝔘𝔫𝔦 code points 😀 beyond, here.", "price <b>$5</b> & more, as told by the one who sells it here today.",
]


def test_quality_rules(spark):
    r = np.random.default_rng(1)
    texts = [None, "", "  \n\t", "one", "a b c a b c", "\x00 a\rb\x0bc\x0cd", "x y z " * 30_000, "\n".join(LINES * 3), "no break here " * 60]
    texts += ["\n".join(LINES[i] for i in r.integers(0, len(LINES), r.integers(1, 12))) for _ in range(60)]
    texts += [" ".join(f"w{x}" for x in r.integers(0, 9, 80)) + "." for _ in range(10)] + ["\n".join(f"Line {k} of text {i}, which is whole." for k in range(12)) for i in range(5)]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[7])]
    df = spark.createDataFrame([(i, t, 1, "q", "l") for i, t in rows], "doc_id long, text string, n_words int, quality_rules string, line string").repartition(3)
    out = quality_rules.clean_lines(df)
    assert sorted(out.columns) == sorted(df.columns)
    found = out.collect()
    assert len(found) == len(rows)
    for x in found:
        q = x.quality_rules
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base(x.text), x.text
        lines = [(line, judged(line)) for line in (x.text or "").split("\n") if WORD.search(line)]
        lost = {rule: sum(len(line) for line, why in lines if why == rule) for rule in ("punctuation", "navigation", "boilerplate")}
        assert (q.punctuation, q.navigation, q.boilerplate) == tuple(lost.values()), x.text
        assert q.cleaned == "\n".join(line for line, why in lines if not why) and q.n_lines == len(lines) and q.n_chars == sum(len(line) for line, _ in lines)
        assert q.kept == (not q.base_failed and 100 * sum(lost.values()) <= 50 * q.n_chars)
    assert {x.quality_rules.kept for x in found} == {True, False}
    kept = quality_rules.cleaned(df)
    assert kept.columns == df.columns and kept.count() == sum(x.quality_rules.kept for x in found)
    assert quality_rules.clean_lines(df.limit(0)).count() == 0


def test_quality_rules_are_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.clean_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


# ---- 9: a host's label may be any character


def test_url_rules_hold_for_the_last_characters(spark):
    from tessera.llm import url_filters

    labels = ["\U0010ffff", "\U0010ffff" * 3, "\U0010fffe", "z", "￿", "."]
    pages = [(i, f"http://{labels[i % 6]}{i % 7}.org/a{i}") for i in range(400)] + [(400 + i, f"http://{labels[i % 6]}.example.org/es/{i}") for i in range(100)] + [(500, "http://org/")]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    found = {r.page_id: r.rule for r in url_filters.filter_urls(df, spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")).collect()}
    assert found == {i: "example.org/es/" if 400 <= i < 500 else "org/" for i in range(501)}
