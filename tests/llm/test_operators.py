"""The numbered operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

from tessera.llm import bpe, chat, common, components, decontaminate, fingerprints, fm_index, language, pipeline, quality, shingles, simhash, substrings, suffix_array, suffix_dedup, url_filters, windows
from tessera.llm.templates import Template, TemplateError

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, data string, others string, part int, guest boolean, key long"


def docs(spark, rows, partitions=3):
    full = [(i, t, "en", "s", 0, "r", "d", "o", 1, True, 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def corpus(seed=1, n=60):
    """Documents with shared passages, copies, near copies, nulls, an empty, a one-word and a long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ri", "no", "é", "ku", "s"]) for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(n):
        t = " ".join(word() for _ in range(r.randint(0, 80)))
        if r.random() < 0.5:
            t += r.choice(["\n", " ", "\t\t"]) + r.choice(passages)[r.randint(0, 20) :] + " " + word()
        if out and r.random() < 0.2:
            t = r.choice(out)[1] or ""
            t = t if r.random() < 0.5 else t + " " + word()
        out.append((3 * i, t))
    out += [(1, None), (2, ""), (4, "   \n "), (5, "one"), (7, "ab " * 9000), (8, "ab " * 40), (10, passages[0]), (10, passages[0]), (10, passages[1]), (None, passages[0]), (None, None)]
    r.shuffle(out)
    return out


# ---- 1


def turns_hash(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b\\\\[INST]", "<|\\end|><|end|>", None, "", "<\\s><s>", "é" * 50_000, "<|turn|><|says|>\\"]
    rows = [(c, t, "assistant" if t % 2 else "user", said[(c + t) % len(said)]) for c in range(9) for t in range(c)] + [(None, 0, None, "x"), (3, 1, "assistant", "again"), (3, 1, "assistant", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.chat_digests(df.repartition(3)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(own), turns_hash([(r, x) for _, r, x in own]))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.chat_digests(df.limit(0)).count() == 0
    more = df.selectExpr("*", "'x' AS piece", "'y' AS learn", "1 AS n_turns", "'z' AS messages")
    assert sorted(map(str, chat.chat_digests(more).collect())) == sorted(map(str, out.values()))
    assert all(chat.unescape(chat.escape(x)) == (x or "") for x in said)


def test_templates():
    t = Template("{% if 1 == 1 %}a{% else %}b{% endif %}{{ 'x' ~ 2 }}{% for m in ms %}{{ loop.index0 }}{{ m.k }}{% if not loop.last %},{% endif %}{% endfor %}")
    assert t.text(ms=[{"k": "u"}, {"k": None}]) == "ax20u,1" and len(t.tree) == 2
    for bad in ("{{ x", "a {% if x %}b", "{# never", "{% for %}", "{% if x %}a{% endfor %}", "{% odd %}", "{% endif %}", "{{ 'a'.__class__ }}"):
        with pytest.raises(TemplateError):
            Template(bad).text()


# ---- 2


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def brute_components(values):
    nodes = sorted(set(values))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("small", [2, 32])
def test_links_keep_components(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    r = random.Random(5)
    values = []
    for _ in range(12):
        x = r.getrandbits(64)
        values.append(x)
        for _ in range(r.randint(0, 25)):
            x ^= 1 << r.randrange(64) if r.random() < 0.7 else 1 << r.randrange(64) | 1 << r.randrange(64)
            values.append(x)
    signed = [(simhash._signed(v),) for v in set(values)]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fingerprint long"))
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.components(links).collect()}
    want = brute_components(values)
    groups = lambda f: {frozenset(x for x in want if f(x) == k) for k in {f(x) for x in want}}
    assert groups(lambda x: roots.get(x, x)) == groups(want.get)


def test_near_duplicates(spark):
    rows = corpus()
    marks = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        marks.setdefault((i, t), sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    comp = brute_components(marks.values())
    least = {}
    for (i, _), m in marks.items():
        if i is not None:
            least[comp[m]] = min(i, least.get(comp[m], i))
    want = sorted((str(i), f"{marks[i, t]:016x}", least.get(comp[marks[i, t]])) for i, t in rows)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert got == want
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))


@pytest.mark.parametrize("led", [True, False])
def test_near_copies_by_shingles(spark, monkeypatch, led):
    """The pipeline's stage keeps one document of each component at 0.8 or more, with large buckets cut, common lines, and with no leaders."""
    monkeypatch.setattr(shingles, "BLOCK", 3)
    monkeypatch.setattr(shingles, "COMPARED", 2)
    if not led:
        monkeypatch.setattr(shingles, "_led", lambda *_: common.saved(spark.createDataFrame([], "a long, node long, band long")))
    r, line = random.Random(5), " ".join(f"line{k}" for k in range(12))
    rows = corpus(2)
    for g in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([9, 20, 60, 150]))]
        for k in range(5):
            own = list(words)
            for _ in range(k * len(own) // 50):
                own[r.randrange(len(own))] = f"x{r.randrange(400)}"
            rows.append((1000 + 10 * g + k, " ".join(own) + (" " + line if g % 2 else "")))
    rows += [(2000, " ".join(f"a{k}" for k in range(40))), (2001, " ".join(f"a{k}" for k in range(4, 40))), (2002, " ".join(f"a{k}" for k in range(8, 44)))]
    rows += [(3000, " ".join(f"b{k}" for k in range(9))), (3001, " ".join(f"b{k}" for k in range(8))), (3002, " ".join(f"c{k}" for k in range(8))), (3003, " ".join(f"c{k}" for k in range(7)))]
    hub = [f"h{k}" for k in range(100)]  # a text, and copies that are mostly nearer to it than to each other
    for k in range(20):
        places = r.sample(range(10), k % 4)
        rows.append((4000 + k, " ".join(f"y{k}" if j % 10 == 5 and j // 10 in places else w for j, w in enumerate(hub))))
    grams = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        grams.append((i, frozenset(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)])))
    root = list(range(len(rows)))
    for _ in rows:
        before = list(root)
        for x, (_, p) in enumerate(grams):
            for y, (_, q) in enumerate(grams[:x]):
                if 5 * len(p & q) >= 4 * len(p | q):
                    root[x] = root[y] = min(root[x], root[y])
        if root == before:
            break
    least = {}
    for c, (i, _) in zip(root, grams, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    kept = pipeline.near_duplicates(spark, docs(spark, rows), "")
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert {3000, 3002, 3003} <= set(least.values()) and 3001 not in least.values()
    assert pipeline.near_duplicates(spark, docs(spark, rows).limit(0), "").count() == 0


def test_parities_and_leaders(spark):
    """Sets differ in no fewer shingles than parities, alike sets in a ninth at most; a text leads its near copies."""
    r = random.Random(8)
    for _ in range(300):
        n = r.choice([1, 2, 9, 40, 300])
        x = np.array([r.getrandbits(64) for _ in range(n)], dtype=np.uint64)
        y = np.concatenate([x[r.randrange(n // 3 + 1) :], np.array([r.getrandbits(64) for _ in range(r.randrange(n // 3 + 1))], dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        odd = int(np.unpackbits((shingles.parities(x) ^ shingles.parities(y)).view(np.uint8)).sum())
        assert odd <= len(np.setxor1d(x, y))
        assert not shingles.alike(x, y) or 9 * odd <= len(x) + len(y)
    assert not shingles.parities(np.array([], dtype=np.uint64)).any()
    hub = [f"h{k}" for k in range(100)]
    texts = [" ".join(hub)] + [" ".join(f"z{k}" if k * 4 <= j < k * 4 + 3 else w for j, w in enumerate(hub)) for k in range(24)]
    nodes = [shingles._node(t.encode()) for t in texts]
    led = shingles._led(spark.createDataFrame(nodes, "node long, words binary")).collect()
    assert sum(row.a == nodes[0][0] for row in led) > len(led) / 2


def test_minima_are_over_whole_sets(monkeypatch):
    """Each band's minima are of the whole set in their own order: alike in as many as the similarity says, for short texts too."""
    r = np.random.default_rng(4)
    for size in (5, 20, 400):
        agree = []
        for _ in range(60):
            x = np.unique(r.integers(0, 2**64 - 1, size, dtype=np.uint64))
            y = np.unique(np.append(x[r.permutation(size)[: size - size // 5]], r.integers(0, 2**64 - 1, 1, dtype=np.uint64)))
            likeness = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            agree.append((shingles.minima(x) == shingles.minima(y)).mean() - likeness)
            assert len(shingles._bands(1, x)[0]) == shingles.BANDS
        assert abs(np.mean(agree)) < 0.03
    whole = shingles.minima(x)
    monkeypatch.setattr(shingles, "PIECE", 7)
    assert (shingles.minima(x) == whole).all() and len(shingles._bands(1, x[:0])[0]) == 0


def test_simhash_of_a_long_text_in_pieces(monkeypatch):
    r = random.Random(6)
    data = " ".join(r.choice(["ab", "c", "defg", "H"]) for _ in range(5000)).encode()
    whole = simhash.simhash(data)
    for piece in (1, 2, 7, 4998, 4999):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.simhash(data) == whole


# ---- 4 and 5


def brute_gone(rows, symbols, w):
    """Covered symbols of each row, by comparing all windows."""
    first = {}
    for i, t in rows:
        s = symbols(t)
        for k in range(len(s) - w + 1):
            if i is not None:
                first[tuple(s[k : k + w])] = min(i, first.get(tuple(s[k : k + w]), i))
    out = []
    for i, t in rows:
        s = symbols(t)
        gone = [False] * len(s)
        for k in range(len(s) - w + 1):
            if i is not None and first[tuple(s[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out.append((i, s, gone))
    return out


@pytest.mark.parametrize(("many", "shard", "chunk", "longest"), [(20_000, 10**6, 10**6, 256), (2, 300, 50, 3)])
def test_words(spark, monkeypatch, many, shard, chunk, longest):
    """Also with anchors dealt anew by longer grams, many shards, several reductions a task and short pieces."""
    monkeypatch.setattr(windows, "CHUNK", chunk)
    monkeypatch.setattr(windows, "LONGEST", longest)
    monkeypatch.setattr(windows, "MANY", many)
    rows = corpus(2)
    want = sorted((str(i), len(s), sum(g), b" ".join(x for x, y in zip(s, g) if not y).decode()) for i, s, g in brute_gone(rows, lambda t: (t or "").encode().split(), 13))
    out = substrings.dedup_words(docs(spark, rows), shard=shard).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out) == want
    assert sum(x[2] for x in want) > 500
    if many == 2:
        assert substrings.dedup_words(docs(spark, rows).limit(0)).count() == 0
        again = substrings.without_repeats(docs(spark, rows))
        assert again.columns == docs(spark, rows).columns
        assert sorted(" ".join((r.text or "").split()) for r in again.collect()) == sorted(" ".join(x[3].split()) for x in want)


@pytest.mark.parametrize(("many", "shard", "memory"), [(20_000, 10**6, 10**6), (2, 500, 64)])
def test_bytes(spark, monkeypatch, many, shard, memory):
    monkeypatch.setattr(windows, "MANY", many)
    rows = [(i, t if t is None or len(t) < 5000 else t[:4000]) for i, t in corpus(3)]
    want = []
    for i, s, g in brute_gone(rows, lambda t: (t or "").encode(), 50):
        kept = bytes(x for x, y in zip(s, g) if not y)
        want.append((str(i), len(s), sum(g), sum(a and not b for a, b in zip(g, [False, *g])), hashlib.sha256(kept).hexdigest()))
    out = suffix_dedup.dedup_bytes(docs(spark, rows), shard=shard, in_memory=memory).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def pieces_of(texts, kind):
    """Texts as a shard's distinct pieces, and the first document of each window by comparing them all."""
    import pyarrow as pa

    split = kind.split(pa.array([t.encode() for t in texts], pa.binary()))
    first = np.random.default_rng(1).permutation(len(texts)).astype(np.int64)
    symbols = [t.encode().split() if isinstance(kind, windows.Words) else t.encode() for t in texts]
    found = {}
    for d, s in zip(first.tolist(), symbols):
        for k in range(len(s) - kind.window + 1):
            w = tuple(s[k : k + kind.window])
            found[w] = min(d, found.get(w, d))
    return windows.Shard(split, first), [found[tuple(s[k : k + kind.window])] for s in symbols for k in range(len(s) - kind.window + 1)]


def test_engines_by_the_method():
    """A shard larger than the sort's memory: its queues spill and its names recur; an FM-index smaller than its text."""
    r = random.Random(9)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(20, 40))) for _ in range(900)]
    texts += [t[: len(t) // 2] + r.choice(texts)[-120:] for t in texts[:300]] + ["ab" * 150, "a" * 200, "aab" * 90]
    shard, want = pieces_of(texts, windows.Bytes())
    used = []
    own = suffix_array.Store.close
    suffix_array.Store.close = lambda self: (used.append((self.spilled, self.depth)), own(self))[1]
    try:
        got = suffix_dedup.suffix_engine(in_memory=5000).load()(shard)
    finally:
        suffix_array.Store.close = own
    assert got.tolist() == want and used[0][0] > 100_000 and used[0][1] >= 2
    shard, want = pieces_of([t for t in texts if len(t.split()) >= 13], windows.Words())
    assert substrings.fm_engine().load()(shard).tolist() == want
    ids, sigma = substrings.numbered(shard.split)
    text = np.insert(ids, shard.split.starts[1:], 0)
    index = fm_index.FMIndex(text, sigma + 1, 13, np.zeros(len(text), dtype=np.int64))
    assert index.tree.nbytes < len(shard.split.data)
    foreign = np.array([r.choice(ids) if r.random() < 0.1 else x for x in ids.tolist()][:800])
    lo, hi, length = index.matching(foreign, np.array([0, 300]), np.array([300, 800]))
    seen = text.tolist()
    for k in range(800):
        end = 300 if k < 300 else 800
        most = next(n for n in range(min(13, end - k), -1, -1) if n == 0 or any(seen[p : p + n] == foreign[k : k + n].tolist() for p in np.flatnonzero(text == foreign[k]).tolist()))
        assert length[k] == most and hi[k] - lo[k] == sum(seen[p : p + most] == foreign[k : k + most].tolist() for p in np.flatnonzero(text == foreign[k]).tolist())


@pytest.mark.parametrize(("run", "block", "few"), [(3, 4, 0), (7, 16, 4), (1 << 16, 1 << 18, 100)])
def test_suffix_arrays(monkeypatch, run, block, few):
    monkeypatch.setattr(suffix_array, "RUN", run)
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    r = np.random.default_rng(0)
    for n in range(120):
        t = r.integers(1, 2 + (n % 5) * (1 + n % 3 * 20), 1 + n % 60) if n % 3 else np.tile(r.integers(1, 4, 1 + n % 4), 12)
        t = np.append(t, 0)
        with suffix_array.Store((3, 8, 10**6)[n // 2 % 3]) as store:
            order, lcp = (np.asarray(x).tolist() for x in suffix_array.suffix_array(t, store, few))
            folder = store.folder
        assert folder is None or not Path(folder).exists()
        text = list(t)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert lcp[k] == next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))


def alike_stars(seed, n=4):
    """Texts of runs that a number just holds, some of which begin a longer one."""
    r = random.Random(seed)
    return ["".join("bdeeeedcb" + r.choice(["d", "a", "ca"]) for _ in range(r.randint(12, 30))) for _ in range(n)]


def test_suffix_arrays_of_stars_that_begin_longer_ones():
    """A star substring that ends where a number of symbols does stands behind the longer ones that begin like it."""
    for seed in range(12):
        text = [x for t in alike_stars(seed) for x in (*(c + 2 for c in t.encode()), 1)] + [0]
        with suffix_array.Store() as store:
            order, _ = suffix_array.suffix_array(np.array(text), store)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shard, want = pieces_of(alike_stars(seed), windows.Bytes())
        assert suffix_dedup.suffix_engine().load()(shard).tolist() == want


def test_bytes_of_stars_that_begin_longer_ones(spark):
    rows = [(10 * seed + i, t) for seed in (11, 35, 69, 82, 86, 110, 149, 163) for i, t in enumerate(alike_stars(seed))]
    want = [(i, len(s), sum(g), sum(a and not b for a, b in zip(g, [False, *g])), hashlib.sha256(bytes(x for x, y in zip(s, g) if not y)).hexdigest()) for i, s, g in brute_gone(rows, lambda t: t.encode(), 50)]
    out = suffix_dedup.dedup_bytes(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(want)


def test_words_as_they_are():
    """Words of a batch, whatever white space is between them and wherever a text ends."""
    import pyarrow as pa

    texts = [b"", b"a", b" a\n\tb ", b"b", b"\x0c\x0b", b"x" * 40_000 + b" y", b"\xc3\xa9 \xff", b"a  b   c"]
    split = windows.Words().split(pa.array(texts, pa.binary()))
    assert [split.cut(i, i + 1) for i in range(len(split.hashes))] == [w for t in texts for w in t.split()]
    assert np.diff(split.starts).tolist() == [len(t.split()) for t in texts]
    names = {}
    for w, h in zip([w for t in texts for w in t.split()], split.hashes.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


# ---- 3 and 6


def test_language(spark):
    r = random.Random(1)
    words = {"aa": ["kala", "moro", "tuli"], "bb": ["strcz", "prvni", "zbrk"], "cc": ["ouelle", "chemin", "avoir"]}
    rows = [(n, " ".join(r.choice(words[k]) for _ in range(r.randint(4, 60))), k) for n, k in enumerate(list(words) * 40)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "kala moro " * 30_000, None), (None, "avoir chemin ouelle", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(df, language.learn(df.filter(~common.held_out("doc_id")))).collect()
    want = {i: k for i, _, k in rows}
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    for x in out:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert x.lang_pred == {1000: "und", 1001: "und", 1002: "aa"}.get(x.doc_id, want[x.doc_id])
    empty = language.identify(df, language.learn(df.limit(0))).collect()
    assert {x.lang_pred for x in empty} == {"und"} and language.identify(df.limit(0), []).count() == 0


def test_all_languages(spark, monkeypatch):
    """More languages than a block holds, one with many letterless rows and copies: all are learned, and blocks change no result."""
    r = random.Random(3)
    rows = []
    for g in range(70):
        own = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)]
        rows += [(1000 * g + k, " ".join(r.choice(own) for _ in range(60)), f"l{g:02}") for k in range(3)]
        if g == 69:
            rows += [(1000 * g + k, "12 34" if k % 2 else rows[-1][1], "l69") for k in range(10, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learn(df)
    assert sorted(n for n, _ in learned) == [f"l{g:02}" for g in range(70)] and learned[0][0] == "l69"
    assert len(learned[0][1]) < 4 * 60 * 7
    none = spark.createDataFrame([(i, "." * 9000 + "ab cd", "x") if i == 150 else (i, "7 8", "x") for i in range(300)], "doc_id long, text string, lang string")
    assert language.learn(none) == [("x", b"ab cd")]
    whole = spark.createDataFrame([(1, "a " * 5000 + "zebra", "x"), (2, "b " * 300_000, "y")], "doc_id long, text string, lang string")
    assert [(n, d[-5:], len(d)) for n, d in language.learn(whole)] == [("x", b"zebra", 10_005), ("y", b" b b ", language.DICTIONARY)]
    asked = df.filter("doc_id % 1000 < 3").union(spark.createDataFrame([(None, None, None), (5, "", None), (6, "a", None)], df.schema))
    got = sorted(map(str, language.identify(asked, learned).collect()))
    c = language.Classifier(learned)
    want = [(i, *c.predict(t)) for i, t in [(x.doc_id, x.text) for x in asked.collect()]]
    assert sum(p == f"l{i // 1000:02}" for i, p, _, _ in want if i is not None and i >= 1000) >= 200
    monkeypatch.setattr(language, "LANGUAGES", 200)
    assert sorted(map(str, language.identify(asked, learned).collect())) == got
    for text in ["a", rows[0][1], rows[9][1][:20]]:
        sizes = c.sizes(text.encode())
        best, score = min(sizes), c.predict(text)[1]
        assert score == pytest.approx(1 / sum(2.0 ** (-4 * min(8, s - best)) for s in sizes))


def test_quality(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "of", "thing", "mere", "and"]) + r.choice([".", ",", "", ""]) for _ in range(r.randint(15, 80)))
    bad = lambda: " ".join(r.choice(["x", "ZZ"]) + "***" for _ in range(r.randint(15, 80)))
    rows = [(n, bad() if n % 4 == 0 else good()) for n in range(400)] + [(900, None), (901, ""), (902, "word " * 100_000), (None, "mere thing")]
    labels = spark.createDataFrame([(n, int(n % 4 != 0)) for n in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {x.doc_id: x for x in quality.quality_scores(docs(spark, rows), labels).collect()}
    held = [x for i, x in out.items() if i is not None and i < 400 and x.held_out]
    assert len(out) == len(rows) and sum(x.predicted == int(x.doc_id % 4 != 0) for x in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out.values())
    kept = quality.accepted(docs(spark, rows), labels)
    assert {x.doc_id for x in kept.collect()} == {i for i, x in out.items() if x.predicted}
    none = quality.quality_scores(docs(spark, rows[:3]), labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5} and quality.quality_scores(docs(spark, rows).limit(0), labels).count() == 0


def test_quality_by_a_direct_solution(spark):
    """Weights as a dense solution has them, calibration by folds as loops over rows have it, fits under a bound, ties at the threshold."""
    r = random.Random(4)
    rows = [(n, " ".join(r.choice(["ab", "Cd.", "e1", "x!"]) for _ in range(r.randint(1, 30)))) for n in range(300)]
    rows += [(5, rows[5][1]), (5, "another text"), (None, "x")]
    known = [(n, int(len(t) % 3 > 0)) for n, t in rows[:300]] + [(7, 0), (9, None)]
    model = quality.fit(docs(spark, rows), spark.createDataFrame(known, "doc_id long, quality int"))
    table = spark.createDataFrame([(n,) for n in range(300)], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id, {quality.SEED + 1}), {quality.FOLDS}) AS fold").collect()
    fold = {x.doc_id: x.fold for x in table}
    used = [(quality.statistics(t.encode()), y, fold[n]) for n, t in rows if n is not None and zlib.crc32(str(n).encode()) % 5 for k, y in known if k == n and y is not None]
    x, y, f = (np.array(c) for c in zip(*used))
    assert model.mean == pytest.approx(x.mean(axis=0))
    z = model.features(x)
    solve = lambda own: np.linalg.lstsq(np.vstack([z[own], np.diag(np.sqrt([*[quality.RIDGE] * quality.FEATURES, 1e-6]))]), np.append(y[own], np.zeros(quality.FEATURES + 1)), rcond=None)[0]
    assert model.weights == pytest.approx(solve(f >= 0), abs=1e-6)
    raw = np.array([z[i] @ solve(f != f[i]) for i in range(len(y))])
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at.tolist()))
    weight = np.array([(at == k).sum() + 1.0 for k in bins])
    share = np.array([(y[at == k].sum() + y.mean()) / w for k, w in zip(bins, weight)])
    # isotonic regression by its minimax form
    mean = lambda a, z: (share[a : z + 1] * weight[a : z + 1]).sum() / weight[a : z + 1].sum()
    fitted = [max(min(mean(a, z) for z in range(k, len(bins))) for a in range(k + 1)) for k in range(len(bins))]
    assert model.values == pytest.approx(fitted) and model.knots == pytest.approx((np.array(bins) + 0.5) / quality.BINS * 2 - 0.5)
    some = quality.fit(docs(spark, rows), spark.createDataFrame(known, "doc_id long, quality int"), most=60)
    assert some.weights is not None and not np.allclose(some.weights, model.weights)
    tied = quality.Model(model.mean, model.scale, None, np.array([0.0]), np.array([0.3]))
    assert {(x.score, x.predicted) for x in quality.score(docs(spark, rows), tied).collect()} == {(0.3, 1)} and quality.score(docs(spark, rows), tied).count() == len(rows)


def test_language_by_plain_compression(spark):
    """Repeated rows, ties, empty texts and clashing columns; sizes as plain calls of the library have them."""
    import zstandard

    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["uno", "dos", "tres"] if k % 2 else ["eins", "zwei", "drei"]) for _ in range(1 + k % 9)), "es" if k % 2 else "de") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learn(df)
    asked = rows + [(1, rows[1][1], "de"), (1, rows[1][1], "de"), (90, "", None), (91, "q", None), (92, "dos " * 9000, None)]
    got = sorted((x.doc_id, x.lang_pred) for x in language.identify(docs(spark, [a[:2] for a in asked]), learned).collect())
    want = []
    for i, t, _ in asked:
        data = language.letters(t).encode()
        totals = []
        for place, (name, dictionary) in enumerate(learned):
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            size = sum(len(c.compress(data[a : a + language.BLOCK])) for a in range(0, len(data), language.BLOCK))
            totals.append((size, -sum(w in dictionary.split() for w in data.split()), place, name))
        want.append((i, min(totals)[3] if data else "und"))
    assert got == sorted(want)


def test_pooling():
    assert quality.pooled(np.array([1.0, 0, 2, 2, 1]), np.array([2.0, 2, 2, 4, 2])).tolist() == pytest.approx([0.25, 0.25, 0.625, 0.625, 0.625])


# ---- 7


def plain_fingerprint(text):
    """Sums over a text's pieces, added up piece by piece in numbers of any size."""
    wide, signs = [0] * 4, [0] * 256
    for p in fingerprints.pieces(text):
        d = hashlib.blake2b(p.encode(), digest_size=64).digest()
        for k in range(4):
            wide[k] += int.from_bytes(d[32 + 8 * k : 40 + 8 * k], "little")
        for k in range(256):
            signs[k] += 1 if d[k // 8] >> (7 - k % 8) & 1 else -1
    return wide, signs


def plain_hex(f):
    return "".join(f"{x % 2**64:016x}" for x in f[0]) + "".join(f"{x % 2**32:08x}" for x in f[1])


def plain_likeness(f, g):
    if f == g:
        return 1.0
    whole = sum(x * x for x in f[1]) + sum(x * x for x in g[1])
    return max(0.0, min(1.0, 1.0 - sum((x - y) ** 2 for x, y in zip(f[1], g[1])) / whole)) if whole else 0.0


def test_fingerprints(spark):
    rows = [(i, t if t is None or len(t) < 5000 else t[:4000]) for i, t in corpus(4)]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), (r[1] or "").encode()))
    want = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        f, e, x = (plain_fingerprint(s) for s in (t, edited, nxt))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_hex(f), plain_hex(e), plain_likeness(f, e), plain_likeness(f, x)))
    out = fingerprints.edited_fingerprints(docs(spark, rows))
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, out.collect()))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in sorted(want)]
    assert fingerprints.edited_fingerprints(docs(spark, rows).limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(docs(spark, [(3, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(docs(spark, [(1, "a b.\nc"), (2, "c\na b."), (3, None)])).collect()}
    assert plain[1] == plain[2] and set(plain[3]) == {"0"}
    a, b = fingerprints.fingerprint(["x", "y"]), fingerprints.fingerprint(["y"])
    assert a - b == fingerprints.fingerprint(["x"]) and b + fingerprints.fingerprint(["x"]) == a


def test_next_documents_over_many_ranges(spark):
    """Each document's next one, with more ids than ranges and gaps between them."""
    rows = [(7 * k - 3000, f"text {k}") for k in range(900)]
    out = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(docs(spark, rows, 7)).collect()}
    for (i, t), (_, before) in zip(rows, [rows[-1], *rows[:-1]]):
        half = len(t) // 2
        assert out[i] == hashlib.sha256((t[: len(t) - half] + before[:half]).encode()).hexdigest()


def test_likeness_of_repeated_lines():
    """Lines repeated more often than a small lane holds: other texts have other fingerprints, and likeness is the true overlap."""
    a = "a line\n" * 100_000
    mark = lambda text: fingerprints.fingerprint(fingerprints.pieces(text))
    assert mark("a line\n" * 65_536) != mark("") and mark("a line\n" * (1 << 17)) != mark("a line\n" * (1 << 16))
    assert fingerprints.likeness(mark(a), mark("")) == 0.0
    assert fingerprints.likeness(mark("x\n" * 40_000), mark("x\n" * 30_000)) == pytest.approx(1 - 1 / 25, abs=1e-9)
    r = random.Random(2)
    lines = [f"line {k} {r.random()}" for k in range(3000)]
    for n in (300, 1500, 2700):
        shared = fingerprints.likeness(mark("\n".join(lines[:2000])), mark("\n".join(lines[2000 - n // 2 : 4000 - n // 2])))
        own = len(lines[2000 - n // 2 : 4000 - n // 2])
        assert shared == pytest.approx(2 * (n // 2) / (2000 + own), abs=0.15)


# ---- 8


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.word_vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(1)
    odd = ["".join(r.choice("aAbetT'sS12 .,\n\t\x1c\x85é́ñΣİ日本😀-_") for _ in range(60)) for _ in range(300)]
    odd += ["<|endoftext|>a<|startoftext|> B <|ENDOFTEXT|>", "it's 'RE x'LL", "aa" * 5000, "a" * 63, "b" * 64, "c" * 65, "", None, "ΑΣ ΟΔΟΣ"] + [t for _, t in corpus(6)]
    out = {r_.doc_id: r_ for r_ in bpe.token_digests(docs(spark, list(enumerate(odd))), path).collect()}
    ids = bpe.encode_documents(docs(spark, list(enumerate(odd))), path)
    decoded = {x.doc_id: x.text for x in bpe.decode_documents(ids, path).collect()}
    ids = {x.doc_id: x.ids for x in ids.collect()}
    v = bpe.Vocabulary(path)
    for n, t in enumerate(odd):
        e = library.encode(t or "", add_special_tokens=False).ids
        d = library.decode(e, skip_special_tokens=False)
        assert (ids[n], decoded[n]) == (e, d)
        assert (out[n].n_tokens, out[n].ids_sha256, out[n].decoded_sha256) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
    # all code points that are assigned but for private ones, with a blank or a letter on either side; repeated rows
    points = "".join(chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co"))
    texts_ = [" ".join(points[a : a + 2000]) for a in range(0, len(points), 2000)] + ["a" + "b".join(points[a : a + 2000]) for a in range(0, 20_000, 2000)]
    many = {x.doc_id: x.ids for x in bpe.encode_documents(docs(spark, list(enumerate(texts_)), 8), path).collect()}
    differ = sum(many[n] != library.encode(t, add_special_tokens=False).ids for n, t in enumerate(texts_))
    assert differ == 0
    assert len({x.ids_sha256 for x in bpe.token_digests(docs(spark, [(1, "ab"), (1, "ab"), (2, "ab")]), path).collect()}) == 1
    words = [w for t in odd for w in v.words.findall(v.normal(t or ""))]
    assert v.merge_many(words) == [v.merge(w) for w in words]
    assert bpe.token_digests(docs(spark, [(1, "a")]).limit(0), path).count() == 0


# ---- 9


def test_urls(spark):
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "EXAMPLE.ORG", "x.com", "com", "net", ""]
    paths = ["/es/x", "/en/1", "/en/12?q=/de/", "/fr/", "/de/#f", "", "?x", "/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/d"]
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*url_filters.RULES, (None, "/", "block")], "host string, path string, verdict string")
    out = url_filters.filter_urls(pages, rules).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fits)[1:] if fits else (None, "allow")))
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0
    # equal rules with two verdicts, rules of one length, a very long url and many pages of one host over several ranges
    odd = spark.createDataFrame([("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("b", "/x/y/", "allow"), ("c.a.b", "", "allow")], "host string, path string, verdict string")
    asked = [(1, "h://a.b/x/y/z"), (2, "h://c.a.b/x"), (3, "h://a.b/" + "x" * 2_000_000), (4, "h://q.b/x/y/")] + [(10 + k, f"h://a.b/x{k}") for k in range(3000)]
    got = {x.page_id: (x.rule, x.verdict) for x in url_filters.filter_urls(spark.createDataFrame(asked, "page_id long, url string"), odd).collect()}
    assert (got[1], got[2], got[3], got[4]) == (("b/x/y/", "allow"), ("c.a.b", "allow"), ("a.b/x", "block"), ("b/x/y/", "allow"))
    assert {got[10 + k] for k in range(3000)} == {("a.b/x", "block")}


# ---- 10


def edit_distance(p, t):
    prev = [0] * (len(t) + 1)
    for a in p:
        cur = [prev[0] + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_contamination(spark):
    r = random.Random(2)
    items = [(n, "".join(r.choice("abcdefgh ") for _ in range(r.randint(12, 160)))) for n in range(25)] + [(50, "short"), (51, ""), (52, None), (None, "abcdefgh" * 4), (53, "ab " * 30)]
    rows = []
    for n in range(80):
        t = "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 120)))
        if n % 2:
            p = list(r.choice(items[:25])[1])
            for _ in range(r.randint(0, 12)):
                p[r.randrange(len(p))] = r.choice(["", "x", "yz"])
            t += "".join(p).upper().replace(" ", " \n") + "tail"
        rows.append((n, t))
    rows += [(500, None), (501, ""), (502, "x " * 600_000 + items[3][1]), (None, items[4][1]), (503, items[5][1]), (503, items[5][1]), (504, "a Short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(x.doc_id), x.item_id, x.edits) for x in decontaminate.contamination(docs(spark, rows), bench, block=500).collect())
    want = []
    for i, t in rows:
        t = decontaminate.normal((t or "").encode())
        for k, p in items:
            p = decontaminate.normal((p or "").encode())
            if k is not None and p:
                if len(t) > 10_000:
                    d = 0 if p in t else 99
                else:
                    d = edit_distance(p, t) if len(p) >= decontaminate.GRAM else (0 if p in t else 99)
                if d <= decontaminate.edits_within(p):
                    want.append((str(i), k, d))
    assert got == sorted(want) and len(want) > 25
    many = decontaminate.contamination(docs(spark, rows), bench, block=80).collect()  # some fifty blocks
    assert sorted((str(x.doc_id), x.item_id, x.edits) for x in many) == got
    clean = decontaminate.uncontaminated(docs(spark, rows), bench, block=500)
    assert sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(i) for i, _ in rows if str(i) not in {w[0] for w in want})
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).count() == 0


def test_rulers():
    """Repetitive items against repetitive texts: bands as counting all shared q-grams has them, in bounded memory."""
    r = random.Random(3)
    part = lambda: r.choice([b"-" * r.randint(1, 60), b"=-" * r.randint(1, 30), b"abc" * r.randint(1, 20), bytes(r.choice(b"abcdef ") for _ in range(r.randint(1, 40)))])
    text_of = lambda n: b"".join(part() for _ in range(n))
    before = decontaminate.PAIRS, decontaminate.PART
    try:
        for n in range(60):
            decontaminate.PAIRS, decontaminate.PART = r.choice([1, 7, 1 << 20]), r.choice([30, 100, 1 << 20])
            items, text = [text_of(r.randint(1, 4)) for _ in range(4)], text_of(r.randint(1, 8))
            text = text[:20] + items[0] + text[20:] if n % 2 else text
            patterns = decontaminate.Patterns(list(range(4)), items, r.choice([0.08, 0.02]))
            grams, want = decontaminate.gram_hashes(np.frombuffer(text, np.uint8)).tolist(), {}
            for i, p in enumerate(items):
                for q, y in enumerate(decontaminate.gram_hashes(np.frombuffer(p, np.uint8)).tolist()):
                    for t, x in enumerate(grams):
                        if x == y:
                            for b in ((t - q) // int(patterns.band[i]), (t - q) // int(patterns.band[i]) - 1):
                                want[i, b] = want.get((i, b), 0) + 1
            assert patterns.regions(text) == {k for k, c in want.items() if c >= patterns.need[k[0]]}
    finally:
        decontaminate.PAIRS, decontaminate.PART = before
    for item, text in ((b"-" * 400, b"-" * 40_000), (b"-" * 8000, b"-" * 1_000_000), (b"ab" * 4000, b"ab" * 500_000)):
        patterns = decontaminate.Patterns([0], [item])
        assert patterns.search(text)[0][:3] == (0, 0, 0)
        assert sum(len(x[0]) for x in patterns.shared(np.frombuffer(text, np.uint8)[: 1 << 20], 0)) < 200_000


def best_region(p, t, most):
    """Fewest edits, then the leftmost stop, then the latest start, by the whole table."""
    prev = [(0, -j) for j in range(len(t) + 1)]
    for i, a in enumerate(p):
        cur = [(i + 1, 0)]
        for j, b in enumerate(t):
            cur.append(min((prev[j][0] + (a != b), prev[j][1]), (prev[j + 1][0] + 1, prev[j + 1][1]), (cur[-1][0] + 1, cur[-1][1])))
        prev = cur
    k = min(range(len(t) + 1), key=lambda j: (prev[j][0], j))
    return (prev[k][0], -prev[k][1], k) if prev[k][0] <= most else None


def test_near_copies_in_repetitive_texts():
    r = random.Random(5)
    part = lambda: r.choice([b"-" * r.randint(1, 60), b"=-" * r.randint(1, 30), b"abc" * r.randint(1, 20), bytes(r.choice(b"abcdef ") for _ in range(r.randint(1, 40)))])
    text_of = lambda n: b"".join(part() for _ in range(n))
    before, near = decontaminate.PART, 0
    try:
        for _ in range(40):
            decontaminate.PART = r.choice([30, 100, 1 << 20])
            items = [text_of(r.randint(1, 8)) for _ in range(3)]
            edited = bytearray(items[0])
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(edited) + 1)
                edited[k : k + r.randint(0, 2)] = bytes(r.choice(b"-=abx") for _ in range(r.randint(0, 2)))
            text = text_of(r.randint(0, 5)) + bytes(edited) + text_of(r.randint(0, 5))
            patterns = decontaminate.Patterns([0, 1, 2], items, r.choice([0.08, 0.04]))
            found = [(i, best_region(p, text, int(patterns.budget[i]))) for i, p in enumerate(items)]
            assert patterns.search(text) == [(i, *best) for i, best in found if best]
            near += sum(best is not None and best[0] > 0 for _, best in found)
    finally:
        decontaminate.PART = before
    assert near > 10


def test_alignment_of_long_patterns():
    """Windows that move on with the pattern, at the ends of the text too."""
    r = random.Random(6)
    for _ in range(12):
        p = bytes(r.choice(b"ab") for _ in range(r.randint(300, 1200)))
        edited = bytearray(p)
        for _ in range(r.randint(0, 20)):
            k = r.randrange(len(edited))
            edited[k : k + r.randint(0, 2)] = b"a" * r.randint(0, 2)
        off = r.randint(0, 40)
        text = bytes(r.choice(b"ab") for _ in range(off)) + bytes(edited) + b"ba" * r.randint(0, 20)
        assert decontaminate.align(p, text, off - 50, off + 50, 45) == best_region(p, text, 45)
    assert decontaminate.align(b"a" * 900, b"b" * 900, -50, 50, 45) is None
    assert decontaminate.align(b"abc", b"", -5, 5, 3) == (3, 0, 0)


@pytest.mark.parametrize(
    ("item", "text", "edits"),
    [(b"-" * 400 + b"end", b"-" * 1_000_000, 3), (b"=-" * 200 + b"fin", b"=-" * 500_000, 3), (b"twenty bytes phrase " * 40 + b"two words", b"twenty bytes phrase " * 2000, 7)],
)
def test_near_rulers_in_one_alignment(item, text, edits, monkeypatch):
    calls, real = [], decontaminate.align
    monkeypatch.setattr(decontaminate, "align", lambda *x: calls.append(x) or real(*x))
    got = decontaminate.Patterns([0], [item]).search(text)
    assert len(got) == 1 and got[0][1] == edits and len(calls) <= 2
