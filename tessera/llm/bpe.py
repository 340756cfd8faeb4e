"""BPE encoding and decoding with a public word-level vocabulary, by a segment tree over adjacent pair ranks.

Leaf i of a word's tree holds the rank of the pair that starts at symbol i, with i for the tie, so the root is the leftmost
pair of the lowest rank. A merge changes three leaves, each by one walk to the root, so a word of n symbols takes n log n
steps however long it is. The words that a batch brings for the first time are merged in lockstep, one tree a row; long
ones one by one. Words repeat, so each worker keeps a bounded number of encoded ones.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, documents, long_rows, schema_of, texts

#: Encoded words that a worker keeps, and the longest that it keeps; bytes of the longest word that is merged in lockstep.
KEPT_WORDS, KEPT_LENGTH, LOCKSTEP = 400_000, 48, 64
#: Characters whose new words are merged together.
GROUP = 1_000_000
#: White space as the vocabulary's own rules have it is the Unicode property, without these that Python splits at too.
_NO_SPACE = regex.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
#: ASCII punctuation that the word pattern takes as one run; an apostrophe may start a word of its own.
_TAIL = string.punctuation.replace("'", "")
_NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Token ids as decimal text, their number, and their decoded text.
Entry = tuple[str, int, str]


class PairTree:
    """A minimum segment tree over keys (rank, place)."""

    def __init__(self, keys: list[int]) -> None:
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.keys = [_NONE] * self.size + keys + [_NONE] * (self.size - len(keys))
        t = self.keys
        for i in range(self.size - 1, 0, -1):
            t[i] = min(t[2 * i], t[2 * i + 1])

    def least(self) -> int:
        return self.keys[1]

    def set(self, place: int, key: int) -> None:
        t, i = self.keys, place + self.size
        t[i] = key
        i >>= 1
        while i:
            new = min(t[2 * i], t[2 * i + 1])
            if t[i] == new:
                break
            t[i] = new
            i >>= 1


class Vocabulary:
    """A word-level BPE vocabulary file: its normaliser, word pattern, merges and special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.decimal = {i: str(i) for i in self.tokens}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.symbols = byte_symbols()
        self.kept: dict[str, Entry] = {}  # by word of the pattern
        self.chunks: dict[str, Entry] = {}  # by what stands between white space
        self.old_kept: dict[str, Entry] = {}
        self.old_chunks: dict[str, Entry] = {}
        ranked = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pair_keys, self.pair_ranks = (np.array(x, dtype=np.int64) for x in zip(*ranked, strict=True))
        self.merged = np.array([self.ids[a + b] for a, b in model["merges"]], dtype=np.int64)
        self.base = np.array([self.ids[s] for s in self.symbols], dtype=np.int64)
        self.base_end = np.array([self.ids[s + self.suffix] for s in self.symbols], dtype=np.int64)

    @staticmethod
    def normal(text: str) -> str:
        """NFC in lower case, each character by itself, so a sigma at a word's end has no form of its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[int]:
        """Token ids of one word of the pattern."""
        parts = [self.symbols[b] for b in word.encode("utf-8")]
        parts[-1] += self.suffix
        out = [self.ids[p] for p in parts]
        n, merges = len(out), self.merges
        if n == 1:
            return out
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int) -> int:
            j = following[i]
            found = merges.get((out[i], out[j])) if j < n else None
            return _NONE if found is None else found[0] << 32 | i

        tree = PairTree([key(i) for i in range(n - 1)])
        while (least := tree.least()) < _NONE:
            i = least & 0xFFFFFFFF
            j = following[i]
            out[i] = merges[out[i], out[j]][1]
            following[i] = after = following[j]
            if after < n:
                before[after] = i
                tree.set(j, _NONE)
            elif j < n - 1:
                tree.set(j, _NONE)
            tree.set(i, key(i))
            if before[i] >= 0:
                tree.set(before[i], key(before[i]))
        ids, i = [], 0
        while i < n:
            ids.append(out[i])
            i = following[i]
        return ids

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Token ids of many words: trees of one size in lockstep, a row for each word."""
        data = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        out: list[list[int]] = [[]] * len(words)
        for n in (2, 4, 8, 16, 32, LOCKSTEP):
            rows = np.flatnonzero((sizes <= n) & (sizes > (n // 2 if n > 2 else 0)))
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                for i, ids in zip(part.tolist(), self._lockstep([data[i] for i in part.tolist()], sizes[part], n), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > LOCKSTEP).tolist():
            out[i] = self.merge(words[i])
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, as many as there are merges for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.pair_ranks))

    def _lockstep(self, data: list[bytes], size: np.ndarray, n: int) -> list[list[int]]:
        w, none = len(data), len(self.pair_ranks) * LOCKSTEP
        held = np.arange(n)[None, :] < size[:, None]
        raw = np.zeros((w, n), dtype=np.int64)
        raw[held] = np.frombuffer(b"".join(data), dtype=np.uint8)
        ids = self.base[raw]
        row = np.arange(w)
        ids[row, size - 1] = self.base_end[raw[row, size - 1]]
        following = np.tile(np.arange(1, n + 1), (w, 1))
        before = np.tile(np.arange(-1, n - 1), (w, 1))
        leaves = np.full((w, n), none, dtype=np.int64)
        pair = held[:, 1:]
        r, c = np.nonzero(pair)
        leaves[r, c] = np.minimum(self._pairs(ids[r, c], ids[r, c + 1]) * LOCKSTEP + c, none)
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))

        def put(rows: np.ndarray, place: np.ndarray) -> None:
            for low, high in zip(levels[:-1], levels[1:], strict=True):
                place = place >> 1
                high[rows, place] = np.minimum(low[rows, 2 * place], low[rows, 2 * place + 1])

        while len(a := np.flatnonzero(levels[-1][:, 0] < none)):
            least = levels[-1][a, 0]
            i = least % LOCKSTEP
            j = following[a, i]
            ids[a, i] = self.merged[least // LOCKSTEP]
            held[a, j] = False
            after = following[a, j]
            following[a, i] = after
            leaves[a, j] = none
            more = after < size[a]
            before[a[more], after[more]] = i[more]
            leaves[a, i] = none
            leaves[a[more], i[more]] = np.minimum(self._pairs(ids[a[more], i[more]], ids[a[more], after[more]]) * LOCKSTEP + i[more], none)
            p = before[a, i]
            less = p >= 0
            leaves[a[less], p[less]] = np.minimum(self._pairs(ids[a[less], p[less]], ids[a[less], i[less]]) * LOCKSTEP + p[less], none)
            put(a, j)
            put(a, i)
            put(a[less], p[less])
        flat, ends = ids[held].tolist(), np.cumsum(held.sum(axis=1)).tolist()
        return [flat[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def _entry(self, ids: list[int]) -> Entry:
        return " ".join([self.decimal[i] for i in ids]), len(ids), " ".join([self.tokens[i] for i in ids])

    def _words(self, words: Iterable[str]) -> None:
        """Encode the words that aren't kept, all at once."""
        new = []
        for w in words:
            if w not in self.kept:
                if (old := self.old_kept.get(w)) is not None:
                    self.kept[w] = old
                else:
                    new.append(w)
        self.kept.update(zip(new, map(self._entry, self.merge_many(new)), strict=True))

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks between white space that aren't kept."""
        missing = []
        for c in chunks:
            if c not in self.chunks:
                if (old := self.old_chunks.get(c)) is not None:
                    self.chunks[c] = old
                else:
                    missing.append(c)
        words: list[Sequence[str]] = []
        for c in missing:  # most are letters, or letters and punctuation
            w = c.rstrip(_TAIL)
            words.append(((c,) if len(w) == len(c) else (w, c[len(w) :])) if w.isalpha() else self.words.findall(c))
        self._words(set().union(*words))
        kept, chunks = self.kept, self.chunks
        for c, ws in zip(missing, words, strict=True):
            if len(ws) == 1:
                chunks[c] = kept[ws[0]]
            elif len(ws) == 2:
                (a, m, x), (b, n, y) = kept[ws[0]], kept[ws[1]]
                chunks[c] = (f"{a} {b}", m + n, f"{x} {y}")
            else:
                found = [kept[w] for w in ws]
                chunks[c] = (" ".join([f[0] for f in found]), sum([f[1] for f in found]), " ".join([f[2] for f in found]))

    def forget(self) -> None:
        """Keep what is recent and not too long: what fills up becomes the older half."""
        if len(self.kept) > KEPT_WORDS // 2:
            self.old_kept, self.kept = {w: e for w, e in self.kept.items() if len(w) <= KEPT_LENGTH}, {}
        if len(self.chunks) > KEPT_WORDS // 2:
            self.old_chunks, self.chunks = {w: e for w, e in self.chunks.items() if len(w) <= KEPT_LENGTH}, {}

    def _split(self, text: str) -> list[str | int]:
        """Chunks between white space, and the ids of special strings."""
        if self.specials is None or "<|" not in text:
            text = self.normal(text)
            return text.split() if not _NO_SPACE.search(text) else [x for x in _SPACE.split(text) if x]
        out: list[str | int] = []
        at = 0
        for m in [*self.specials.finditer(text), None]:
            plain = self.normal(text[at : m.start()] if m else text[at:])
            out += [x for x in _SPACE.split(plain) if x]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def entries(self, texts: Iterable[str]) -> Iterator[list[Entry]]:
        """For each text its chunks and special strings, in order; texts are taken about ``GROUP`` characters at a time."""
        group: list[list[str | int]] = []
        size = 0
        for t in texts:
            group.append(self._split(t))
            size += len(t)
            if size > GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str | int]]) -> Iterator[list[Entry]]:
        self.forget()
        seen = set().union(*group)
        special = {x for x in seen if isinstance(x, int)}
        self.learn(seen - special)
        kept = self.chunks | {i: (str(i), 1, self.tokens[i]) for i in special} if special else self.chunks
        for chunks in group:
            yield [kept[c] for c in chunks]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in next(self.entries([text])) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones included; ids without a token are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


_TOKENS = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
_DIGESTS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for each row. A null text is empty, an empty one has no tokens, repeated rows repeat,
    a null id stays null, an empty table gives no rows, and other columns aren't read."""
    long_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield batch([(i, v.encode(x.decode("utf-8", "replace"))) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], _TOKENS)

    return texts(docs, doc_id, text).mapInArrow(run, schema_of(_TOKENS))


def decode_documents(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` from arrays of token ids; a null array decodes to an empty text."""
    fields = [("doc_id", pa.int64()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield batch([(i, v.decode(x or [])) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], fields)

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, schema_of(fields))


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, encoded and decoded in one pass over the words; see
    ``encode_documents`` for nulls and repeats."""
    long_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            out = []
            plain = (x.as_py().decode("utf-8", "replace") for x in b.column(1))
            for i, entries in zip(b.column(0).to_pylist(), v.entries(plain), strict=True):
                ids, decoded = " ".join([e[0] for e in entries]), " ".join([e[2] for e in entries])
                out.append((i, sum([e[1] for e in entries]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield batch(out, _DIGESTS)

    return texts(docs, doc_id, text).mapInArrow(run, schema_of(_DIGESTS))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), word_vocabulary())
