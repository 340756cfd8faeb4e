"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is gathered from labelled documents: whole texts, drawn by a hash of
their content, up to a bounded number of bytes. A text is normalised to lower-case letters and single spaces and compressed in
blocks, each against every dictionary, so a long text is judged by all of it. The smallest total wins; where it isn't smaller
than the second by a given share, the prediction is marked as rejected. Sizes are whole bytes and may tie, mostly those of
short texts: ties go to the language whose dictionary holds more of the text's words, then to the one with more documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, documents, held_out, long_rows, saved, schema_of

#: Bytes of a dictionary, the one bound on what is learned of a language, and about how many distinct texts are drawn for it.
DICTIONARY, DRAWN = 192 << 10, 400
#: Dictionaries that are held at a time; of more languages, each block of so many is one pass over the texts.
LANGUAGES = 64
#: Bytes that are compressed at a time; the margin, as a share of the second smallest size, below which a text is rejected.
BLOCK, MARGIN, LEVEL = 4096, 0.01, 3
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


def learning(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Iterator[tuple[str, bytes]]:
    """All languages with their dictionaries, most frequent first, from the rows with an id, a text and a language; LANGUAGES
    of them are gathered at a time.

    A language's texts are drawn among its distinct ones that have letters, by a hash that is below a bound which lets about
    DRAWN of them through (all, if there are fewer), and go whole into the dictionary, one after the other, until it is full.
    """
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("doc_id is not null and lang is not null")
    lettered = named.withColumn("same", F.when(F.col("text").rlike(r"\p{L}"), F.xxhash64("text")))
    counts = lettered.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("same", 0.02).alias("texts")).orderBy(F.desc("n"), "lang").collect()  # one row for each language

    @F.pandas_udf("binary")
    def head(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: letters(x).encode()[:DICTIONARY])

    for block in batched(counts, LANGUAGES):
        bounds = F.create_map(*(F.lit(x) for r in block for x in (r.lang, min(1.0, DRAWN / max(1, r.texts)))))
        drawn = lettered.filter(F.col("lang").isin([r.lang for r in block])).filter(F.pmod("same", F.lit(1 << 20)) < F.lit(1 << 20) * F.element_at(bounds, F.col("lang")))
        # about DRAWN texts a language, of each DICTIONARY bytes at most, and those that the dictionary has room for
        distinct = drawn.groupBy("lang", "same").agg(F.first("text").alias("text")).select("lang", "same", head("text").alias("letters"))
        before = F.sum(F.length("letters")).over(Window.partitionBy("lang").orderBy("same").rowsBetween(Window.unboundedPreceding, -1))
        gathered: dict[str, list[bytes]] = {}
        for r in distinct.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < DICTIONARY).orderBy("lang", "same").collect():
            gathered.setdefault(r.lang, []).append(bytes(r.letters))
        yield from ((r.lang, b" ".join(gathered[r.lang])[:DICTIONARY]) for r in block if any(gathered.get(r.lang, [])))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """``learning`` as a list."""
    return list(learning(docs, doc_id, text, lang))


class Classifier:
    def __init__(self, learned: list[tuple[str, bytes]]) -> None:
        self.names = [n for n, _ in learned]
        self.coders = []
        for _, data in learned:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        self.words = [frozenset(data.split()) for _, data in learned]

    def sizes(self, data: bytes) -> list[int]:
        totals = [0] * len(self.coders)
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            for k, c in enumerate(self.coders):
                totals[k] += len(c.compress(block))
        return totals

    def measured(self, data: bytes, state: tuple | None = None, first: int = 0, alone: bool = True) -> tuple | None:
        """``state`` with these languages added, the first of which is the ``first`` of all, and which are ``alone`` if there are no others: the best one's size, known words
        (negative), place and name, the second size, and how many sizes are 0 to 7 bytes over the best or more."""
        if not data or not self.coders:
            return state
        sizes = self.sizes(data)
        # known words only matter between the smallest sizes, of these languages and perhaps of others to come
        least, known = min(sizes), [0] * len(sizes)
        tied = [k for k, size in enumerate(sizes) if size == least]
        if not (alone and len(tied) == 1):
            for w in data.split():
                for k in tied:
                    known[k] += w in self.words[k]
        for k, size in enumerate(sizes):
            mine = (size, -known[k], first + k)
            if state is None:
                state = (*mine, self.names[k], None, [1] + [0] * 8)
                continue
            *best, name, second, near = state
            if size < best[0]:
                by, near = best[0] - size, list(near)
                near = [1] + [near[o - by] if o >= by else 0 for o in range(1, 8)] + [sum(near[max(0, 8 - by) :])]
            else:
                near = [n + (o == min(8, size - best[0])) for o, n in enumerate(near)]
            state = (*mine, self.names[k], best[0], near) if mine < tuple(best) else (*best, name, size if second is None else min(second, size), near)
        return state

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a confidence from 0 to 1, and whether it is rejected for its narrow margin."""
        return verdict(self.measured(letters(text or "").encode()))


def verdict(state: tuple | None) -> tuple[str, float, bool]:
    if state is None:
        return "und", 0.0, True
    best, _, _, name, second, near = state
    if second is None:
        return name, 1.0, False
    # bits saved, against chance: even for a tie, close to one for a clear win
    return name, 1.0 / math.fsum(n * 2.0 ** (-4.0 * o) for o, n in enumerate(near)), (second - best) / second < MARGIN


_STATE = [("best", pa.int64()), ("known", pa.int64()), ("place", pa.int64()), ("name", pa.string()), ("second", pa.int64()), ("near", pa.list_(pa.int64()))]
_FIELDS = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]


def identify(docs: DataFrame, learned: Iterable[tuple[str, bytes]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for each row; only the text is looked at.

    Texts that are null or have no letter, and all texts where nothing was learned, are ``und`` with score 0 and rejected.
    Repeated rows repeat, a null id is not held out, an empty table gives no rows, and other columns aren't read.
    """
    long_rows(docs.sparkSession)

    def run(block: list[tuple[str, bytes]], first: int, fields: list, last: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = Classifier(block)
            for b in batches:
                before = list(zip(*(b.column(k).to_pylist() for k in range(3, 9)), strict=True)) if first else [(None,)] * len(b)
                out = []
                for i, h, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), before, strict=True):
                    state = c.measured(letters(t.as_py() or "").encode(), None if s[0] is None else s, first, last and not first)
                    out.append((i, h, *verdict(state)) if last else (i, h, t.as_py(), *(state or (None,) * 6)))
                yield batch(out, fields)

        return step

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id).cast("long")).alias("held_out"), F.col(text).cast("string").alias("text"))
    held, first = None, 0
    between = [*_FIELDS[:2], ("text", pa.string()), *_STATE]
    for block in batched(learned, LANGUAGES):
        if held is not None:
            rows = saved(rows.mapInArrow(run(held, first, between, False), schema_of(between)))
            first += len(held)
        held = block
    return rows.mapInArrow(run(held or (), first, _FIELDS, True), schema_of(_FIELDS))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learning(docs.filter(~held_out("doc_id"))))
