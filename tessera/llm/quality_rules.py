"""Quality rules, line first: lines that fail a rule go, and documents that lose too much text by that are rejected.

Everything is a built-in column expression over one row: no shuffle, no Python, and a document is never taken apart into
rows. Arrays that are needed more than once are columns of their own, so that none is made anew for each of its items.

A line that has a word fails as

* navigation or punctuation: it has a run of two or more marks, or a mark that stands alone, for every ``NOISE`` characters or
  fewer (navigation if most of these are alone or the marks of a menu, else punctuation);
* navigation: it has up to ``SHORT`` characters, no full stop at its end, and begins with a phrase of navigation;
* boilerplate: it has up to ``NOTICE`` characters and holds a phrase of licences, notices, cookies or placeholders;
* punctuation: no closing mark stands at its end, and it is shorter than ``SHORT`` or has no mark at all.

Lines without a word are neither kept nor lost. Words are runs of characters other than ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents

#: Characters for each mark at least, of a short line, and of a notice at most.
NOISE, SHORT, NOTICE = 25, 40, 250
#: A document is rejected if lines that fail have over so many hundredths of the characters of its lines.
LOST = 50
# Marks and phrases, in lower case, for Spark's patterns and for DuckDB's.
SYMBOLS = "#*$%&|<>"
MARKS = r"!?#*$%&<>|=_~^+»·/\\«-"
CLOSERS = tuple(".!?:;…。！？»”’\"')]")
MARKED = r"[.,!?:;…。！？，；：]"
NAVIGATION = ("home", "next", "previous", "read more", "click here", "back to", "skip to", "share", "log in", "sign in", "sign up", "menu", "search", "page ")
BOILERPLATE = ("licensed under", "all rights reserved", "copyright", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "lorem ipsum", "permission is hereby granted", "subscribe", "without warrant")

_BLANK = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\x0c\r"
_RULES = ("punctuation", "navigation", "boilerplate")
#: Runs of marks, and marks between white space; the class comes first, so that other characters cost one test each.
_NOISE = f"[{MARKS}](?:[{MARKS}]+|(?<![^{_BLANK}].)(?![^{_BLANK}]))"
_MENU = f"(?<![^{_BLANK}])[|>»·/<«-]+(?![^{_BLANK}])"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{_BLANK}]+"), "")


def failed_rule(line: Column) -> Column:
    """The first rule that the line fails; null if there is none."""
    size, small = F.length(line), F.lower(line)
    closed = F.right(line, F.lit(1)).isin(*CLOSERS) | F.right(F.trim(line, F.lit(_SPACES)), F.lit(1)).isin(*CLOSERS)
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    stopped = F.right(F.trim(line, F.lit(_SPACES)), F.lit(1)).isin(".", "!", "?")
    led = (size <= SHORT) & F.exists(F.array(*map(F.lit, NAVIGATION)), lambda p: F.startswith(F.trim(small), p)) & ~stopped
    notice = (size <= NOTICE) & F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(small, p))
    return (
        F.when(count(_NOISE) * NOISE > size, F.when(count(_MENU) * 2 > count(_NOISE), _RULES[1]).otherwise(_RULES[0]))
        .when(led, _RULES[1]).when(notice, _RULES[2])
        .when(~closed & ((size < SHORT) | ~line.rlike(MARKED)), _RULES[0])
    )


def clean_lines(docs: DataFrame, text: str = "text", lost: int = LOST) -> DataFrame:
    """``docs`` with ``quality_rules``, a struct of

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); base_failed; cleaned (the lines that pass, joined by
    line ends); n_lines, n_chars (of the lines that have a word); punctuation, navigation, boilerplate (characters lost to each
    rule); kept (whether not base_failed and no more than ``lost`` hundredths of the characters are lost).

    A null text is an empty one, which has no words and is base_failed. Repeated rows are judged each by itself, so ties don't
    matter; an empty table gives no rows; whatever other columns there are stay as they are, and none but ``text`` is read (a
    column named quality_rules is replaced). Texts of any length are judged whole.

    To find three words that stand in a text twice, its windows are sorted with their place last, so that equal ones are
    neighbours, and compared by their words; nothing is hashed.
    """
    columns = [f"`{c}`" for c in docs.columns if c != "quality_rules"]
    mine = lambda name: f"__quality_{name}"
    t, words, lines, windows = (F.col(mine(c)) for c in ("text", "words", "lines", "windows"))
    many = F.greatest(F.size(words) - 2, F.lit(0))

    step = docs.select(*columns, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(mine("text")))
    step = step.withColumns({mine("words"): words_of(t), mine("lines"): F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(_SPACES)) != "")})
    triples = F.arrays_zip(*(F.slice(words, n, many).alias(c) for n, c in ((1, "a"), (2, "b"), (3, "c"))), F.sequence(F.lit(1), F.greatest(many, F.lit(1))).alias("i"))
    step = step.withColumns({mine("windows"): F.sort_array(triples), mine("rules"): F.transform(lines, failed_rule)})
    # each window with the one after it in order
    pairs = F.arrays_zip(F.slice(windows, 1, F.greatest(many - 1, F.lit(0))).alias("x"), F.slice(windows, 2, F.greatest(many - 1, F.lit(0))).alias("y"))
    same = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    covered = F.flatten(F.transform(same, lambda p: F.array(*(p[s]["i"] + k for s in "xy" for k in range(3)))))
    judged = F.arrays_zip(lines.alias("line"), F.col(mine("rules")).alias("rule"))
    step = step.withColumns({mine("repeats"): F.size(F.array_distinct(covered)).cast("long"), mine("judged"): judged})
    total = lambda rule: F.aggregate(F.filter(mine("judged"), lambda x: x["rule"] == rule), F.lit(0).cast("long"), lambda s, x: s + F.length(x["line"]))
    step = step.withColumns({mine(r): total(r) for r in _RULES})

    n, repeats = F.size(words).cast("long"), F.col(mine("repeats"))
    gone, chars = sum((F.col(mine(r)) for r in _RULES), F.lit(0)), (F.length(F.array_join(lines, "")).cast("long"))
    base = (n < 50) | (100 * repeats > 50 * n)
    passed = F.array_join(F.transform(F.filter(mine("judged"), lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    return step.select(*columns, F.struct(
        n.alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), repeats.alias("n_repeat_words"), base.alias("base_failed"), passed.alias("cleaned"),
        F.size(lines).cast("long").alias("n_lines"), chars.alias("n_chars"), *(F.col(mine(r)).alias(r) for r in _RULES), (~base & (100 * gone <= lost * chars)).alias("kept"),
    ).alias("quality_rules"))


def cleaned(docs: DataFrame, text: str = "text", lost: int = LOST) -> DataFrame:
    """The rows that are kept, with all their columns and with the lines that pass as their text; see ``clean_lines``."""
    columns = docs.columns
    kept = clean_lines(docs, text, lost).filter("quality_rules.kept")
    return kept.withColumn(text, F.col("quality_rules.cleaned")).select(*(f"`{c}`" for c in columns))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    said = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return clean_lines(docs).select("doc_id", *(f"quality_rules.{c}" for c in said))


def _any(phrases: tuple[str, ...], test: str, where: str) -> str:
    return "(" + " OR ".join(f"{test}({where}, '{p}')" for p in phrases) + ")"


_CLOSED = "[" + "".join(CLOSERS).replace("]", "\\]").replace("'", "''") + f"][{_BLANK}]*$"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^{_BLANK}]+') AS words FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(words[1:len(words) - 2]) AS a, unnest(words[2:len(words) - 1]) AS b, unnest(words[3:]) AS c FROM w WHERE len(words) > 2),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS c FROM win),
rep AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM twice WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, line, lower(line) AS low, trim(lower(line), ' ') AS small, len(line) AS size, regexp_extract_all(line, '[^{_BLANK}]+') AS ws FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{_BLANK}]')),
j AS (SELECT *, {NOISE} * (len(regexp_extract_all(line, '[{MARKS}]{{2,}}')) + len(list_filter(ws, lambda x: regexp_full_match(x, '[{MARKS}]')))) > size
  OR (size <= {SHORT} AND {_any(NAVIGATION, 'starts_with', 'small')} AND NOT regexp_matches(line, '[.!?][{_BLANK}]*$')) OR (size <= {NOTICE} AND {_any(BOILERPLATE, 'contains', 'low')})
  OR (NOT regexp_matches(line, '{_CLOSED}') AND (size < {SHORT} OR NOT regexp_matches(line, '{MARKED}'))) AS fails FROM l),
g AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, coalesce(sum(size) FILTER (fails), 0) AS gone, sum(size) AS chars FROM j GROUP BY rid),
f AS (SELECT doc_id, len(words) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone, coalesce(chars, 0) AS chars FROM w LEFT JOIN rep USING (rid) LEFT JOIN g USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * gone <= {LOST} * chars AS kept FROM f
"""
