"""Citations and answers: parsing, checking, segments, prompts, recorded answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import BRACKETED, canonical_id, stripped
from tessera.operators.maintenance import unique

KIND, CANONICAL = "kind", "canonical"


def parse_citations(answers: DataFrame, key: str = "id", answer: str = "answer") -> DataFrame:
    """``key, pos, cited_as, canonical``: bracketed identifiers, the first spelling of each, in order from 0."""
    found = answers.select(key, F.posexplode(F.regexp_extract_all(F.col(answer), F.lit(BRACKETED), 1)).alias("at", "inner"))
    named = found.select(key, "at", stripped(F.col("inner")).alias("cited_as")).withColumn(CANONICAL, canonical_id(F.col("cited_as"))).filter(F.col(CANONICAL).isNotNull())
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy(key, CANONICAL).orderBy("at"))).filter("nth = 1")
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("pos"), "cited_as", CANONICAL)


def check_citations(cited: DataFrame, known: DataFrame, retrieved: DataFrame, key: str = "id") -> DataFrame:
    """``cited`` with ``exists_flag, retrieved_flag, valid, reason``; ``known(id)``, ``retrieved(key, canonical)``."""
    known = known.select(F.col("id").alias(CANONICAL)).distinct().withColumn("exists_flag", F.lit(True))
    got = retrieved.select(key, CANONICAL).distinct().withColumn("retrieved_flag", F.lit(True))
    joined = cited.join(known, CANONICAL, "left").join(got, [key, CANONICAL], "left").fillna({"exists_flag": False, "retrieved_flag": False})
    valid = F.col("exists_flag") & F.col("retrieved_flag")
    return joined.withColumn("valid", valid).withColumn("reason", F.when(valid, F.lit(None).cast("string")).when(~F.col("exists_flag"), "not a control in the catalog").otherwise("cited but not retrieved"))


def answer_segments(answers: DataFrame, citations: DataFrame, key: str = "id", answer: str = "answer") -> DataFrame:
    """``key, pos, kind, text``: an answer as runs of text and citations, a bracket being one if its inner text is exactly a
    ``cited_as`` of ``citations(key, cited_as)``; other brackets stay text, and texts that meet are one."""
    pieces = F.arrays_zip(F.split(F.col(answer), BRACKETED, -1).alias("literal"), F.regexp_extract_all(F.col(answer), F.lit(BRACKETED), 1).alias("inner"))
    cut = answers.select(key, F.posexplode(pieces).alias("at", "p")).select(key, "at", "p.literal", "p.inner")
    flat = cut.select(key, (2 * F.col("at")).alias("at"), F.col("literal").alias("text"), F.lit(None).cast("string").alias("inner")).unionByName(
        cut.filter("inner is not null").select(key, (2 * F.col("at") + 1).alias("at"), F.concat(F.lit("["), "inner", F.lit("]")).alias("text"), "inner")
    )
    marked = flat.join(citations.select(key, F.col("cited_as").alias("inner")).distinct().withColumn("cites", F.lit(True)), [key, "inner"], "left")
    marked = marked.withColumn(KIND, F.when(F.col("cites"), "citation").otherwise("text")).filter("text <> ''")
    order = Window.partitionBy(key).orderBy("at")
    new = F.when((F.col(KIND) == "citation") | (F.coalesce(F.lag(KIND).over(order), F.lit("citation")) == "citation"), 1).otherwise(0)
    runs = marked.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    merged = runs.groupBy(key, "run").agg(F.first(KIND).alias(KIND), joined.alias("text"))
    return merged.select(key, (F.col("run") - 1).cast("int").alias("pos"), KIND, F.when(F.col(KIND) == "citation", F.expr("substring(text, 2, length(text) - 2)")).otherwise(F.col("text")).alias("text"))


def render_prompts(retrieved: DataFrame, instructions: str, key: str = "q_id") -> DataFrame:
    """``key, prompt`` from ``key, question, rank, label, text``: instructions, excerpts by rank, then the question."""
    excerpts = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "label", F.lit("]\n"), "text").alias("excerpt"))))
    body = F.array_join(F.transform(excerpts, lambda x: x["excerpt"]), "\n\n")
    return retrieved.groupBy(key).agg(F.concat(F.lit(instructions), F.lit("\n\n"), body, F.lit("\n\nQuestion: "), F.first("question")).alias("prompt"))


def json_string(x: Column) -> Column:
    """A JSON string in printable ASCII: other characters by their short escape, else in UTF-16 as ``\\uXXXX``."""

    def escaped(c: Column) -> Column:
        unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        point = F.ascii(c)
        above = point - 0x10000
        out = F.when(c.rlike(r"^[ -~]"), c)
        for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = out.when(c == raw, short)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        return out.when(point < 0x10000, unit(point)).otherwise(pair)

    quoted = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    runs = F.regexp_extract_all(quoted, F.lit(r"[ -~]+|[^ -~]"), 0)
    return F.concat(F.lit('"'), F.array_join(F.transform(runs, escaped), ""), F.lit('"'))


def request_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object of strings with sorted keys and no blanks, non-ASCII characters escaped."""
    parts = [x for n, name in enumerate(sorted(fields)) for x in ([F.lit(",")] if n else []) + [F.lit(f'"{name}":'), json_string(fields[name])]]
    return F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256)


@F.pandas_udf(StringType())
def _sorted_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))


def canonical_json(value: Column) -> Column:
    """JSON of a struct, map, array or VARIANT that doesn't move when fields do: keys sorted at every level, no blanks, characters
    beyond ASCII escaped, numbers in their shortest form that reads back the same, nulls kept; as Python's ``json.dumps`` writes it.

    The engine writes the value (doubles so that they read back), and a worker sorts and writes it again, in batches. Numbers
    that aren't finite have no form in JSON; the engine writes them as strings. Objects of strings alone need no worker: see
    ``request_key``.
    """
    return _sorted_json(F.to_json(value, {"ignoreNullFields": "false"}))


def whole_request_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of ``canonical_json`` of an object with these fields, of any type and nested in any way."""
    return F.sha2(canonical_json(F.struct(*(c.alias(n) for n, c in fields.items()))).cast("binary"), 256)


def replay_all(requests: DataFrame, recordings: DataFrame, key: str = "key") -> DataFrame:
    """``replay`` where each request must have been recorded; one that wasn't fails the query."""
    out = replay(requests, recordings, key)
    return out.withColumn("answer", F.when(F.col("answered"), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("not recorded: "), F.col(key)))))


def replay(requests: DataFrame, recordings: DataFrame, key: str = "key") -> DataFrame:
    """``requests`` with ``answered, answer, decline``: the recorded answer of an equal key, or an explicit decline. A key that
    is recorded twice fails the query."""
    held = unique(recordings, key).select(key, F.array_join("answer_lines", "\n").alias("answer"), F.lit(True).alias("answered"))
    joined = requests.join(held, key, "left")
    return joined.withColumn("answered", F.coalesce("answered", F.lit(False))).withColumn("decline", F.when(~F.col("answered"), "no recorded answer"))
