"""URL filters as a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot: ``a.example.org`` is ``org.example.a.``. A rule's host
and all its subdomains are then the keys with one prefix, which is one interval of the sort order. Urls and rules are
dealt to ranges of that order, sorted, and swept once; the sweep keeps a stack of the host rules that are open at the
current key, which nest, so the stack is as deep as a host has labels. Each open host holds its path prefixes by length.

Nothing is broadcast but the split points of the ranges, which are as many as the partitions. The split points include
path and id, so a host that holds a third of all pages spreads over many ranges; a rule is sent to each range that its
interval meets.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import long_rows, width

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class OpenRules:
    """The stack of host rules whose interval holds the current key."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, str, dict[str, str]]] = []

    def settle(self, key: str) -> None:
        while self.frames and not key.startswith(self.frames[-1][0]):
            self.frames.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append((key, host, {}))
        paths = self.frames[-1][2]
        # of two verdicts for one host and path, block wins
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict

    def best(self, path: str) -> tuple[str, str] | None:
        found: tuple[int, int, str, str] | None = None
        for _, host, paths in self.frames:
            for size in sorted({len(p) for p in paths if len(p) <= len(path)}, reverse=True):
                if (verdict := paths.get(path[:size])) is not None:
                    candidate = (len(host) + size, len(host), host + path[:size], verdict)
                    if found is None or candidate > found:
                        found = candidate
                    break
        return found and (found[2], found[3])


def filter_urls(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url: ``page_id, host, path, rule, verdict``, one row for each row of ``pages``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the url's path starts with the
    rule's path. The rule with most characters in host and path wins, then the one with the longer host. Without a
    rule, ``rule`` is null and the verdict is ``default``. Null urls and urls without ``://`` have an empty host and
    path. Repeated pages give repeated rows; repeated rules count once, and ``block`` beats ``allow`` between rules
    with equal host and path; rules with a null field are ignored; an empty table gives no rows. Other columns of
    either table are not read.
    """
    long_rows(pages.sparkSession)
    parts = width(pages.sparkSession)
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("u"))
    read = read.select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    read = read.withColumn("at", F.concat(reversed_host(F.col("host")), F.lit("\x00"), "path", F.lit("\x00"), F.hex(F.xxhash64(F.col("page_id")))))
    known = rules.select("host", "path", "verdict").dropna().distinct().withColumn("at", reversed_host(F.col("host")))

    # the ranges that the engine itself draws for sorting, of which the driver sees one key each
    ranged = read.select("at").repartitionByRange(parts, "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("at"))
    splits = sorted(x.at for x in ranged.collect())[1:]

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(splits, x) for x in at], dtype="int32")

    urls = read.withColumn("kind", F.lit(1)).withColumn("verdict", F.lit(None).cast("string")).withColumn("part", range_of("at"))
    # no key with a rule's prefix lies behind the prefix with its last dot replaced by the next character
    after = F.concat(F.expr("substring(at, 1, length(at) - 1)"), F.lit("/"))
    spread = known.withColumn("part", F.explode(F.sequence(range_of("at"), range_of(after))))
    spread = spread.select(F.lit(None).cast("long").alias("page_id"), "host", "path", "at", F.lit(0).alias("kind"), "verdict", "part")
    sorted_rows = urls.unionByName(spread).repartition(parts, "part").sortWithinPartitions("part", "at", "kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_rules = None, OpenRules()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, open_rules = row["part"], OpenRules()
                open_rules.settle(row["at"])
                if row["kind"] == 0:
                    open_rules.add(row["at"], row["host"], row["path"], row["verdict"])
                else:
                    rule, verdict = open_rules.best(row["path"]) or (None, default)
                    out.append((row["page_id"], row["host"], row["path"], rule, verdict))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 4), strict=True)], names=["page_id", "host", "path", "rule", "verdict"])

    return sorted_rows.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


_CASES = "\n".join(f"    WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_VERDICTS = "\n".join(f"    WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
OP9_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT page_id, host, path, CASE
{_CASES}
    ELSE NULL END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE rule
{_VERDICTS}
    ELSE 'allow' END AS verdict FROM judged
"""
