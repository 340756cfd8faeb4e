"""A Merkle manifest of a dataset: an external node store by levels, and proofs read from it by coordinate.

Leaves are sorted by the engine into runs, and a leaf's place is its place in its run of the sort plus the counts of the runs
before it, so no task and no driver ever orders all leaves. A node's coordinate is its group, level and place; the nodes over
places 2p and 2p+1 are at p of the next level.

The store is Parquet, partitioned by level. A pass reads one level in order, in chunks of 2^``LEVELS`` neighbouring nodes, and
streams the levels over each chunk; the next pass reads the last of them. Proofs go the other way: a pass merges the nodes
of a chunk, the wanted coordinates in it and the proof of the chunk's own root, all sorted by coordinate, in one scan. A chunk is
the most that a task holds, and a group with all leaves is spread over its chunks like any other.

The roots of the groups are the leaves of one more tree, built and proved by the same passes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, forget, saved, shared_folder, tracked, width

#: Levels that a pass streams, so that a chunk has 256 nodes at most.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "group string, n long, level int, pos long, hash binary"


def digest(*parts: bytes) -> bytes:
    """SHA-256 over the parts' lower-case hex digits."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def height(n: int) -> int:
    """Levels over ``n`` leaves: none over one."""
    return (n - 1).bit_length()


def leaf_of(*values: Column) -> Column:
    """SHA-256, in hex, over values: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    told = (F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")) for v in values)
    return F.sha2(F.concat(*(F.coalesce(t, F.lit("-")) for t in told)), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the group from 0, and ``n``, the group's rows."""
    dealt = rows.repartitionByRange(width(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    placed = saved(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    runs = placed.groupBy(group, "__part").agg(F.count("*").alias("__here"), F.min("__at").alias("__first"))
    before, all_ = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    starts = runs.select(group, "__part", (F.coalesce(F.sum("__here").over(before), F.lit(0)) - F.col("__first")).alias("__start"), F.sum("__here").over(all_).alias("n"))
    return placed.join(starts, [group, "__part"]).withColumn("pos", F.col("__at") + F.col("__start")).drop("__at", "__part", "__start")


def _grown(base: int, levels: int):
    """From nodes ``group, n, chunk, pos, hash`` of level ``base``, in order: the levels over each chunk, with the nodes
    themselves if they are leaves."""

    def above(group: str, n: int, chunk: int, level: list[bytes]) -> Iterator[tuple]:
        if not base:
            yield from ((group, n, 0, (chunk << levels) + i, h) for i, h in enumerate(level))
        for up in range(1, min(levels, height(n) - base) + 1):
            level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
            yield from ((group, n, base + up, (chunk << levels - up) + i, h) for i, h in enumerate(level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, level, out = None, 0, [], []
        for b in batches:
            for group, size, chunk, h in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if (group, chunk) != at:
                    if at is not None:
                        out += above(at[0], n, at[1], level)
                    at, n, level = (group, chunk), size, []
                level.append(h)
                if len(out) > 4096:
                    yield _batch(out, _NODE_ARROW)
                    out = []
        if at is not None:
            out += above(at[0], n, at[1], level)
        yield _batch(out, _NODE_ARROW)

    return run


_NODE_ARROW = [("group", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("hash", pa.binary())]


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


@dataclass(frozen=True)
class Store:
    """Nodes ``group, n, level, pos, hash`` of trees under one folder, by level; ``top`` is the greatest height, and a pass
    takes ``levels``."""

    spark: SparkSession
    folder: str
    top: int
    levels: int = LEVELS

    def bases(self) -> range:
        """The lowest levels of the passes."""
        return range(0, max(1, self.top), self.levels)

    def nodes(self, low: int, high: int) -> DataFrame:
        """The levels from ``low`` to below ``high``."""
        return self.spark.read.schema(_NODE).parquet(self.folder).filter((F.col("level") >= low) & (F.col("level") < high))

    def roots(self) -> DataFrame:
        """``group, n, hash`` of each tree's root."""
        return self.nodes(0, self.top + 1).filter(F.col("level") == _height(F.col("n"))).select("group", "n", "hash")


def _height(n: Column) -> Column:
    """``height`` as a column: the binary digits of n - 1."""
    return F.when(n < 2, 0).otherwise(F.length(F.bin(n - 1)))


def build(leaves: DataFrame, folder: str, levels: int = LEVELS) -> Store:
    """Write the trees over ``group, pos, n, hash``, of which ``pos`` runs from 0 to n - 1 in each group."""
    spark = leaves.sparkSession
    store = Store(spark, folder, height(leaves.agg(F.max("n")).first()[0] or 1), levels)
    level = leaves.select("group", "n", "pos", "hash")
    for base in store.bases():
        if base:
            level = store.nodes(base, base + 1).filter(_height(F.col("n")) > base).select("group", "n", "pos", "hash")
        chunk = F.shiftright("pos", levels)
        rows = level.select("group", "n", chunk.alias("chunk"), "pos", "hash").repartition(width(spark), "group", "chunk").sortWithinPartitions("group", "chunk", "pos")
        grown = rows.mapInArrow(_grown(base, levels), _NODE)
        grown.write.mode("append").option("compression", "zstd").option("parquet.enable.dictionary#hash", "false").partitionBy("level").parquet(folder)
    return store


_FACTS = ("path", "root", "rank", "groups", "subroot")
_PROOF = "group string, n long, pos long, path binary, root binary, rank long, groups long, subroot binary"


def _merged(base: int, levels: int):
    """A merge scan of rows in order of coordinate: a chunk's own proof (kind 0), its nodes by level (1), and the wanted
    ones of level ``base`` (2). A proof is the siblings that there are, from the bottom up."""
    fields = [("group", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), *(("path", pa.binary()) if c == "path" else (c, pa.int64() if c in ("rank", "groups") else pa.binary()) for c in _FACTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, facts, nodes, out = None, (), [], []
        for b in batches:
            for group, chunk, kind, level, pos, n, h, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (group, chunk) != at:
                    at, facts, nodes = (group, chunk), None, [[] for _ in range(levels)]
                if kind == 0:
                    facts = own
                elif kind == 1:
                    nodes[level - base].append(h)
                else:
                    up, place, count = [], pos - (chunk << levels), -(-n >> base)
                    for j in range(min(levels, height(n) - base)):
                        if place ^ 1 < len(nodes[j]):
                            up.append(nodes[j][place ^ 1])
                        place >>= 1
                    if facts is None or pos >= count:
                        raise ValueError(f"no such coordinate: {group!r}, level {base}, place {pos}")
                    out.append((group, n, pos, b"".join(up) + facts[0], *facts[1:]))
            if len(out) > 1024:
                yield _batch(out, fields)
                out = []
        yield _batch(out, fields)

    return run


def extract(store: Store, tops: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``group, n, pos, path, root, rank, groups, subroot``: the proofs of leaves at ``wanted(group, n, pos)``, or of all.

    ``tops`` has, for each group, ``n``, what ``path`` goes on with above its root, and the other facts.
    """
    spark, levels, facts = store.spark, store.levels, [F.col(c) for c in _FACTS]
    tall = _height(F.col("n"))
    proofs = None
    for base in reversed(store.bases()):
        # chunks that reach their group's root go on with its facts, the others with the proof of the node over them
        ends = tops.filter((tall <= base + levels) & ((tall > base) | F.lit(base == 0))).select("group", F.lit(0).cast("long").alias("chunk"), *facts)
        above = ends if proofs is None else ends.unionByName(proofs.select("group", F.col("pos").alias("chunk"), *facts))
        none = lambda *kinds: [F.lit(None).cast(k) for k in kinds]
        heads = above.select("group", "chunk", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), none("binary")[0].alias("hash"), *facts)
        blank = [x.alias(c) for x, c in zip(none("binary", "binary", "long", "long", "binary"), _FACTS, strict=True)]
        level = F.col("level")
        nodes = store.nodes(base, base + levels).filter((tall > base) | F.lit(base == 0))
        chunk = F.expr(f"shiftright(pos, {levels} - (level - {base}))")
        nodes = nodes.select("group", chunk.alias("chunk"), F.lit(1).alias("kind"), level.alias("level"), "pos", "n", "hash", *blank)
        asked = wanted if wanted is not None and base == 0 else store.nodes(base, base + 1).filter((tall > base) | F.lit(base == 0))
        asked = asked.select("group", F.shiftright("pos", levels).alias("chunk"), F.lit(2).alias("kind"), F.lit(base).alias("level"), "pos", "n", none("binary")[0].alias("hash"), *blank)
        rows = heads.unionByName(nodes).unionByName(asked)
        if wanted is not None and base == 0:
            rows = rows.join(asked.select("group", "chunk").distinct(), ["group", "chunk"], "left_semi").select(*rows.columns)
        ordered = rows.repartition(width(spark), "group", "chunk").sortWithinPartitions("group", "chunk", "kind", "level", "pos")
        proofs = ordered.mapInArrow(_merged(base, levels), _PROOF)
    return proofs


def sides(n: int, pos: int) -> Iterator[int]:
    """For each level from the bottom: -1 if the sibling stands on the left, 1 on the right, 0 if there is none."""
    while n > 1:
        yield -1 if pos & 1 else int(pos + 1 < n)
        n, pos = (n + 1) // 2, pos >> 1


def fold(leaf: bytes, path: bytes, n: int, pos: int, groups: int, rank: int) -> bytes:
    """The root that a leaf and its siblings, bottom up, come to: through its group's tree and then the tree of groups."""
    at = 0
    for side in (*sides(n, pos), *sides(groups, rank)):
        if side:
            other, at = path[at : at + 32], at + 32
            leaf = digest(other, leaf) if side < 0 else digest(leaf, other)
        else:
            leaf = digest(leaf)
    if at != len(path):
        raise ValueError("a proof of another length")
    return leaf


@dataclass(frozen=True)
class Manifest:
    """What ``manifest`` wrote: ``leaves`` (group, n, pos, doc_id, hash and what else was given), the trees, and the
    tree of their roots."""

    leaves: DataFrame
    trees: Store
    roots: Store
    tops: DataFrame

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """``group, n, pos, path, root, rank, groups, subroot`` for coordinates ``wanted(group, n, pos)``, or for all leaves."""
        return extract(self.trees, self.tops, wanted)


def manifest(leaves: DataFrame, folder: str, order: str = "doc_id", levels: int = LEVELS) -> Manifest:
    """Build the store under ``folder`` from ``group string, hash binary`` and a column to order by.

    Leaves of a group stand by that column (nulls first), then by hash, so that ties and repeated rows give the same trees
    however they are dealt; groups by their UTF-8 bytes. Other columns are kept with the leaves. Without leaves there are no
    trees and no root.
    """
    placed = saved(ranked(leaves, "group", order, "hash"), ["hash"])
    trees = build(placed, f"{folder}/trees", levels)
    subroots = saved(trees.roots().select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("n").alias("size"), "hash"))
    named = saved(ranked(subroots, "group", "name"))
    forget(subroots)
    roots = build(named, f"{folder}/roots", levels)
    whole = roots.roots().select("group", "n", F.lit(b"").alias("path"), F.col("hash").alias("root"), *(F.lit(0).cast("long").alias(c) for c in ("rank", "groups")), F.col("hash").alias("subroot"))
    proved = extract(roots, whole).select("pos", "path", "root", F.col("n").alias("groups"))
    tops = named.select("pos", F.col("name").alias("group"), F.col("size").alias("n"), F.col("hash").alias("subroot")).join(proved, "pos")
    tops = saved(tops.select("group", "n", "path", "root", F.col("pos").alias("rank"), "groups", "subroot"))
    forget(named)
    return Manifest(placed, trees, roots, tops)


_VERIFIED = [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]


def verified(proofs: DataFrame) -> DataFrame:
    """From ``doc_id, hash, shown, n, pos, path, root, rank, groups, subroot``: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``. The proof is folded from ``shown``, what a copy of the data claims the leaf to be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, leaf, shown, n, pos, path, root, rank, groups, subroot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                folded = fold(shown, path, n, pos, groups, rank)
                out.append((i, leaf.hex(), subroot.hex(), root.hex(), sha256(path.hex().encode()).hexdigest(), folded.hex(), folded == root))
            yield _batch(out, _VERIFIED)

    columns = proofs.select("doc_id", "hash", "shown", "n", "pos", "path", "root", "rank", "groups", "subroot")
    return columns.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``group, doc_id, hash, shown`` of a documents table: a leaf for each row, grouped by lang (null first).

    ``shown`` is the leaf of the row with 1 added to ``n_chars`` where ``tampered``, an expression over ``doc_id``, is true, else
    the leaf itself; a null count stays null.
    """
    rows = docs.select(*(F.col(f"`{c}`").cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS))
    leaf = leaf_of(*(F.col(c) for c in FIELDS))
    changed = leaf_of(*(F.try_add("n_chars", F.lit(1).cast("long")) if c == "n_chars" else F.col(c) for c in FIELDS))
    touched = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    shown = F.when(touched, F.unhex(changed))
    rows = rows.select(F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("group"), "doc_id", F.unhex(leaf).alias("hash"), shown.alias("other"))
    return rows.select("group", "doc_id", "hash", F.coalesce("other", "hash").alias("shown"))


def prove_documents(docs: DataFrame, tampered: Column | None = None, folder: str | None = None, levels: int = LEVELS) -> DataFrame:
    """Every row's proof, checked against what ``document_leaves`` shows of it: see ``verified``.

    Nulls are leaves like others (a null id stands first, a null lang is a group); repeated rows are leaves each, next to each
    other; empty texts and texts of any length are hashed whole; an empty table gives no rows; other columns aren't read. The
    store is written under ``folder``, or where it isn't named to the shared one, from which it goes with the result.
    """
    folder = folder or tracked(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}.store")
    leaves = saved(document_leaves(docs, tampered), ["hash", "shown"])
    whole = manifest(leaves, folder, levels=levels)
    forget(leaves)
    key = ["group", "pos"]
    return verified(whole.leaves.join(whole.proofs().drop("n"), key))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return prove_documents(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


OP11_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
  sha256(a || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || z) AS other FROM (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM documents)),
ids AS (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL),
bytes(doc_id, k, crc) AS (SELECT doc_id, 0, CAST(4294967295 AS BIGINT) FROM ids UNION ALL
  SELECT doc_id, k + 1, list_reduce([xor(crc, CAST(ascii(substr(CAST(doc_id AS VARCHAR), k + 1, 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FROM bytes WHERE k < length(CAST(doc_id AS VARCHAR))),
hit AS (SELECT doc_id FROM bytes WHERE k = length(CAST(doc_id AS VARCHAR)) AND xor(crc, 4294967295) % 7 = 0),
l AS (SELECT d.doc_id, CASE WHEN d.lang IS NULL THEN '0' ELSE '1' || d.lang END AS grp, leaf, CASE WHEN hit.doc_id IS NULL THEN leaf ELSE other END AS shown,
  row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY d.lang) AS n FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id),
tree(grp, level, pos, n, h) AS (SELECT grp, 0, pos, n, leaf FROM l UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, level, n, pos // 2),
sub AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS rank, count(*) OVER () AS m FROM tree WHERE n = 1),
top(level, pos, n, h) AS (SELECT 0, rank, m, subroot FROM sub UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, n, pos // 2),
heights AS (SELECT grp, max(level) AS tall FROM tree GROUP BY grp),
nodes AS (SELECT grp, level, pos, h, tall FROM tree JOIN heights USING (grp) WHERE level < tall UNION ALL
  SELECT sub.grp, tall + top.level, top.pos, top.h, tall FROM top, sub JOIN heights USING (grp) WHERE top.level < (SELECT max(level) FROM top)),
r AS (SELECT row_number() OVER () AS rid, l.*, subroot, rank, tall, (SELECT h FROM top WHERE n = 1) AS root, tall + (SELECT max(level) FROM top) AS depth FROM l JOIN sub USING (grp) JOIN heights USING (grp)),
steps AS (SELECT rid, g.level, CASE WHEN g.level < tall THEN pos >> g.level ELSE rank >> (g.level - tall) END AS place, grp FROM r, LATERAL (SELECT unnest(range(CAST(depth AS BIGINT))) AS level) g),
sib AS (SELECT s.rid, s.level, s.place, x.h FROM steps s LEFT JOIN nodes x ON x.grp = s.grp AND x.level = s.level AND x.pos = xor(s.place, 1)),
proof AS (SELECT rid, sha256(string_agg(h, '' ORDER BY level)) AS digest FROM sib WHERE h IS NOT NULL GROUP BY rid),
fold(rid, level, depth, h) AS (SELECT rid, CAST(0 AS BIGINT), CAST(depth AS BIGINT), shown FROM r UNION ALL
  SELECT f.rid, f.level + 1, f.depth, sha256(CASE WHEN sib.h IS NULL THEN f.h WHEN sib.place % 2 = 1 THEN sib.h || f.h ELSE f.h || sib.h END) FROM fold f JOIN sib ON sib.rid = f.rid AND sib.level = f.level)
SELECT doc_id, leaf, subroot, root, coalesce(digest, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM r LEFT JOIN proof USING (rid) JOIN fold ON fold.rid = r.rid AND fold.level = fold.depth
"""
