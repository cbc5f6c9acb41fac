"""Merkle manifest of a dataset: leaves by row, a tree for each group, one root over the groups; every row gets its witness.

A leaf is the hash of a row's fields. Each group's leaves, in order, form a tree of runs of eight; the
groups' roots, in order of the group's name (null first), form the last tree.

Witnesses grow incrementally. A task appends an aligned block of ``8 ** LEVELS`` leaves one by one to a
stream of runs (``Appender``): a new leaf joins the open run of each level, and the witness of everything below that run is
the run itself, so a sibling that is completed later extends all those partial witnesses at once. A block's
root is a further append to the same kind of stream, one round up, in as many tasks as there are blocks of
blocks; rounds end when every tree has one node. Then the upper witnesses travel down again, block by block, and each
block's stream is appended anew to give its leaves their own part; so no witness is stored for every leaf.

Positions come from a range sort, a number within each partition and the partitions' counts: no task or driver
sees a whole tree, and a group with most of all rows is many partitions and many blocks.

Defined results: a null field is hashed as ``-``, so null and empty differ; a null group is a tree of its own; rows with
a null id come first in their tree; rows with one id are ordered by their leaves, and equal rows are leaves of
their own, each with its witness; very long texts are hashed whole; an empty table gives no rows; only the named
columns are read and ``carry`` must name others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Nodes of a run.
FAN = 8
#: Levels of one block: 512 nodes.
LEVELS = 3
BLOCK = FAN**LEVELS
#: Hexadecimal digits of a digest.
DIGITS = 64


def field(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8 bytes, a colon, the value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """Streaming append of aligned leaves. ``runs[l]`` holds level l's runs, each a list of digests; the last one may be open."""

    def __init__(self, levels: int):
        self.runs: list[list[list[str]]] = [[] for _ in range(levels)]
        self.root: str | None = None

    def append(self, digest: str, level: int = 0) -> None:
        """``digest`` joins the open run of its level: by that it extends the witnesses of all that stands before it in the run, and gets theirs as its own."""
        if level == len(self.runs):
            self.root = digest
            return
        runs = self.runs[level]
        if not runs or len(runs[-1]) == FAN:
            runs.append([])
        runs[-1].append(digest)
        if len(runs[-1]) == FAN:
            self.append(_hash("".join(runs[-1])), level + 1)

    def close(self) -> None:
        """Completes the open subtrees, from below."""
        for level, runs in enumerate(self.runs):
            if runs and len(runs[-1]) < FAN:
                self.append(_hash("".join(runs[-1])), level + 1)

    def witnesses(self, count: int) -> Iterator[str]:
        """Of each leaf: for each level ``left,right`` (the joined siblings on both sides), levels joined by ``;``."""
        joined = [["".join(run) for run in runs] for runs in self.runs]
        for i in range(count):
            parts = []
            for level, texts in enumerate(joined):
                place = i // FAN**level
                run, at = texts[place // FAN], place % FAN * DIGITS
                parts.append(f"{run[:at]},{run[at + DIGITS:]}")
            yield ";".join(parts)


def levels_of(n: int) -> int:
    """Levels that a block of a tree of n nodes is raised by: all that the tree has, if it is one block."""
    if n > BLOCK:
        return LEVELS
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _appended(nodes: pd.DataFrame) -> Appender:
    stream = Appender(levels_of(int(nodes["n"].iloc[0])))
    for digest in nodes["digest"]:
        stream.append(digest)
    stream.close()
    return stream


def positions(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order``) and ``n`` (rows) within each tree. Stored, as places within partitions must not be computed twice."""
    tied = rows.withColumn("tie_", F.monotonically_increasing_id())  # equal rows may stand in any order: this spreads them
    keys = [F.col(c) for c in (tree, *order, "tie_")]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie_").withColumn("at_", F.monotonically_increasing_id())
    placed = store(placed, name).withColumn("part_", F.shiftright("at_", 33))
    parts = placed.groupBy(F.col(tree).alias("tree_"), F.col("part_").alias("p_")).agg(F.count(F.lit(1)).alias("count_"), F.min("at_").alias("first_"))
    before = F.sum("count_").over(Window.partitionBy("tree_").orderBy("p_")) - F.col("count_")
    parts = parts.withColumn("before_", before).withColumn("n", F.sum("count_").over(Window.partitionBy("tree_")))
    same = F.col(tree).eqNullSafe(F.col("tree_")) & (F.col("part_") == F.col("p_"))
    with_pos = placed.join(parts, same).withColumn("pos", F.col("at_") - F.col("first_") + F.col("before_"))
    return with_pos.drop("tree_", "p_", "count_", "first_", "before_", "at_", "part_")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From ``tree, pos, n, digest``: the nodes of each round, the leaves first, and ``tree, digest`` of all roots."""

    def raise_(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        first, n = nodes.iloc[0], int(nodes["n"].iloc[0])
        return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["block"])], "n": [-(-n // BLOCK)], "digest": [_appended(nodes).root]})

    kind = leaves.schema["tree"].dataType.simpleString()
    rounds, roots = [leaves], None
    while True:
        blocks = _blocked(rounds[-1].select("tree", "pos", "n", "digest")).groupBy("tree", "block")
        up = store(blocks.applyInPandas(raise_, f"tree {kind}, pos long, n long, digest string"), "merkle-round")
        done = up.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        more = up.where("n > 1")
        if more.isEmpty():
            return rounds, roots
        rounds.append(more)


def _attacher(columns: list[str]):
    def attach(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        up = above["up"].iloc[0]
        own = _appended(nodes).witnesses(len(nodes))
        return nodes[columns].assign(witness=[f"{w};{up}" if w and up else w or up for w in own], subroot=above["subroot"].iloc[0])

    return attach


def witnessed(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves (``rounds[0]``) with ``witness`` and ``subroot``. above: ``tree, up, subroot``, the witness of each tree's root and that root."""
    upper = None
    for i in reversed(range(len(rounds))):
        nodes = _blocked(rounds[i])
        # a tree that ends in this round has one block, below what is above the tree
        ends = nodes.where((F.col("n") <= BLOCK) & (F.col("pos") == 0)).select(F.col("tree").alias("t_"))
        mine = ends.join(above, F.col("t_").eqNullSafe(F.col("tree"))).select("tree", F.lit(0).cast("long").alias("block"), "up", "subroot")
        upper = mine if upper is None else mine.unionByName(upper)
        out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rounds[i].schema)}, witness string, subroot string"
        given = nodes.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInPandas(_attacher(rounds[i].columns), out)
        if i == 0:
            return given
        upper = store(given.select("tree", F.col("pos").alias("block"), F.col("witness").alias("up"), "subroot"), "merkle-witness")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """``id_col, group_col, leaf, subroot, root, witness`` and what ``carry`` computes, for every row.

    ``witness`` has a level for each ``;``, from the leaf to the root: the joined siblings on its left and right, parted by a comma.
    """
    more = carry or {}
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("tree"), leaf(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(k) for k, c in more.items()])
    rounds, roots = grow(positions(rows, "tree", ["id", "digest"], "merkle-leaves"))
    groups = positions(roots.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "digest"), "tree", ["group"], "merkle-groups")
    top_rounds, top = grow(groups)
    last = top.select("digest").first()  # one digest
    root = F.lit(last["digest"] if last else None).cast("string")
    over = top.select("tree", F.lit("").alias("up"), F.col("digest").alias("subroot"))
    above = witnessed(top_rounds, over).select(F.col("group").alias("tree"), F.col("witness").alias("up"), F.col("digest").alias("subroot"))
    found = witnessed(rounds, store(above, "merkle-above"))
    return found.select(F.col("id").alias(id_col), F.col("tree").alias(group_col), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "witness", *more)


def siblings(witness: Column) -> Column:
    """All siblings' digests, level by level, left to right, as one text."""
    return F.regexp_replace(witness, "[,;]", "")


def folded(start: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    levels = F.when(witness == "", F.array().cast("array<string>")).otherwise(F.split(witness, ";"))
    return F.aggregate(levels, start, lambda d, level: F.sha2(F.concat(F.substring_index(level, ",", 1), d, F.substring_index(level, ",", -1)), 256))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


#: The fields of a document, in the order in which they are hashed.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tamper_check(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs``, and whether each row, lower-cased where 3 divides the checksum of its id, still folds to the root."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = F.when(chosen, leaf(*[lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]))
    rows = manifest(docs, FIELDS, carry={"changed": changed})
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("witness")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Trees as recursive steps; CRC-32 by its table.
SQL = """
WITH RECURSIVE steps AS (
  SELECT list(CAST(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY i) AS t
  FROM range(256) AS r(i)
), hashed AS (
  SELECT doc_id, lang, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
    coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x))),
        lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 3 = 0 AS chosen
  FROM documents, steps
), leaves AS (
  SELECT doc_id, lang, sha256(head || body) AS leaf, CASE WHEN chosen THEN sha256(head || low) ELSE sha256(head || body) END AS start,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS d FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 8, n
), subroots AS (
  SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, d FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n
), runs AS (SELECT lang, level, pos // 8 AS run, list(d ORDER BY pos) AS ds FROM tree WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 8 AS run, list(d ORDER BY pos) AS ds FROM top WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, lang, leaf, 0 AS level, pos, n, '' AS proof, start AS fold FROM leaves
  UNION ALL
  SELECT doc_id, w.lang, leaf, w.level + 1, pos // 8, (n + 7) // 8,
    proof || array_to_string(ds[:pos % 8], '') || array_to_string(ds[pos % 8 + 2:], ''),
    sha256(array_to_string(ds[:pos % 8], '') || fold || array_to_string(ds[pos % 8 + 2:], ''))
  FROM walk w JOIN runs r ON r.lang IS NOT DISTINCT FROM w.lang AND r.level = w.level AND r.run = w.pos // 8 WHERE n > 1
), climb AS (
  SELECT doc_id, leaf, s.d AS subroot, 0 AS level, s.pos, s.n, proof, fold FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, c.level + 1, pos // 8, (n + 7) // 8,
    proof || array_to_string(ds[:pos % 8], '') || array_to_string(ds[pos % 8 + 2:], ''),
    sha256(array_to_string(ds[:pos % 8], '') || fold || array_to_string(ds[pos % 8 + 2:], ''))
  FROM climb c JOIN top_runs r ON r.level = c.level AND r.run = c.pos // 8 WHERE n > 1
)
SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT d FROM top WHERE n = 1) AS verified
FROM climb WHERE n = 1
"""
