"""The prefix trie of conversations, from the common prefixes of neighbours in one global order.

1. A turn becomes a digest of its role and text, a conversation the string of its digests.
2. All conversations are range-sorted by that string, then by id, so that copies of one conversation are dealt over
   as many tasks as they need, and a node's members stand side by side.
3. Each task sweeps its rows with a stack of open nodes: the common prefix of neighbours says which nodes end and
   which begin. A node that holds neither the task's first nor its last row is complete, with all below it.
4. The others, the open stacks at the borders of tasks, are pieces of nodes that may go on in the next task. Each piece
   counts as if its task were alone; the common prefix of the rows at the border then says which nodes were begun
   earlier (their child, their words once more) and whether the task's last row is a leaf. After that the pieces of a
   node just add up.

A row takes 16 bytes for each turn; a task holds the ids and unfinished nodes of its own rows. The ids of members
that end in an open node are hashed from chunks, in order, so a node may have any number of them.

Rows without a conversation are left out. Turns of one number come by digest, null ones first; repeated rows count
as turns. Null roles and texts are empty. An empty table has no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from fewstep.plans.storage import Scratch, join_small
from fewstep.sources.tables import table

#: Bytes of a turn's digest (of SHA-256).
DIGEST = 16
#: Every GROUP-th conversation lends the ones after it up to LENT turns, in the rebuilt conversations.
GROUP, LENT = 20, 3
#: Ids in a chunk, and rows that a task hands over at once.
CHUNK, ROWS = 1 << 15, 1 << 13
WORD = r"[^\x20\x09-\x0D]+"

#: What the sweep writes. kind 0: a complete node, 1: a piece of an open node, 2: the borders of a task, 3: ids that end in a piece.
_SWEPT = """kind int, task int, number long, parent long, depth long, node string, parent_node string, conv_id long, parent_conv_id long,
n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, is_first boolean, is_last boolean, words_before long,
first binary, last binary, words array<long>, chunk int, ids string"""
_FIELDS = [x.split() for x in _SWEPT.replace("\n", " ").split(",")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, digest, words) in order, of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations whose first turns, 0 to LENT by their id, are those of the first of their group of GROUP ids."""
    first = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("lender"), F.slice("turns", 1, LENT).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LENT + 1)).cast("int")
    rows = convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "lender", "left").withColumn("h", h)
    lent = F.when(F.col("lent").isNotNull(), F.slice("lent", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(lent, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class _Node:
    """A node that a task has begun. first: it holds the task's first row, so an earlier task may have begun it."""

    __slots__ = ("number", "depth", "words", "first", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, number: int, depth: int, words: int, first: bool):
        self.number, self.depth, self.words, self.first = number, depth, words, first
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting = array("q"), []

    def add(self, conv: int, n: int) -> None:
        self.conv, self.n = conv if self.conv is None else min(self.conv, conv), self.n + n


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two conversations have in common at their start."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // DIGEST
    low, high = 0, size // DIGEST  # a[:low] is equal, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid)
    return low


def _name(key: bytes, depth: int) -> str | None:
    return hashlib.sha256(key[: depth * DIGEST]).hexdigest()[:32] if depth >= 0 else None


def _told(ids: array) -> str:
    return ",".join(map(str, ids))


class _Sweep:
    """The stack of a task's open nodes, and what is ready to be written."""

    def __init__(self, task: int):
        self.task, self.stack, self.ready, self.made, self.first, self.last, self.words = task, [], [], 0, None, None, None

    def row(self, key: bytes, words: list[int], conv: int) -> None:
        begun = -1 if self.last is None else _shared(self.last, key)
        while self.stack and self.stack[-1].depth > begun:
            self.close(self.last, False)
        for depth in range(begun + 1, len(words) + 1):
            self.stack.append(_Node(self.made, depth, int(words[depth - 1]) if depth else 0, self.last is None))
            self.made += 1
        if self.last is None:
            self.first, self.words = key, words
        self.last = key
        self.stack[-1].add(conv, 1)
        self.stack[-1].ends.append(conv)

    def close(self, key: bytes, at_end: bool) -> None:
        """Takes the deepest node off the stack; key: a row in it."""
        v, up = self.stack.pop(), self.stack[-1] if self.stack else None
        leaves, saved = v.leaves if v.children else 1, v.saved + (v.n - 1) * v.words
        if up:
            up.add(v.conv, v.n)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        row = {"depth": v.depth, "conv_id": v.conv, "n_convs": v.n, "n_children": v.children, "n_leaves": leaves, "saved_tokens": saved}
        if v.first or at_end:
            self.ready += v.waiting
            node, before = _name(key, v.depth), sum(self.words[: max(0, v.depth - 1)]) if v.first else 0
            self.ready.append(row | {"kind": 1, "number": v.number, "node": node, "parent_node": _name(key, v.depth - 1), "is_first": v.first, "is_last": at_end, "words_before": before})
            self.ready += [{"kind": 3, "node": node, "chunk": k, "ids": _told(v.ends[at : at + CHUNK])} for k, at in enumerate(range(0, len(v.ends), CHUNK))]
            return
        self.ready += [x | {"parent": None, "parent_conv_id": v.conv} for x in v.waiting]
        row |= {"kind": 0, "parent": up.number, "ends_sha256": hashlib.sha256(_told(v.ends).encode()).hexdigest()}
        (self.ready if up.first else up.waiting).append(row)

    def end(self) -> None:
        if self.last is not None:
            while self.stack:
                self.close(self.last, True)
            self.ready.append({"kind": 2, "first": self.first, "last": self.last, "words": self.words})

    def batches(self, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        while len(self.ready) >= ROWS or (all_of_it and self.ready):
            rows, self.ready = self.ready[:ROWS], self.ready[ROWS:]
            columns = [pa.array([self.task if name == "task" else x.get(name) for x in rows], _KINDS[kind]) for name, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays(columns, [name for name, _ in _FIELDS])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(TaskContext.get().partitionId())
    for batch in batches:
        for key, words, conv in zip(batch.column("key").to_pylist(), batch.column("words").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            sweep.row(key, words, conv)
        yield from sweep.batches(False)
    sweep.end()
    yield from sweep.batches(True)


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _shared(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each node's ids, from chunks that come in order."""
    node, sha = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch["node"], batch["ids"], strict=True):
            if name != node:
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = name, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    yield pd.DataFrame([] if node is None else [(node, sha.hexdigest())], columns=["node", "ends_sha256"])


def _borders(swept: DataFrame) -> DataFrame:
    """Of each task that had rows (task): how many turns its first row shares with the row before (begun, -1 for the first task),
    their words, and whether the next row continues its last one (goes_on). As many rows as there are tasks."""
    by_task = Window.orderBy("task")
    rows = swept.where("kind = 2").select("task", "first", "last", "words")
    rows = rows.withColumn("before", F.lag("last").over(by_task)).withColumn("begun", F.coalesce(_common("before", "first"), F.lit(-1)))
    rows = rows.withColumn("goes_on", F.coalesce(F.lead("begun").over(by_task) * DIGEST == F.octet_length("last"), F.lit(False)))
    words = F.aggregate(F.slice("words", F.lit(1), F.greatest("begun", F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("task", "begun", words.alias("begun_words"), "goes_on")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, unique; turns: an array of turn, digest, words)."""
    scratch = Scratch(convs.sparkSession, "trie")
    keyed = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("key"), F.transform("turns", lambda x: x["words"]).alias("words"))
    keyed = scratch.stash(keyed)
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.stash(ordered.mapInArrow(_swept, _SWEPT))
    scratch.drop(keyed)

    pieces = swept.where("kind = 1").join(F.broadcast(_borders(swept)), "task")
    shared = F.col("is_first") & (F.col("depth") <= F.col("begun"))
    added = F.when(shared, F.col("begun_words") - F.col("words_before")).otherwise(0)
    not_new = F.when(F.col("is_first") & (F.col("depth") < F.col("begun")), 1).otherwise(0)
    no_leaf = F.when(F.col("is_last") & F.col("goes_on"), 1).otherwise(0)
    whole = pieces.groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent_node").alias("parent_node"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum(F.col("n_children") - not_new).alias("n_children"),
        F.sum(F.col("n_leaves") - no_leaf).alias("n_leaves"), F.sum(F.col("saved_tokens") + added).alias("saved_tokens"),
    )
    chunks = swept.where("kind = 3").select("node", "task", "chunk", "ids")
    hashed = chunks.repartition("node").sortWithinPartitions("node", "task", "chunk").mapInPandas(_hashed, "node string, ends_sha256 string")
    whole = scratch.stash(whole.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))

    parents = whole.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    opened = join_small(whole, parents, "parent_node", "left").select(*_OUT)
    numbers = swept.where("kind = 1").select("task", F.col("number").alias("parent"), F.col("node").alias("parent_node"))
    at = join_small(numbers, parents, "parent_node").select("task", "parent", "parent_conv_id")
    complete = swept.where("kind = 0")
    below = join_small(complete.where("parent IS NOT NULL").drop("parent_conv_id"), at, ["task", "parent"]).select(*_OUT)
    return opened.unionByName(complete.where("parent IS NULL").select(*_OUT)).unionByName(below)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(Scratch(spark, "turns").stash(sequences(turns))))


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list({'d': d, 'w': words} ORDER BY turn NULLS FIRST, d) AS a FROM t GROUP BY c),
bits AS (SELECT c, a, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END) AS r FROM s),
h AS (SELECT c, a, xor(r, 4294967295::BIGINT) % 4 AS h FROM bits),
b AS (SELECT x.c, list_concat(coalesce(y.a, [])[1:x.h], x.a[x.h + 1:]) AS a FROM h x LEFT JOIN s y ON y.c = x.c - x.c % 20),
p AS (SELECT c, a, unnest(range(len(a) + 1)) AS depth FROM b),
m AS (SELECT c, depth, list_transform(a[1:depth], lambda x: x.d) AS node, depth = len(a) AS ends, CASE WHEN depth > 0 THEN a[depth].w ELSE 0 END AS w FROM p),
n AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT node[1:e] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (node) LEFT JOIN f q ON q.node = f.node[1:f.depth - 1] AND q.depth = f.depth - 1
"""
