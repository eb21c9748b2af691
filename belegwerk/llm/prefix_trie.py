"""The trie of conversation prefixes, peeled from its deepest turns up to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.common import WORD
from belegwerk.operators.joins import salted_join
from belegwerk.workspace import Workspace, empty

EVERY = 20
SHARED = 4
# Levels down to here are peeled one by one by Spark; below them a task peels several at once.
SINGLE = 8
# Turns below one base prefix that a task may hold; if some prefix has more, its levels are peeled one by one.
GROUP_TURNS = 200_000
# Keys that a chunk of an ended conversation's list holds.
CHUNK_KEYS = 1 << 18
ROOT = b"\0" * 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

# One turn: 128 bits that stand for role and text, and the words of the text.
TURN = "struct<a:long,b:long,w:long>"
ITEM = "key binary, at int, keys binary, words array<long>, conv_id long, n_convs long, n_children long, n_leaves long, saved long"
NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turn_lists(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``c, turns``: the turns of each conversation in order, as hashes, so that no text is moved."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    words = F.when(text == "", 0).otherwise(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")))
    row = F.struct(
        F.col(turn).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), role, text).alias("b"), words.cast("long").alias("w")
    )
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), row.alias("t"))
    # sort_array puts null turns first, equal turns by role, then by hash.
    lists = rows.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("c", F.transform("t", lambda t: F.struct(t.a.alias("a"), t.b.alias("b"), t.w.alias("w"))).alias("turns"))


def rebuilt(lists: DataFrame, every: int = EVERY, shared: int = SHARED) -> DataFrame:
    """``c, turns``: the first turns of the conversation at the last multiple of ``every``, then the own ones."""
    head = F.crc32(F.col("c").cast("string").cast("binary")) % shared
    starts = lists.where(F.col("c") % every == 0).select(F.col("c").alias("base"), F.slice("turns", 1, shared).alias("first"))
    own = lists.withColumn("base", F.col("c") - F.col("c") % every).withColumn("h", head.cast("int"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(f"array<{TURN}>"))
    return own.join(starts, "base", "left").select("c", F.concat(first, rest).alias("turns"))


def prefix_keys(convs: DataFrame) -> DataFrame:
    """``c, size, key, keys, words``: 128 bits for each prefix, chained from turn to turn, joined in ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch["turns"]
            ends = np.cumsum(np.diff(turns.offsets.to_numpy())).tolist()
            flat = turns.flatten()
            # A turn's 16 bytes, side by side.
            pairs = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype("<i8").tobytes()
            keys, last, low = [], [], 0
            for high in ends:
                at, chain = ROOT, []
                for i in range(low, high):
                    at = hashlib.blake2b(at + pairs[16 * i : 16 * i + 16], digest_size=16).digest()
                    chain.append(at)
                keys.append(b"".join(chain))
                last.append(at)
                low = high
            words = pa.ListArray.from_arrays(np.array([0, *ends], np.int32), flat.field(2))
            sizes = pa.array([len(k) // 16 for k in keys], pa.int32())
            columns = [batch["c"], sizes, pa.array(last, pa.binary()), pa.array(keys, pa.binary()), words]
            yield pa.RecordBatch.from_arrays(columns, ["c", "size", "key", "keys", "words"])

    return convs.mapInArrow(run, "c long, size int, key binary, keys binary, words array<long>")


def _key_at(depth: int) -> Column:
    """The key of the first ``depth`` turns."""
    return F.substring("keys", 16 * (depth - 1) + 1, 16) if depth else F.lit(ROOT)


def _merged(items: DataFrame, depth: int) -> DataFrame:
    """One row a node of ``depth``: what ends there and what was peeled off below, added up."""
    # The words of a node's last text; the root has none.
    last = F.coalesce(F.try_element_at("words", F.lit(depth)), F.lit(0)) if depth else F.lit(0)
    found = items.groupBy("key").agg(
        F.first("keys").alias("keys"),
        F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"),
    )
    return found.select(
        "key",
        F.lit(depth).alias("at"),
        "keys",
        "words",
        "conv_id",
        "n_convs",
        "n_children",
        F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved"),
    )


def _node(items: DataFrame, depth: int) -> DataFrame:
    parent = _key_at(depth - 1) if depth else F.lit(None).cast("binary")
    return items.select("key", parent.alias("parent"), F.col("at").cast("long").alias("depth"), "conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of ``depth`` as items of their parents: the last turn is gone, each is one child."""
    return nodes.select(
        _key_at(depth - 1).alias("key"),
        F.lit(depth - 1).alias("at"),
        F.substring("keys", 1, 16 * (depth - 1)).alias("keys"),
        F.slice("words", 1, depth - 1).alias("words"),
        "conv_id",
        "n_convs",
        F.lit(1).cast("long").alias("n_children"),
        "n_leaves",
        "saved",
    )


def peel(rows: list[tuple], low: int) -> tuple[list[tuple], list[tuple]]:
    """Nodes deeper than ``low``, and the items these leave at ``low``, of all items below one prefix.

    A row is an item as in ``ITEM``. From the deepest level up, what ends at a level and what survives from
    the level below are merged by key, and the last turn is stripped.
    """
    ended: dict[int, list[tuple]] = {}
    for row in rows:
        ended.setdefault(row[1], []).append(row)
    nodes, alive = [], []
    depth = max(ended, default=low)
    while depth > low:
        level: dict[bytes, list] = {}
        for key, _, keys, words, conv, n, children, leaves, saved in [*ended.get(depth, ()), *alive]:
            at = level.get(key)
            if at is None:
                level[key] = [keys, words, conv, n, children, leaves, saved]
            else:
                at[2] = min(at[2], conv)
                at[3] += n
                at[4] += children
                at[5] += leaves
                at[6] += saved
        alive = []
        for key, (keys, words, conv, n, children, leaves, saved) in level.items():
            leaves, saved = max(leaves, 1), saved + (n - 1) * int(words[depth - 1])
            parent = keys[16 * (depth - 2) : 16 * (depth - 1)] if depth > 1 else ROOT
            nodes.append((key, parent, depth, conv, n, children, leaves, saved))
            alive.append((parent, depth - 1, keys, words, conv, n, 1, leaves, saved))
        depth -= 1
    left = [(key, at, keys[: 16 * low], words[:low], *rest) for key, at, keys, words, *rest in [*ended.get(low, ()), *alive]]
    return nodes, left


def _peel_tasks(ws: Workspace, items: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """Nodes deeper than ``low`` and the items left at ``low``; a task holds one base prefix at a time."""
    names = [f.split(" ")[0] for f in NODE.split(", ")] + ["keys", "words", "at"]
    kinds = {"key": pa.binary(), "parent": pa.binary(), "keys": pa.binary(), "words": pa.list_(pa.int64()), "at": pa.int32()}
    schema = f"{NODE}, keys binary, words array<long>, at int"
    order = [f.split(" ")[0] for f in ITEM.split(", ")]

    def batch_of(nodes: list[tuple], left: list[tuple]) -> pa.RecordBatch:
        rows = [(*n, None, None, None) for n in nodes]
        rows += [(key, None, None, conv, n, children, leaves, saved, keys, words, at) for key, at, keys, words, conv, n, children, leaves, saved in left]
        columns = [pa.array([r[i] for r in rows], kinds.get(name, pa.int64())) for i, name in enumerate(names)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, group = None, []
        nodes, left = [], []
        for batch in batches:
            columns = [batch[name].to_pylist() if name != "words" else [x.values.to_numpy() for x in batch[name]] for name in order]
            for b, row in zip(batch["base"].to_pylist(), zip(*columns)):
                if b != base and group:
                    for out, more in zip((nodes, left), peel(group, low)):
                        out += more
                    group = []
                    if len(nodes) > 1 << 14:
                        yield batch_of(nodes, left)
                        nodes, left = [], []
                base = b
                group.append(row)
        for out, more in zip((nodes, left), peel(group, low)):
            out += more
        yield batch_of(nodes, left)

    dealt = items.withColumn("base", _key_at(low)).repartition("base").sortWithinPartitions("base")
    made = ws.stage(dealt.mapInArrow(run, schema), f"peeled{low}")
    nodes = made.where("depth is not null").select(*[f.split(" ")[0] for f in NODE.split(", ")])
    left = made.where("depth is null").withColumnRenamed("saved_tokens", "saved").select(*order)
    return nodes, left


def _ends(ws: Workspace, convs: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the prefixes at which conversations end; the digest is taken from a stream.

    A conversation that very many others repeat has a list of any length. The rows are cut into even
    slices by key and number, each slice writes its numbers in chunks, and the task that has a key reads
    its chunks in order: it holds one chunk at a time.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "first", "list"])

        key, held, rows, size = None, [], [], 0
        for batch in batches:
            for k, c in zip(batch["key"].to_pylist(), batch["c"].to_pylist()):
                if held and (k != key or len(held) >= CHUNK_KEYS):
                    rows.append((key, held[0], ",".join(map(str, held))))
                    size += len(held)
                    held = []
                    if size >= CHUNK_KEYS:
                        yield sent(rows)
                        rows, size = [], 0
                key = k
                held.append(c)
        if held:
            rows.append((key, held[0], ",".join(map(str, held))))
        yield sent(rows)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, out = [], []
            for k, text in zip(batch["key"].to_pylist(), batch["list"]):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        out.append(state.hexdigest())
                    key, state = k, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    slices = convs.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c")
    chunks = slices.mapInArrow(chunk, "key binary, first long, list string")
    lists = chunks.repartition("key").sortWithinPartitions("key", "first")
    return ws.stage(lists.mapInArrow(digest, "key binary, ends_sha256 string"), "ends")


def bands(deepest: int, single: int = SINGLE) -> list[tuple[int, int]]:
    """Runs of levels ``(low, high]`` from the deepest up; each below ``single`` is as long as all above it."""
    out, low = [], single
    while low < deepest:
        out.append((low, min(2 * low, deepest)))
        low *= 2
    return out[::-1]


def trie(
    ws: Workspace,
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    every: int = EVERY,
    shared: int = SHARED,
    single: int = SINGLE,
    group_turns: int = GROUP_TURNS,
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node.

    Conversations are rebuilt (``rebuilt``), then the trie of their prefixes is found by peeling: from the
    deepest turn up, conversations that end at a level join the nodes that survive from below, and
    all are regrouped by their prefix without the last turn. Equal conversations are one item from the
    start. Each regrouping yields the level's nodes with all their sums, so no pass looks for nodes
    first. Levels deeper than ``single`` are peeled in runs that double in length, each in one job whose
    tasks take whole subtrees; if a subtree is larger than ``group_turns``, that run is peeled level by
    level with partial sums, where no prefix is too common.

    Rows with a null key are no conversation. Null turns come first, equal turns in the order of role and
    then of a hash of their text; repeated rows are turns of their own. Null roles and texts are
    empty. A conversation is one row of 32 bytes a turn; its texts are never moved. An empty table has no node.
    """
    lists = ws.stage(turn_lists(conversations, conv, turn, role, text), "turns")
    convs = ws.stage(prefix_keys(rebuilt(lists, every, shared)), "prefixes")
    classes = convs.groupBy("key").agg(
        F.first("size").alias("at"), F.first("keys").alias("keys"), F.first("words").alias("words"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    )
    zero = F.lit(0).cast("long")
    classes = classes.select("key", "at", "keys", "words", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"))
    classes = ws.stage(classes, "ended")
    deepest = classes.agg(F.max("at")).first()[0]
    if deepest is None:
        return empty(ws.spark, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    found: list[DataFrame] = []
    alive: DataFrame | None = None

    def with_ended(low: int, high: int) -> DataFrame:
        ended = classes.where((F.col("at") > low) & (F.col("at") <= high))
        return ended if alive is None else ended.unionByName(alive)

    def one_by_one(low: int, high: int) -> None:
        nonlocal alive
        for depth in range(high, low, -1):
            level = ws.stage(_merged(with_ended(depth - 1, depth), depth), f"level{depth}")
            found.append(_node(level, depth))
            alive = _stripped(level, depth) if depth else None

    for low, high in bands(deepest, single):
        items = with_ended(low, high)
        sizes = items.groupBy(_key_at(low).alias("base")).agg(F.sum(F.col("at") - low).alias("turns"))
        if sizes.agg(F.max("turns")).first()[0] > group_turns:
            one_by_one(low, high)
        else:
            nodes, alive = _peel_tasks(ws, items, low)
            found.append(nodes)
    one_by_one(-1, min(single, deepest))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    nodes = ws.stage(nodes.join(_ends(ws, convs), "key", "left"), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return salted_join(nodes, parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


# DuckDB has no crc32: the usual table of 256 entries, then one step a byte.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {SHARED} AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
built AS (
  SELECT h.c, 0 AS own, t.pos, t.turn FROM heads h JOIN turns t ON t.c = h.c - h.c % {EVERY} AND t.pos <= h.h
  UNION ALL SELECT h.c, 1, t.pos, t.turn FROM heads h JOIN turns t ON t.c = h.c AND t.pos > h.h),
whole AS (
  SELECT h.c, coalesce(list(b.turn ORDER BY own, pos) FILTER (b.turn IS NOT NULL), []) AS turns
  FROM heads h LEFT JOIN built b ON h.c = b.c GROUP BY h.c),
prefixes AS (SELECT c, len(turns) AS size, d, turns[:d] AS path FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '{WORD}')) END AS words
  FROM prefixes GROUP BY path, d),
kids AS (SELECT path[:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
marked AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.path = k.path),
sums AS (
  SELECT path[:up] AS path, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM marked) GROUP BY 1, 2)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM marked m JOIN sums s ON m.d = s.d AND m.path = s.path
LEFT JOIN nodes p ON m.d > 0 AND p.d = m.d - 1 AND p.path = m.path[:m.d - 1]
"""
