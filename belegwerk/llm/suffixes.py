"""Removal of long repeated byte strings, by merging Burrows-Wheeler transforms of shards.

Only strings that may repeat meet. Each window of ``LENGTH`` bytes belongs to the k-gram inside it
with the least hash, its anchor, so equal windows have equal anchors at equal places. Neighbouring
windows with one anchor form a segment. Segments whose anchor stands nowhere else are done; of equal
segments all but the earliest are repeats. What is left are different segments around one anchor. They
are dealt into bins by anchor; in a bin they are cut into shards, each shard gets its
Burrows-Wheeler transform, and the transforms are merged by refining their interleave one symbol at a
time, without sorting suffixes anew. Blocks of the merged order that share ``LENGTH`` bytes are the
repeated intervals.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.llm.common import spread_rows
from belegwerk.workspace import Workspace

LENGTH = 100
GRAM = 32
# Bytes of a symbol of the transforms; LENGTH is a multiple of it.
SYMBOL = 4
SHARD_BYTES = 1 << 16
BIN_BYTES = 1 << 20
# Rows of one anchor from which its segments are cut into single windows, which spread by content.
HOT_ROWS = 1_000_000
ROWS_PER_TASK = 600_000
# Different segments of one anchor from which they are cut into single windows too, which keeps bins small.
DENSE_ROWS = 30_000
# Longer texts are looked at in overlapping pieces.
PIECE = 1 << 22

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = 22
_BITS = 10


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: bytes, size: int = GRAM) -> np.ndarray:
    """64-bit hashes of all grams of ``size`` bytes, a multiple of eight."""
    n = len(data) - size + 1
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = _mix(eights[:n].copy())
    for at in range(8, size, 8):
        h = _mix(h * _M2 + eights[at : at + n])
    return h


def segments(data: bytes, length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor place, first byte and length of each segment of ``data``, in order."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for low in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[low : low + PIECE + length - 1]
        if len(piece) < length:
            break
        h = gram_hashes(piece, size)
        # The hash keeps its high bits and the place fills the low ones, so the least is the leftmost.
        low_bits = np.uint64((1 << _LOW) * 2 - 1)
        least = (h & ~low_bits) | np.arange(len(h), dtype=np.uint64)
        have, width = 1, length - size + 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & low_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, len(place)))
        for part, values in zip(parts, (h[place[first]], place[first] + low, first + low, count + length - 1)):
            part.append(values)
    if not parts[0]:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(p) for p in parts)


def pack(start: np.ndarray, length: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (start << 2 * _BITS) | (length << _BITS) | anchor


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << _BITS) - 1
    return at >> 2 * _BITS, (at >> _BITS) & mask, at & mask


def _rows_of(data: bytes, hot: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, content hash and packed place of the segments of one text; hot segments as single windows."""
    key, place, start, long = segments(data, length, size)
    if len(hot) and len(key):
        cut = np.isin(key, hot)
        if cut.any():
            n = long[cut] - length + 1
            first = np.repeat(start[cut] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            place = np.concatenate((place[~cut], np.repeat(place[cut], n)))
            start = np.concatenate((start[~cut], first))
            long = np.concatenate((long[~cut], np.full(len(first), length)))
            key = np.concatenate((key[~cut], np.zeros(len(first), np.uint64)))
    view = memoryview(data)
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (start + long).tolist())), np.uint64, len(start))
    if len(hot):
        single = np.flatnonzero(key == 0)
        key[single] = [xxhash.xxh3_64_intdigest(view[a : a + length], 1) for a in start[single].tolist()]
    return key, content, pack(start, long, place - start)


def merge_transforms(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``depth`` symbols, and the block of each place.

    ``shards`` are Burrows-Wheeler transforms. The interleave, the shard of each place, starts with one
    shard after the other. A step lets each place take the symbol of its shard's transform and deals
    the places by it, stably: an order by ``d`` symbols becomes one by ``d + 1``, since the order
    within each shard is right already. A block, places with an equal prefix, splits where symbols
    differ; the step at which it splits is the length of the common prefix there.
    """
    symbols = np.concatenate(shards)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s) for s in shards])
    block = np.zeros(len(symbols), np.int32)
    small = np.uint16 if int(symbols.max(initial=0)) < 1 << 16 else np.uint32
    symbols = symbols.astype(small)
    here = np.empty_like(symbols)
    for _ in range(depth):
        here[np.argsort(shard, kind="stable")] = symbols
        turn = np.argsort(here, kind="stable")
        shard, ordered, before = shard[turn], here[turn], block[turn]
        block = np.zeros(len(turn), np.int32)
        np.cumsum((ordered[1:] != ordered[:-1]) | (before[1:] != before[:-1]), out=block[1:])
    return shard, block


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of the cyclic ``text`` and its suffix order, by prefix doubling."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], sorted_rank[1:] != sorted_rank[:-1])))
        if step >= n or int(new.max(initial=0)) == n - 1:
            return text[order - 1], order
        rank = new * n + np.roll(new, -step)
        order = np.argsort(rank, kind="stable")
        step *= 2


def repeated_windows(parts: list[bytes], length: int = LENGTH, symbol: int = SYMBOL, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, ...]:
    """Class, part and offset of every window of ``length`` bytes that stands more than once in ``parts``.

    A symbol is ``symbol`` bytes; each part is written once per phase, so every window starts a run
    of whole symbols somewhere. Parts must be different, or the same window is found in each copy.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    joined = np.frombuffer(b"".join(parts) + bytes(symbol), np.uint8)
    grams = np.zeros(len(joined) - symbol, np.uint64)
    for i in range(symbol):
        grams = grams << np.uint64(8) | joined[i : i + len(grams)]
    first = np.cumsum(sizes) - sizes
    # All phases of all parts: part, byte of each symbol; -1 ends each phase.
    places = []
    for at, n in zip(first.tolist(), sizes.tolist()):
        for phase in range(symbol):
            places.append(np.arange(at + phase, at + n - symbol + 1, symbol, dtype=np.int32))
            places.append(np.full(1, -1, np.int32))
    place = np.concatenate(places)
    _, dense = np.unique(grams[place], return_inverse=True)
    text = np.where(place >= 0, dense + 1, 0).astype(np.int32)
    del dense
    cuts, last, total = [0], 0, 0
    ends = np.cumsum([sum(len(p) for p in places[i : i + 2 * symbol]) for i in range(0, len(places), 2 * symbol)])
    for end in ends.tolist():
        if end - last >= shard_bytes or end == ends[-1]:
            cuts.append(end)
            last = end
    texts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    pairs = [transform(t) for t in texts]
    shard, block = merge_transforms([p[0] for p in pairs], length // symbol)
    # The r-th place of a shard in the interleave is the r-th suffix of that shard.
    at = np.empty(len(shard), np.int64)
    at[np.argsort(shard, kind="stable")] = np.concatenate([p[1] + a for p, a in zip(pairs, cuts)])
    byte = place[at]
    part = np.searchsorted(first, byte, side="right") - 1
    offset = byte - first[part]
    whole = (byte >= 0) & (offset + length <= sizes[part])
    block, part, offset = block[whole], part[whole], offset[whole]
    many = np.bincount(block, minlength=1)[block] > 1
    return block[many], part[many], offset[many]


def bin_repeats(key: np.ndarray, doc: np.ndarray, at: np.ndarray, data: list[bytes], length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """``doc, start`` of the windows in the segments of one bin that also start earlier in the bin.

    Each segment is halved first: every window reaches ``half`` bytes to the left of the anchor or as
    many to the right of it. Halves whose longer anchor stands alone hold no repeat, and of equal
    halves the earliest stands for all; the rest goes through the transforms.
    """
    start, _, anchor = unpack(at)
    half = -(-(length - size) // 2)
    halves: dict[bytes, dict[bytes, list[tuple[int, int]]]] = {}
    for d, s, a, text in zip(doc.tolist(), start.tolist(), anchor.tolist(), data):
        if a >= half:
            halves.setdefault(b"l" + text[a - half : a + size], {}).setdefault(text[: a - half + length], []).append((d, s))
        low = max(0, a - half + 1)
        if len(text) - low >= length:
            halves.setdefault(b"r" + text[a : a + size + half], {}).setdefault(text[low:], []).append((d, s + low))
    docs, starts, parts, owners = [], [], [], []
    for different in halves.values():
        for text, places in different.items():
            least = min(places)
            n = len(text) - length + 1
            for d, s in places:
                if (d, s) != least:
                    docs.append(np.full(n, d))
                    starts.append(np.arange(s, s + n))
            if len(different) > 1:
                parts.append(text)
                owners.append(least)
    if parts:
        block, part, offset = repeated_windows(parts, length)
    if parts and len(block):
        owner = np.array(owners, np.int64)
        d, s = owner[part, 0], owner[part, 1] + offset
        order = np.lexsort((s, d, block))
        block, d, s = block[order], d[order], s[order]
        head = np.concatenate(([True], block[1:] != block[:-1]))
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        late = (d != d[first]) | (s != s[first])
        docs.append(d[late])
        starts.append(s[late])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(starts)


def runs_of(doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs ``doc, start, length`` of bytes that the windows at ``start`` cover, per unbroken row of starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    head = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > 1)))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] - start[first] + length


def _settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: they go with their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_anchors(docs: DataFrame, rows: int = HOT_ROWS, length: int = LENGTH, size: int = GRAM) -> np.ndarray:
    """Anchors with about ``rows`` segments or more; the choice changes how rows are dealt, not the result.

    A batch reports the anchors that take a thousandth of its segments, so the list is short.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [segments(t.as_py().encode(), length, size)[0] for t in batch["text"] if t.is_valid]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_counts=True)
            often = n * 1000 >= max(n.sum(), 1000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["key", "n"])

    found = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = found.where(F.col("n") * 2 >= rows).orderBy(F.desc("n")).limit(2000).collect()
    return np.array([r.key for r in hot], np.int64).view(np.uint64)


def repeats(
    ws: Workspace,
    docs: DataFrame,
    length: int = LENGTH,
    size: int = GRAM,
    hot_rows: int = HOT_ROWS,
    dense_rows: int = DENSE_ROWS,
    bin_bytes: int = BIN_BYTES,
) -> DataFrame:
    """Runs ``doc_id, start, n`` of bytes in ``docs(doc_id, text)`` covered by strings that also start earlier."""
    spark = docs.sparkSession
    rows_in = docs.where("doc_id is not null and text is not null")
    volume = rows_in.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # So few bytes cannot hold a hot anchor.
    hot = hot_anchors(rows_in, hot_rows, length, size) if volume > hot_rows * length // 2 else np.zeros(0, np.uint64)
    hot.sort()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_rows_of(t.as_py().encode(), hot, length, size) for t in batch["text"]]
            if not found:
                continue
            key, content, at = (np.concatenate([f[i] for f in found]) for i in range(3))
            doc = np.repeat(batch["doc_id"].to_numpy(), [len(f[0]) for f in found])
            # Equal segments of a batch: the earliest goes on, the others are repeats for sure.
            order = np.lexsort((at, doc, content, key))
            key, content, at, doc = key[order], content[order], at[order], doc[order]
            sure = np.zeros(len(key), bool)
            sure[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            head = np.maximum.accumulate(np.where(sure, 0, np.arange(len(key))))
            same = sure & (doc == doc[head]) & (at == at[head])
            # Repeats need no partner any more and are dealt by their place.
            key = np.where(sure, _mix(doc.astype(np.uint64) * _M2 + at.astype(np.uint64)), key)
            keep = ~same
            columns = (key.view(np.int64), content.view(np.int64), doc, at)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), pa.array(sure[keep])], ["key", "content", "doc_id", "at", "sure"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("sure", pa.bool_())]))
        key, content, doc, at, sure = (c.to_numpy() for c in table.columns)
        del table
        out = [(key[sure], doc[sure], at[sure], np.zeros(int(sure.sum()), bool))]
        key, content, doc, at = key[~sure], content[~sure], doc[~sure], at[~sure]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        again = np.zeros(len(key), bool)
        again[1:] = ordered[1:] == ordered[:-1]
        again[:-1] |= again[1:]
        order = order[again]
        key, content, doc, at = key[order], content[order], doc[order], at[order]
        if len(key):
            order = np.lexsort((at, doc, content, key))
            key, content, doc, at = key[order], content[order], doc[order], at[order]
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            late = (doc != doc[head]) | (at != at[head])
            out.append((key[late], doc[late], at[late], np.zeros(int(late.sum()), bool)))
            group = np.cumsum(new_key) - 1
            mixed = new & (np.bincount(group, weights=new)[group] > 1)
            out.append((key[mixed], doc[mixed], at[mixed], np.ones(int(mixed.sum()), bool)))
        columns = [np.concatenate([o[i] for o in out]) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc_id", "at", "mixed"])

    tasks = max(8, int(volume * 2 / (length - size) / ROWS_PER_TASK))
    cut_rows = spread_rows(rows_in).mapInArrow(cut, "key long, content long, doc_id long, at long, sure boolean")
    met = cut_rows.repartition(tasks, "key").mapInArrow(meet, "key long, doc_id long, at long, mixed boolean")
    met = ws.stage(met, "segments")
    _settle(spark)
    plain = met.where("not mixed").select("doc_id", "at")

    mixed = met.where("mixed")
    total = mixed.agg(F.coalesce(F.sum(F.shiftright("at", _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))), F.lit(0))).first()[0]
    bins = max(1, -(-total // bin_bytes))
    # All segments of an anchor are treated alike, so equal windows still meet.
    dense = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense_rows)
    dense = ws.stage(dense.select("key", F.lit(True).alias("cut")), "dense")
    mixed = mixed.withColumn("cut", F.lit(False)) if dense.isEmpty() else mixed.join(dense, "key", "left")
    entry = F.struct("key", "at", F.coalesce("cut", F.lit(False)).alias("cut"))
    wanted = mixed.groupBy("doc_id").agg(F.collect_list(entry).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wanted = batch["wanted"]
            of = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            inner = wanted.flatten()
            key, at, cut = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("key", "at", "cut"))
            start, long, anchor = unpack(at)
            texts = [t.as_py().encode() for t in batch["text"]]
            if cut.any():
                n = np.where(cut, long - length + 1, 1)
                each = np.repeat(np.arange(len(at)), n)
                step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                of, cut, start, anchor = of[each], cut[each], start[each] + step, anchor[each] - step
                long = np.where(cut, length, long[each])
                at, key = pack(start, long, anchor), key[each]
                digest = xxhash.xxh3_64_intdigest
                single = np.flatnonzero(cut)
                windows = [digest(texts[i][s : s + length], 1) for i, s in zip(of[single].tolist(), start[single].tolist())]
                key[single] = np.array(windows, np.uint64).view(np.int64)
            data = [texts[i][s : s + n] for i, s, n in zip(of.tolist(), start.tolist(), long.tolist())]
            doc = batch["doc_id"].to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, doc, at)] + [pa.array(data, pa.binary())], ["key", "doc_id", "at", "data"])

    # Repeated rows of a key are equal and give their segments once.
    texts = rows_in.join(wanted, "doc_id").select("doc_id", "text", "wanted")
    pieces = texts.mapInArrow(fetch, "key long, doc_id long, at long, data binary")
    pieces = pieces.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, start = bin_repeats(pdf["key"].to_numpy(), pdf["doc_id"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64), pdf["data"].tolist(), length, size)
        doc, start, n = runs_of(doc, start, length)
        return pd.DataFrame({"doc_id": doc, "start": start, "n": n})

    found = pieces.groupBy("bin").applyInPandas(compare, "doc_id long, start long, n long")
    found = ws.stage(found, "found")
    _settle(spark)
    whole = plain.select(
        "doc_id",
        F.shiftright("at", 2 * _BITS).alias("start"),
        F.shiftright("at", _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)).alias("n"),
    )
    return whole.union(found)


def remove_repeats(
    ws: Workspace, docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, size: int = GRAM, hot_rows: int = HOT_ROWS, dense_rows: int = DENSE_ROWS
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans`` for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row with a
    smaller key, or before it in the same text. Strings are judged on the texts as given. A null text
    counts as empty. Repeated rows count as one text and get the same result. Rows with a null key have
    no place in the order: they lose nothing and remove nothing. ``spans`` are the removed ranges.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = repeats(ws, rows, length, size, hot_rows, dense_rows)
    marks = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))]
        )
        for batch in batches:
            out = []
            for doc, t, marks in zip(batch["doc_id"].to_pylist(), batch["text"], batch["marks"]):
                data = t.as_py().encode() if t.is_valid else b""
                spans = spans_of(marks.values.field("start").to_numpy(), marks.values.field("n").to_numpy()) if marks.is_valid else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest, spans))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return spread_rows(rows).join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(
        cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<bigint>>"
    )


def spans_of(start: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Maximal ranges that the runs cover; touching runs are one range."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + n)[order])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    last = np.append(first[1:], len(start)) - 1
    return np.stack((start[first], end[last]), 1).tolist()
