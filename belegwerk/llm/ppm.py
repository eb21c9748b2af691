"""Prediction by partial matching over bytes, as a language model that scores documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belegwerk.llm.common import crc_mod, texts_of
from belegwerk.workspace import Workspace

ORDER = 5
ALPHABET = 257
END = 256
CHUNK = 1 << 19
BLOCK_BYTES = 14 << 20
# Grams that a task holds twice before it adds up their counts.
HELD_GRAMS = 1 << 20
# Grams in one row on their way out of a task.
SLICE = 1 << 13
# Words and grams of the blocks are the large staged tables.
CODEC = "zstd"


def stream(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all scored grams, with the first key and the number of keys of each text.

    A gram is a symbol with the ``order`` symbols before it. A text is its bytes and an end symbol,
    and starts after end symbols.
    """
    pad = [END] * order
    parts = [np.array(pad, np.uint16)]
    for text in texts:
        parts += [np.frombuffer(text, np.uint8).astype(np.uint16), np.array(pad, np.uint16)]
    symbols = np.concatenate(parts).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(np.concatenate(([0], sizes[:-1] + order - 1))) + order
    n = len(symbols) - order
    keys = np.zeros(n, np.uint64)
    for j in range(order + 1):
        keys = keys * np.uint64(ALPHABET) + symbols[j : j + n]
    first = np.cumsum(np.concatenate(([0], sizes[:-1])))
    at = np.arange(sizes.sum()) + np.repeat(starts - order - first, sizes)
    return keys[at], first, sizes


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and how often they stand there, or the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(keys) else counts
    return keys[first], sums


def gram_values(ws: Workspace, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, value``: log10 probability of each gram's last symbol after the symbols before it.

    ``grams`` has ``key, n``, in any number of rows a gram: how often training texts hold it, zero for
    a gram that is only asked for. The trie is one table per depth, a node being the symbols before
    the last one. Escapes follow method C with symbol exclusion.

    A depth's rows are the suffixes of the next one's, so what is asked for is there at every depth. A
    node has at most 257 rows, and a row of a shorter suffix meets at most 257 of the longer one:
    no key is hot, however the texts are made.
    """
    table, tables = grams.groupBy("key").agg(F.sum("n").alias("n")), []
    for k in range(order, -1, -1):
        if k < order:
            table = table.groupBy((F.col("key") % F.lit(ALPHABET ** (k + 1))).alias("key")).agg(F.sum("n").alias("n"))
        table = ws.stage(table, f"grams{k}")
        tables.append(table)
    over = Window.partitionBy("node")
    known = F.col("n") > 0
    lower = None
    for k, table in enumerate(reversed(tables)):
        rows = table.withColumn("node", F.expr(f"key div {ALPHABET}"))
        sums = {"total": F.sum("n").over(over), "kinds": F.count(F.when(known, 1)).over(over)}
        if lower is None:
            rows = rows.withColumns(sums)
            after = -F.log10(F.greatest(F.lit(ALPHABET) - F.col("kinds"), F.lit(1)))
            unseen = F.lit(-math.log10(ALPHABET))
        else:
            shorter = lower.select(*[F.col(c).alias(f"{c}_") for c in ("key", "n", "total", "kinds", "after", "value")])
            rows = rows.join(shorter, F.col("key") % F.lit(ALPHABET**k) == F.col("key_"))
            rows = rows.withColumns(sums | {"gone": F.coalesce(F.sum(F.when(known, F.col("n_"))).over(over), F.lit(0))})
            # What the shorter context has left without the symbols that this one has seen.
            fresh = F.col("kinds_") - F.col("kinds")
            bottom = F.log10(F.col("total_") - F.col("gone") + fresh)
            after = (
                F.when(F.col("n_") > 0, F.log10("n_") - bottom)
                .when(fresh > 0, F.log10(fresh) - bottom + F.col("after_"))
                .otherwise(F.col("after_"))
            )
            unseen = F.col("value_")
        rows = rows.withColumn("after", after)
        bottom = F.log10(F.col("total") + F.col("kinds"))
        value = (
            F.when(F.col("total") == 0, unseen)
            .when(known, F.log10("n") - bottom)
            .otherwise(F.log10("kinds") - bottom + F.col("after"))
        )
        names = ["key", "value"] if k == order else ["key", "n", "total", "kinds", "after", "value"]
        lower = ws.stage(rows.withColumn("value", value).select(*names), f"values{k}")
    return lower


def text_scores(table: np.ndarray, values: np.ndarray, texts: list[bytes], order: int) -> list[float]:
    """log10 probability of each text, from sorted keys of all its grams and their values.

    Each different gram is looked up once: grams are sorted with the number of their text in the low
    bits, so neither the order nor the texts need a second array.
    """
    bits = 64 - int(np.ceil((order + 1) * np.log2(ALPHABET)))
    out: list[float] = []
    for low in range(0, len(texts), 1 << bits):
        part = texts[low : low + (1 << bits)]
        keys, _, sizes = stream(part, order)
        both = np.sort((keys << np.uint64(bits)) | np.repeat(np.arange(len(part), dtype=np.uint64), sizes))
        keys = both >> np.uint64(bits)
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        value = values[np.searchsorted(table, keys[head])][np.cumsum(head) - 1]
        out += np.bincount((both & np.uint64((1 << bits) - 1)).astype(np.int64), weights=value, minlength=len(part)).tolist()
    return out


def lowered(text: str | None) -> bytes:
    return text.encode().lower() if text else b""


def chunked(texts: Iterator[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    run, total = [], 0
    for text in texts:
        run.append(text)
        total += len(text)
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


def gram_counts(texts: Iterator[bytes], held_out: Iterator[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different grams of all texts and how often ``texts`` hold them; those of ``held_out`` count zero."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = limit = 0
    for group, one in ((texts, 1), (held_out, 0)):
        for run in chunked(group):
            keys, n = tally(stream(run, order)[0])
            parts.append((keys, n * one))
            size += len(keys)
            if size > limit + HELD_GRAMS:
                parts = [tally(*map(np.concatenate, zip(*parts)))]
                size = limit = len(parts[0][0])
    return tally(*map(np.concatenate, zip(*parts)))


def score(
    ws: Workspace,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folds: int = 5,
    held: int = 1,
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` for every row.

    Model and base learn from the rows outside the held-out fold; a null key is never held out. A-Z
    are lower-cased, a null text is empty and has one token, its end. ``score`` is the log10
    probability that the byte model gives the whole text and its end, ``base_score`` that of smoothed
    word counts. Repeated rows count and are scored one by one. An empty training set leaves uniform
    bytes and one unknown token.

    Neither model has a cap: both grow with the corpus and stay tables. Rows are dealt into blocks of
    bounded size; a block sends each different gram and word once, so what a third of all rows
    hold moves once a block, and gets back the values of its grams and the counts of the words that
    other blocks hold too.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    is_held = crc_mod("doc_id", folds) == held
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    dealt = source.select("doc_id", "text", is_held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def count_block(rows: pa.Table) -> pa.Table:
        known, every = Counter(), set()
        flags = rows["held_out"].to_pylist()

        def fold(out: bool) -> Iterator[bytes]:
            return (lowered(rows["text"][i].as_py()) for i, flag in enumerate(flags) if flag == out)

        keys, counts = gram_counts(fold(False), fold(True), order)
        for data in fold(False):
            known.update(data.split())
            known[b""] += 1
        for data in fold(True):
            every.update(data.split())
            every.add(b"")
        every.difference_update(known)
        names = [*known, *every]
        ends = np.append(np.arange(0, len(keys), SLICE), len(keys)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(a.astype(np.int64))) for a in (keys, counts)]
        n_rows = len(names) + len(lists[0])
        pa.default_memory_pool().release_unused()
        return pa.table(
            {
                "block": pa.array(np.full(n_rows, rows["block"][0].as_py(), np.int64)),
                "word": pa.array(names + [None] * len(lists[0]), pa.binary()),
                "n": pa.array([*known.values(), *([0] * (n_rows - len(known)))], pa.int64()),
                **{c: pa.concat_arrays([pa.nulls(len(names), a.type), a]) for c, a in zip(("keys", "counts"), lists)},
            }
        )

    sent = dealt.groupBy("block").applyInArrow(count_block, "block long, word binary, n long, keys array<long>, counts array<long>")
    sent = ws.stage(sent, "blocks", CODEC)
    grams = sent.where("keys is not null").select("block", F.inline(F.arrays_zip("keys", "counts"))).toDF("block", "key", "n")
    values = gram_values(ws, grams.select("key", "n"), order)
    over = Window.partitionBy("word")
    rows = sent.where("word is not null").select("block", "word", "n")
    rows = rows.withColumn("total", F.sum("n").over(over)).withColumn("lead", F.col("block") == F.min("block").over(over))
    counted = ws.stage(rows, "words", CODEC)
    row = counted.agg(F.sum("n"), F.count(F.when(F.col("lead") & (F.col("total") > 0), 1))).first()
    n_train, n_words = row[0] or 0, row[1]
    bottom = n_train + 0.5 * (n_words + 1)
    none = F.lit(None).cast("binary")
    others = counted.where("total <> n").select("block", "word", F.lit(-1).cast("long").alias("key"), F.col("total").cast("double").alias("value"))
    replies = others.unionByName(grams.join(values, "key").select("block", none.alias("word"), "key", "value"))

    def gram_scores(more: pa.Table, lists: list[bytes]) -> list[float]:
        keys = more["key"].to_numpy()
        at = np.flatnonzero(keys >= 0)
        at = at[np.argsort(keys[at])]
        keys, values = keys[at].view(np.uint64), more["value"].to_numpy()[at]
        return [x for run in chunked(iter(lists)) for x in text_scores(keys, values, run, order)]

    def score_block(rows: pa.Table, more: pa.Table) -> pa.Table:
        lists = [lowered(t) for t in texts_of(rows["text"])]
        scores = gram_scores(more, lists)
        found = Counter()
        for data, out in zip(lists, rows["held_out"].to_pylist()):
            if not out:
                found.update(data.split())
                found[b""] += 1
        # Counts give way to their logarithms in place: a block has very many words.
        for word, c in found.items():
            found[word] = math.log10((c + 0.5) / bottom)
        for batch in more.to_batches():
            batch = batch.filter(pc.less(batch["key"], 0))
            for word, total in zip(batch["word"].to_pylist(), batch["value"].to_pylist()):
                found[word] = math.log10((total + 0.5) / bottom)
        unknown = math.log10(0.5 / bottom)
        base, n_tokens, n_known = [], [], []
        for data in lists:
            tokens = [*data.split(), b""]
            logs = [found.get(w, unknown) for w in tokens]
            base.append(math.fsum(logs))
            n_tokens.append(len(tokens))
            # A known word has a count above zero, so no known word has the value of an unknown one.
            n_known.append(len(tokens) - logs.count(unknown))
        pa.default_memory_pool().release_unused()
        longs = {"n_tokens": n_tokens, "n_known": n_known, "train_tokens": [n_train] * len(lists)}
        reals = {"base_score": base, "score": scores}
        return pa.table(
            {"doc_id": rows["doc_id"], "held_out": rows["held_out"]}
            | {c: pa.array(v, pa.int64()) for c, v in longs.items()}
            | {c: pa.array(v, pa.float64()) for c, v in reals.items()}
            | {"n_bytes": pa.array([len(d) for d in lists], pa.int64())}
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score_block, schema)
