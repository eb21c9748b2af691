"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from belegwerk.llm.common import crc_mod, fresh, partitions, spread_rows, texts_of

BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
SEED = 42
# The network is fitted on at most this many labelled documents, the first by a seeded hash.
MAX_LABELLED = 20_000
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.7
FAN_IN = 32
# Texts are handled in pieces of about this many bytes.
CHUNK = 1 << 19

_SPACE, _WORD, _MARK = 0, 1, 2


def _classes() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    kinds[list(b" \t\n\x0b\x0c\r")] = _SPACE
    kinds[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD
    return kinds


_KIND = _classes()
_LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint64)
_PLACE = np.random.default_rng(SEED).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
_CAPITALS, _DIGITS, _EDGE = 1, 2, 0


def token_buckets(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens of ``texts`` and the index of the text each belongs to.

    Tokens are runs of letters and digits, and runs of other marks. A-Z are lower-cased; words of two
    or more capitals share one token, and so do numbers. Other tokens go to a bucket by hash.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if len(joined) <= len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[joined]
    starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    kinds = kind[starts]
    lengths = np.diff(np.append(starts, len(joined)))
    place = np.arange(len(joined)) - np.repeat(starts, lengths)
    hashed = np.add.reduceat((_LOWER[joined] + np.uint64(1)) * _PLACE[np.minimum(place, 63)], starts)
    hashed ^= hashed >> np.uint64(31)
    bucket = (hashed % np.uint64(buckets - 3) + np.uint64(3)).astype(np.int64)
    upper = np.add.reduceat((joined >= 65) & (joined < 91), starts, dtype=np.int64)
    digit = np.add.reduceat((joined >= 48) & (joined < 58), starts, dtype=np.int64)
    bucket[(upper >= 2) & (2 * upper > lengths)] = _CAPITALS
    bucket[digit == lengths] = _DIGITS
    ends = np.cumsum([len(t) + 1 for t in texts])
    keep = kinds != _SPACE
    return bucket[keep], np.searchsorted(ends, starts[keep], side="right")


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, nonzero: int = NONZERO) -> np.ndarray:
    """The fixed random index vectors: a few places of plus or minus one in each."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((buckets, dims), np.float32)
    places = rng.permuted(np.tile(np.arange(dims), (buckets, 1)), axis=1)[:, :nonzero]
    out[np.arange(buckets)[:, None], places] = rng.choice(np.array([-1, 1], np.float32), (buckets, nonzero))
    return out


def chunked(texts: Iterable[str | None], size: int = CHUNK) -> Iterator[list[bytes]]:
    """Texts as bytes in runs of about ``size`` bytes; null is empty."""
    run, total = [], 0
    for text in texts:
        data = text.encode() if text else b""
        run.append(data)
        total += len(data)
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


def _neighbour_sums(bucket: np.ndarray, of: np.ndarray, base: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums[bucket]`` the index vectors of the tokens up to ``REACH`` places away in the same text."""
    flat = sums.reshape(-1)
    dims = base.shape[1]
    where = np.argsort(base == 0, axis=1, kind="stable")[:, :NONZERO]
    sign = np.take_along_axis(base, where, 1)
    for step in range(1, REACH + 1):
        if len(bucket) <= step:
            break
        same = of[step:] == of[:-step]
        left, right = bucket[:-step][same], bucket[step:][same]
        for target, context in ((left, right), (right, left)):
            for k in range(NONZERO):
                flat += np.bincount(target * dims + where[context, k], weights=sign[context, k], minlength=len(flat))


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """Word vectors of all texts of ``docs``: each bucket's own index vector plus its summed contexts, scaled.

    Every task adds up its texts and passes on its sums in slices of buckets; slices are added in
    a tree of at most ``FAN_IN`` parts a step. The table has a fixed size, whatever the corpus.
    """
    source = spread_rows(docs.select(F.col(text).alias("text")))
    base = index_vectors()
    parts = 16
    per = BUCKETS // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIMS), np.float64)
        for batch in batches:
            for run in chunked(texts_of(batch["text"])):
                _neighbour_sums(*token_buckets(run), base, sums)
        task = TaskContext.get().partitionId()
        blobs = [sums[p * per : (p + 1) * per].astype("<i4").tobytes() for p in range(parts)]
        columns = [pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "task", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(b, "<f8" if len(b) == per * DIMS * 8 else "<i4").astype(np.float64) for b in pdf["sums"]), np.zeros(per * DIMS))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "task": pdf["task"].iloc[0] // FAN_IN, "sums": [total.tobytes()]})

    schema = "part int, task int, sums binary"
    table, n = source.mapInArrow(count, schema), partitions(source)
    while True:
        n = -(-n // FAN_IN)
        table = table.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("slice")).applyInPandas(add, schema)
        if n <= 1:
            break
    rows = sorted(table.collect(), key=lambda r: r.part)
    sums = np.concatenate([np.frombuffer(r.sums, "<f8").reshape(per, DIMS) for r in rows]) if rows else np.zeros((BUCKETS, DIMS))
    lengths = np.linalg.norm(sums, axis=1, keepdims=True)
    return (base / np.sqrt(NONZERO) + sums / np.maximum(lengths, 1e-9)).astype(np.float32)


def with_squares(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, vectors * vectors], axis=1)


def pool(texts: list[bytes], squared: np.ndarray) -> np.ndarray:
    """Per text the mean and the spread of its word vectors, and the log of its token count.

    ``squared`` has the vectors and their squares side by side, see ``with_squares``.
    """
    bucket, of = token_buckets(texts)
    n = np.bincount(of, minlength=len(texts)).astype(np.float64)
    dims = squared.shape[1] // 2
    out = np.zeros((len(texts), 2 * dims + 1), np.float32)
    out[:, -1] = np.log1p(n)
    if len(bucket):
        some = np.flatnonzero(n)
        at = np.concatenate(([0], np.cumsum(n[some].astype(np.int64))[:-1]))
        sums = np.add.reduceat(squared[bucket], at, axis=0) / n[some, None]
        out[some, :dims] = sums[:, :dims]
        out[some, dims:-1] = np.sqrt(np.maximum(sums[:, dims:] - sums[:, :dims] ** 2, 0))
    return out


@dataclass
class Network:
    """A two-layer network over standardised features, with a temperature for its logits."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit on four fifths of the rows by Adam; the last fifth picks the epoch and the temperature.

    Without rows every score is 0.5; with one class only, scores come from the smoothed share.
    """
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 1) / (len(y) + 2)
    net = Network(
        x.mean(0) if len(x) else np.zeros(d),
        x.std(0) + 1e-3 if len(x) else np.ones(d),
        rng.normal(0, 1 / np.sqrt(d), (d, hidden)),
        np.zeros(hidden),
        np.zeros(hidden),
        float(np.log(prior / (1 - prior))),
        1.0,
    )
    if len(np.unique(y)) < 2 or len(y) < 20:
        return net
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    hold, train = order[:cut], order[cut:]
    net.w2 = rng.normal(0, 0.1, hidden)
    names = ("w1", "b1", "w2", "b2")
    m, v = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    z = (x - net.mean) / net.scale
    best, step = (np.inf, None), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            step += 1
            a = np.tanh(z[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(a @ net.w2 + net.b2, -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, net.w2) * (1 - a * a)
            slopes = {"w1": z[rows].T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": a.T @ error + 1e-4 * net.w2, "b2": error.sum()}
            for k, g in slopes.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        loss = _loss(net.logits(x[hold]), y[hold])
        if loss < best[0]:
            best = (loss, [np.copy(getattr(net, k)) for k in names])
    for k, value in zip(names, best[1]):
        setattr(net, k, value if k != "b2" else float(value))
    held = net.logits(x[hold])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: (_loss(held / t, y[hold]), abs(np.log(t)))))
    return net


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 4,
    held: int = 2,
    max_labelled: int = MAX_LABELLED,
) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts, ready for ``pool``, and the network.

    The network learns from labelled rows outside the held-out fold only, at most ``max_labelled`` of them,
    the first by a seeded hash of the key. So few rows are sent to the texts, which stay where they are. Where a
    labelled key stands in several rows of ``docs`` each teaches, of all these again at most
    ``max_labelled``, the first by a hash of key, label and text.
    """
    squared = with_squares(word_vectors(docs, text))
    given = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    given = given.where(crc_mod("doc_id", folds) != held).withColumn("_draw", F.xxhash64(F.lit(SEED), "doc_id"))
    given = given.orderBy("_draw", "doc_id", "y").limit(max_labelled).drop("_draw")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sample = source.join(F.broadcast(given), "doc_id").select("doc_id", "y", F.xxhash64(F.lit(SEED), "doc_id", "y", "text").alias("draw"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(squared)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], batch["draw"], _lists(_pooled(batch["text"], sent.value))], ["doc_id", "y", "draw", "x"])

    # A labelled key may stand in any number of rows; the bound holds for these as well.
    found = sample.mapInArrow(features, "doc_id long, y int, draw long, x array<float>").orderBy("draw", "doc_id", "y").limit(max_labelled)
    rows = found.toPandas().sort_values(["doc_id", "y", "draw"])
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), squared.shape[1] + 1)
    return squared, fit_network(x, (rows["y"].to_numpy() > 0).astype(np.float64))


def _pooled(texts: pa.Array, squared: np.ndarray) -> np.ndarray:
    rows = [pool(run, squared) for run in chunked(texts_of(texts))]
    return np.concatenate([np.zeros((0, squared.shape[1] + 1), np.float32), *rows])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def with_scores(docs: DataFrame, squared: np.ndarray, net: Network, text: str, out: str) -> DataFrame:
    """``docs`` with a column ``out``: the network's probability for each whole text. Rows stay where they are."""
    sent = docs.sparkSession.sparkContext.broadcast((squared, net))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squared, net = sent.value
            score = net.probability(_pooled(batch[text], squared).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, out])

    return docs.mapInArrow(apply, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def score(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 4,
    held: int = 2,
    max_labelled: int = MAX_LABELLED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Word vectors come from all texts, labels from outside the held-out fold, and the network sees nothing
    but the text's pooled vector. Whole texts count; null and empty ones have a zero vector and get a
    score as well. A null key is never held out. Rows with a null label teach nothing; repeated labels
    of a key count once each.
    """
    squared, net = fit(docs, labels, key, text, label, folds, held, max_labelled)
    source = spread_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    scored = with_scores(source, squared, net, "text", "score").drop("text")
    held_out = (crc_mod("doc_id", folds) == held).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, as they are; each row is judged on its own."""
    squared, net = fit(docs, labels, key, text)
    (name,) = fresh(docs, "_score")
    return with_scores(spread_rows(docs), squared, net, text, name).where(F.col(name) >= threshold).drop(name)
