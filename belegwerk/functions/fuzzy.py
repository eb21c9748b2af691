"""Fuzzy matching by longest common subsequence, as Arrow functions.

Similarity of two strings is ``100 * (1 - d / (len1 + len2))``, where ``d`` counts insertions and
deletions. Common subsequence lengths come from the published bit-parallel recurrence: one bit per
pattern character, one step per text character. A step is done for all windows of all texts of a
chunk at once. Texts are never shortened.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from belegwerk import settings
from belegwerk.functions.text import _col, normalize_text

LIMB = 62
LIMB_MASK = np.uint64((1 << LIMB) - 1)
# Small enough for the arrays of one step to stay in the processor's cache.
CHUNK_CHARS = 1 << 16


def similarity(common, total):
    """Similarity in percent for a common subsequence length and the summed lengths."""
    total = np.asarray(total, dtype=np.float64)
    distance = total - 2.0 * np.asarray(common)
    return np.where(total > 0, (1.0 - distance / np.where(total > 0, total, 1.0)) * 100.0, 100.0)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Rows:
    """Bit rows of one pattern run over many strings in step."""

    def __init__(self, pattern: str, codes: np.ndarray) -> None:
        self.size = len(pattern)
        limbs = max(1, -(-self.size // LIMB))
        self.masks = np.zeros((limbs, len(codes)), dtype=np.uint64)
        for i, code in enumerate(_codes(pattern)):
            self.masks[i // LIMB][codes == code] |= np.uint64(1 << (i % LIMB))

    def start(self, n: int) -> np.ndarray:
        return np.full((len(self.masks), n), LIMB_MASK, dtype=np.uint64)

    def step(self, rows: np.ndarray, at) -> None:
        carry = np.uint64(0)
        for limb, masks in zip(rows, self.masks):
            hit = limb & masks[at]
            total = limb + hit + carry
            carry = total >> np.uint64(LIMB)
            limb[:] = (total & LIMB_MASK) | (limb - hit)

    def common(self, rows: np.ndarray) -> np.ndarray:
        """Common subsequence lengths so far: the cleared bits."""
        return np.bitwise_count(~rows & LIMB_MASK).sum(axis=0).astype(np.int64)


def _layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    return _codes("".join(texts)), starts, lens


def _whole_common(texts: list[str], pattern: str) -> np.ndarray:
    codes, starts, lens = _layout(texts)
    order = np.argsort(-lens, kind="stable")
    rows = _Rows(pattern, codes)
    state = rows.start(len(texts))
    live = len(texts)
    for j in range(int(lens.max(initial=0))):
        while live and lens[order[live - 1]] <= j:
            live -= 1
        rows.step(state[:, :live], starts[order[:live]] + j)
    out = np.empty(len(texts), dtype=np.int64)
    out[order] = rows.common(state)
    return out


def whole_ratio(texts: list[str], pattern: str) -> np.ndarray:
    """Similarity of each text to the pattern, both taken whole."""
    if not texts:
        return np.zeros(0)
    lens = np.array([len(t) for t in texts])
    return similarity(_whole_common(texts, pattern), lens + len(pattern))


def _best_window(texts: list[str], needle: str) -> np.ndarray:
    """Best similarity of the needle to windows of its length, cut off at both text ends.

    No text may be shorter than the needle.
    """
    m = len(needle)
    codes, starts, lens = _layout(texts)
    forward = _Rows(needle, codes)
    state = forward.start(len(codes) - m + 1)
    for j in range(m):
        forward.step(state, slice(j, len(codes) - m + 1 + j))
    common = forward.common(state)
    # Windows that run into the next text do not count.
    last = starts + lens - m
    inside = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, last + 1, -1)
    common = np.where(np.cumsum(inside)[: len(common)] > 0, common, 0)
    best = similarity(np.maximum.reduceat(common, starts), 2 * m)
    backward = _Rows(needle[::-1], codes)
    head = forward.start(len(texts))
    tail = backward.start(len(texts))
    for j in range(m - 1):
        forward.step(head, starts + j)
        backward.step(tail, starts + lens - 1 - j)
        ends = np.maximum(forward.common(head), backward.common(tail))
        best = np.maximum(best, similarity(ends, m + j + 1))
    return best


def _best_part(texts: list[str], pattern: str) -> np.ndarray:
    """Best similarity of texts of one length to windows of that length of a pattern, cut off at its ends.

    No text may be longer than the pattern. Each window is compared with all texts in step.
    """
    n, m = len(texts[0]), len(pattern)
    windows = {pattern[i : i + n] for i in range(m - n + 1)}
    windows |= {part for j in range(1, n) for part in (pattern[:j], pattern[-j:])}
    best = np.zeros(len(texts))
    for window in windows:
        best = np.maximum(best, similarity(_whole_common(texts, window), n + len(window)))
    return best


def part_ratio(texts: list[str], pattern: str) -> np.ndarray:
    """Best similarity of the shorter string to a part of the longer one."""
    m = len(pattern)
    out = np.zeros(len(texts))
    longer = [i for i, t in enumerate(texts) if m and len(t) >= m]
    if longer:
        out[longer] = _best_window([texts[i] for i in longer], pattern)
    by_length: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        if not text or not m:
            out[i] = 100.0 if len(text) == m else 0.0
        elif len(text) <= m:
            by_length.setdefault(len(text), []).append(i)
    for places in by_length.values():
        out[places] = np.maximum(out[places], _best_part([texts[i] for i in places], pattern))
    return out


def first_span(texts: list[str], pattern: str, cutoff: int) -> np.ndarray:
    """First window at least ``cutoff`` similar, as ``(start, end)`` rows; ``(-1, -1)`` if none is.

    Windows are two characters shorter to three longer than the pattern, shorter ones first.
    """
    m = len(pattern)
    spans = np.full((len(texts), 2), -1, dtype=np.int64)
    if not m or not texts:
        return spans
    codes, starts, lens = _layout(texts)
    if not len(codes):
        return spans
    owner = np.repeat(np.arange(len(texts)), lens)
    room = (starts + lens)[owner] - np.arange(len(codes))
    rows = _Rows(pattern, codes)
    state = rows.start(len(codes))
    shortest = max(1, m - 2)
    for width in range(1, m + 4):
        n = len(codes) - width + 1
        if n <= 0:
            break
        state = state[:, :n]
        rows.step(state, slice(width - 1, width - 1 + n))
        if width < shortest:
            continue
        hit = (similarity(rows.common(state), m + width) >= cutoff) & (room[:n] >= width)
        at = np.flatnonzero(hit & (spans[owner[:n], 0] < 0))
        who, first = np.unique(owner[at], return_index=True)
        begin = at[first] - starts[who]
        spans[who, 0] = begin
        spans[who, 1] = begin + width
    return spans


def _norm(text: str) -> str:
    """Python form of ``normalize_text``."""
    return " ".join(re.findall(r"\w+", text.lower()))


def month_near_year(texts: list[str], cutoff: int, newest: int) -> list[tuple[str, int] | None]:
    """First year with a fuzzy month name within 30 characters before to 10 after it."""
    windows: list[str] = []
    marks: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        for hit in re.finditer("[0-9]{4}", text):
            year = int(hit.group())
            if settings.OLDEST_YEAR <= year <= newest:
                near = text[max(0, hit.start() - 30) : hit.end() + 10]
                windows.append(_norm(near))
                marks.append((i, year))
    found = np.full(len(windows), len(settings.MONTHS))
    for k, (name, _) in enumerate(settings.MONTHS):
        hit = first_span(windows, name, cutoff)[:, 0] >= 0
        found[hit & (found > k)] = k
    out: list[tuple[str, int] | None] = [None] * len(texts)
    for (i, year), k in zip(marks, found):
        if out[i] is None and k < len(settings.MONTHS):
            out[i] = (settings.MONTHS[k][1], year)
    return out


def _chunks(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in order, in groups of about ``CHUNK_CHARS`` characters; a text is never cut."""
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > CHUNK_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0)


def _guarded(text: Column, pattern: str, value: Column) -> Column:
    """False for an empty raw text or pattern."""
    if not pattern:
        return F.lit(False)
    return F.coalesce((F.length(text) > 0) & value, F.lit(False))


def _whole_score(norm: Column, target: str) -> Column:
    @F.pandas_udf("double")
    def score(norm: pd.Series) -> pd.Series:
        return pd.Series(_concat([whole_ratio(c, target) for c in _chunks(norm)]))

    return score(norm)


def whole_score(text: Column | str, pattern: str) -> Column:
    """Similarity of the whole normalised text to the pattern, 0 to 100."""
    return _whole_score(normalize_text(text), _norm(pattern))


def part_score(text: Column | str, pattern: str) -> Column:
    """Best similarity of the pattern to a part of the normalised text, 0 to 100."""
    target = _norm(pattern)

    @F.pandas_udf("double")
    def score(norm: pd.Series) -> pd.Series:
        return pd.Series(_concat([part_ratio(c, target) for c in _chunks(norm)]))

    return score(normalize_text(text))


def fuzzy_match(text: Column | str, pattern: str, threshold: float = 0.95) -> Column:
    """Whether the whole text is like the pattern.

    Texts whose length alone rules that out are not looked at: no more characters can be common than
    the shorter string has.
    """
    target, cutoff = _norm(pattern), int(threshold * 100)
    norm = normalize_text(text)
    n, m = F.length(norm), len(target)
    able = F.when(n + m == 0, True).otherwise(200 * F.least(n, F.lit(m)) >= cutoff * (n + m))
    return _guarded(_col(text), pattern, able & (_whole_score(F.when(able, norm), target) >= cutoff))


def fuzzy_contains(text: Column | str, pattern: str, threshold: float = 0.95) -> Column:
    """Whether some part of the text is like the pattern."""
    return _guarded(_col(text), pattern, part_score(text, pattern) >= threshold * 100)


def fuzzy_find(text: Column | str, pattern: str, threshold: float = 0.95) -> Column:
    """``struct<start, end>`` of the first like part of the normalised text, or null."""
    target = _norm(pattern)
    cutoff = int(threshold * 100)

    @F.pandas_udf("start int, end int")
    def find(norm: pd.Series) -> pd.DataFrame:
        parts = [first_span(c, target, cutoff) for c in _chunks(norm)]
        spans = np.concatenate(parts) if parts else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame(spans.astype("int32"), columns=["start", "end"])

    span = find(normalize_text(text))
    return F.when((F.length(_col(text)) > 0) & (span["start"] >= 0), span)


def month_fuzzy(text: Column | str, as_of: datetime.date, threshold: float = 0.85) -> Column:
    """``struct<month, year>`` from a year with a misspelt month name near it, or null."""
    cutoff = int(threshold * 100)
    newest = as_of.year + 1

    @F.pandas_udf("month string, year int")
    def find(raw: pd.Series) -> pd.DataFrame:
        hits = [h or (None, 0) for c in _chunks(raw) for h in month_near_year(c, cutoff, newest)]
        return pd.DataFrame(hits, columns=["month", "year"]).astype({"year": "int32"})

    hit = find(_col(text))
    return F.when(hit["month"].isNotNull(), hit)
