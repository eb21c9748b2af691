"""Fuzzy matching as plain SQL: common subsequences bit by bit over a table of characters."""

from __future__ import annotations

from belegwerk import settings


def mask(ch: str, pattern: str) -> str:
    """SQL for the bits of the pattern's places that hold a character."""
    places = {c: sum(1 << i for i, p in enumerate(pattern) if p == c) for c in dict.fromkeys(pattern)}
    cases = " ".join(f"WHEN '{c}' THEN {bits}" for c, bits in places.items())
    return f"CASE {ch} {cases} ELSE 0 END"


def runs(source: str, pattern: str, width: int, lengths: tuple[int, ...]) -> str:
    """Rows ``id, pos, n, c1..``: common length of the pattern and each window of ``source(id, norm)``.

    ``c<k>`` belongs to the window of ``k`` characters from ``pos``, cut off at the end of the text.
    """
    full = (1 << len(pattern)) - 1
    chars = f"""SELECT id, length(norm) AS n, unnest(range(1, length(norm) + 1)) AS pos,
      unnest(string_split(norm, '')) AS ch FROM {source} WHERE length(norm) > 0"""
    bits = f"SELECT id, n, pos, ({mask('ch', pattern)})::BIGINT AS m FROM ({chars})"
    ahead = ", ".join(f"coalesce(lead(m, {j}) OVER w, 0) AS m{j}" for j in range(width))
    sql = f"SELECT id, n, pos, {ahead} FROM ({bits}) WINDOW w AS (PARTITION BY id ORDER BY pos)"
    sql = f"SELECT *, {full}::BIGINT AS s FROM ({sql})"
    for j in range(width):
        sql = f"SELECT *, s & m{j} AS u FROM ({sql})"
        sql = f"SELECT * EXCLUDE (u, m{j}) REPLACE ((((s + u) | (s - u)) & {full}) AS s) FROM ({sql})"
        if j + 1 in lengths:
            sql = f"SELECT *, {len(pattern)} - bit_count(s) AS c{j + 1} FROM ({sql})"
    return sql


def _score(common: str, total: str) -> str:
    return f"(1.0::DOUBLE - ({total} - 2 * ({common})) / ({total})::DOUBLE) * 100"


def part_scores(source: str, pattern: str) -> str:
    """``id, score`` of the best part of each text with at least one character."""
    m = len(pattern)
    full = (1 << m) - 1
    every = tuple(range(1, m + 1))
    heads = ", ".join(f"CASE WHEN pos = 1 AND n >= {k} THEN {_score(f'c{k}', str(m + k))} ELSE 0 END" for k in every[:-1])
    best = f"greatest({heads}, {_score(f'c{m}', f'{m} + least({m}, n - pos + 1)')})"
    long = f"SELECT id, max({best}) AS score FROM ({runs(source, pattern, m, every)}) WHERE n >= {m} GROUP BY id"
    # Texts up to the pattern's length are looked for in the pattern: windows are bit ranges there.
    bits = f"list_transform(string_split(norm, ''), lambda c: ({mask('c', pattern)})::BIGINT)"
    spans = f"list_concat([[i, n] FOR i IN range({m} - n + 1)], list_concat([[0, k] FOR k IN range(1, n)], [[{m} - k, k] FOR k IN range(1, n)]))"
    state = "((1::BIGINT << r[2]::INT) - 1)"
    one = (
        f"list_reduce(list_transform(bits, lambda b: (b >> r[1]::INT) & {state}), "
        f"lambda s, b: ((s + (s & b)) | (s - (s & b))) & {state}, {state})"
    )
    short = f"""SELECT id, list_max(list_transform(spans, lambda r: {_score(f'r[2] - bit_count({one})', 'n + r[2]')})) AS score
      FROM (SELECT *, {spans} AS spans, {bits} AS bits FROM (SELECT id, norm, length(norm) AS n FROM {source} WHERE length(norm) BETWEEN 1 AND {m}))"""
    assert full < 1 << 62
    return f"SELECT id, max(score) AS score FROM ({long} UNION ALL {short}) GROUP BY id"


def spans(source: str, pattern: str, cutoff: int) -> str:
    """``id, span_start, span_end`` of the first window that is like the pattern."""
    m = len(pattern)
    widths = tuple(range(max(1, m - 2), m + 4))
    hits = " ".join(
        f"WHEN n - pos + 1 >= {w} AND {_score(f'c{w}', str(m + w))} >= {cutoff} THEN {w}" for w in widths
    )
    return f"""SELECT id, arg_min(pos - 1, (w, pos)) AS span_start, arg_min(pos - 1 + w, (w, pos)) AS span_end
      FROM (SELECT id, pos, CASE {hits} END AS w FROM ({runs(source, pattern, m + 3, widths)})) WHERE w IS NOT NULL GROUP BY id"""


def months(texts: str, norm, newest: int, cutoff: int = 85) -> list[tuple[str, str]]:
    """Steps up to ``near_months(id, month, year)`` for ``texts(id, text)``."""
    tokens = "regexp_extract_all(text, '[0-9]{4}|[^0-9]|[0-9]')"
    years = f"""SELECT id, text, spot, k::INTEGER AS year FROM (
        SELECT id, text, unnest(t) AS k, unnest(list_transform(range(len(t)), lambda i: coalesce(list_sum(list_transform(t[1:i], lambda x: length(x))), 0)::BIGINT)) AS spot
        FROM (SELECT id, text, {tokens} AS t FROM {texts}))
      WHERE length(k) = 4 AND k::INTEGER BETWEEN {settings.OLDEST_YEAR} AND {newest}"""
    near = f"""SELECT {{'doc': id, 'spot': spot}} AS id, year, {norm("substring(text, (greatest(spot - 30, 0) + 1)::BIGINT, (spot + 14 - greatest(spot - 30, 0))::BIGINT)")} AS norm FROM years"""
    found = " UNION ALL ".join(
        f"SELECT id, {k} AS k, '{code}' AS month FROM ({spans('near_years', name, cutoff)})"
        for k, (name, code) in enumerate(settings.MONTHS)
    )
    first = """SELECT id.doc AS id, arg_min(month, (id.spot, k)) AS month, arg_min(year, (id.spot, k)) AS year
      FROM month_hits JOIN near_years USING (id) GROUP BY id.doc"""
    return [("years", years), ("near_years", near), ("month_hits", found), ("near_months", first)]
