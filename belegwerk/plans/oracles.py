"""The catalogue queries as plain SQL over the same tables, for a check on another engine."""

from __future__ import annotations

import re

from belegwerk import settings
from belegwerk.functions.fuzzy import _norm
from belegwerk.plans import fuzzy_sql
from belegwerk.plans.catalog import LONG_NEEDLE, NEEDLE
from belegwerk.plans.derived import AS_OF, MONTH_TITLES

NEWEST = AS_OF.year + 1
WORD = settings.WORD_PATTERN
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(column: str) -> str:
    return f"array_to_string(regexp_extract_all(lower(coalesce({column}, '')), '{WORD}'), ' ')"


def words(column: str) -> str:
    return f"list_filter(string_split({column}, ' '), lambda w: regexp_full_match(w, '{settings.TERM_PATTERN}'))"


def kept_words(column: str) -> str:
    return (
        f"list_filter(string_split({column}, ' '), lambda w: regexp_full_match(w, '{settings.TERM_PATTERN}')"
        f" AND NOT list_contains({_list(settings.STOP_WORDS)}, w))"
    )


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def clean(column: str) -> str:
    s = rf"""regexp_replace({column}, '[:\\/<>|"?*\n\r]+', '', 'g')"""
    s = strip(f"regexp_replace({s}, '{BLANK}{{2,}}', ' ', 'g')")
    return f"coalesce(nullif(substring({s}, 1, {settings.NAME_CHARS}), ''), '{settings.NO_SUBJECT}')"


def first_line_subject(column: str) -> str:
    lines = f"list_transform(string_split({column}, chr(10)), lambda s: {strip('s')})"
    line = f"list_filter({lines}, lambda s: length(s) > 3)[1]"
    return rf"substring(regexp_replace({line}, '[^\p{{L}}\p{{N}} _-]', '', 'g'), 1, {settings.LINE_CHARS})"


def _date(y: str, m: str, d: str) -> str:
    # Padded to a fixed form, since a lone try_cast does not take every unpadded one.
    text = f"lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    return f"try_cast({text} AS DATE)"


def text_day(column: str) -> str:
    def found(pattern: str, y: int, m: int, d: int) -> str:
        g = [f"regexp_extract({column}, '{pattern}', {i})" for i in (y, m, d)]
        return (
            f"CASE WHEN try_cast({g[0]} AS INTEGER) BETWEEN {settings.OLDEST_YEAR} AND {NEWEST}"
            f" THEN {_date(*g)} END"
        )

    return f"coalesce({found(settings.YEAR_FIRST, 1, 2, 3)}, {found(settings.DAY_FIRST, 3, 2, 1)})"


def reply_day(column: str) -> str:
    pattern = r"^([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})$"
    g = [f"regexp_extract({column}, '{pattern}', {i})" for i in (1, 2, 3)]
    return f"CASE WHEN regexp_matches({column}, '{pattern}') THEN {_date(*g)} END"


def replied(column: str, key: str) -> str:
    complete = f"json_valid({column}) AND json_type({column}) = 'OBJECT' AND json_exists({column}, '$.date') AND json_exists({column}, '$.subject')"
    return f"CASE WHEN CASE WHEN json_valid({column}) THEN {complete} ELSE false END THEN json_extract_string({column}, '$.{key}') END"


def _whole_match(key: str, norm_sql: str, table: str, pattern: str, cutoff: int) -> str:
    """``key, hit``: whether the whole normalised text is like the pattern."""
    m = len(pattern)
    full = (1 << m) - 1
    return f"""SELECT id AS {key}, coalesce(n > 0 AND (1.0::DOUBLE - (n + {m} - 2 * l) / (n + {m})::DOUBLE) * 100 >= {cutoff}, false)::INTEGER AS hit FROM (
      SELECT id, length(norm) AS n, {m} - bit_count(list_reduce(list_transform(string_split(norm, ''),
        lambda c: ({fuzzy_sql.mask('c', pattern)})::BIGINT),
        lambda s, b: ((s + (s & b)) | (s - (s & b))) & {full}, {full}::BIGINT)) AS l
      FROM (SELECT {key} AS id, {norm_sql} AS norm FROM {table}))"""


# Named steps with what they need; a query pulls in the ones it uses.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "norms": ((), f"SELECT doc_id, {norm('text')} AS norm FROM documents"),
    "corpus": (
        ("norms",),
        f"""SELECT doc_id, lang || '/' || source AS label, norm FROM documents JOIN norms USING (doc_id)
        WHERE length(trim(norm)) > {settings.MIN_TEXT}""",
    ),
    "fine": ((), "SELECT doc_id, lang || '/' || source || '/' || (n_chars % 12) AS label FROM documents"),
    "fine_sizes": (("fine",), "SELECT label, count(*) AS n_docs FROM fine GROUP BY label"),
    # Training part: all of the corpus, unless a query puts another one here.
    "fitted": (("corpus",), "SELECT doc_id, label, norm FROM corpus"),
    "scored_docs": (("norms",), "SELECT doc_id, norm FROM norms"),
    "doc_tokens": (("fitted",), f"SELECT doc_id, label, {kept_words('norm')} AS t FROM fitted"),
    "tf": (
        ("doc_tokens",),
        """SELECT doc_id, label, term, count(*) AS tf FROM (
          SELECT doc_id, label, unnest(t) AS term FROM doc_tokens
          UNION ALL
          SELECT doc_id, label, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM doc_tokens)
        GROUP BY ALL""",
    ),
    "size": (("fitted",), "SELECT count(*) AS n FROM fitted"),
    "freqs": (
        ("tf", "size"),
        f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term
        HAVING count(*) >= {settings.MIN_DF} AND count(*) <= {settings.MAX_DF}::DOUBLE * (SELECT n FROM size)""",
    ),
    "vocab": (
        ("freqs", "size"),
        f"""SELECT term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM freqs, size
        ORDER BY cf DESC, term LIMIT {settings.MAX_TERMS}""",
    ),
    "vec": (
        ("tf", "vocab"),
        """SELECT doc_id, label, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS tfidf
        FROM tf JOIN vocab USING (term)""",
    ),
    "mass": (("vec",), "SELECT label, term, sum(tfidf) AS mass FROM vec GROUP BY ALL"),
    "classes": (
        ("fitted", "size", "mass", "vocab"),
        f"""SELECT label, n_docs, ln(n_docs / n) AS log_prior, ln(coalesce(total, 0) + {settings.ALPHA} * v) AS log_total,
          ln({settings.ALPHA}) - ln(coalesce(total, 0) + {settings.ALPHA} * v) AS log_unseen
        FROM (SELECT label, count(*) AS n_docs FROM fitted GROUP BY label)
        LEFT JOIN (SELECT label, sum(mass) AS total FROM mass GROUP BY label) USING (label),
        size, (SELECT count(*) AS v FROM vocab)""",
    ),
    "weights": (
        ("mass", "classes"),
        f"SELECT label, term, ln(mass + {settings.ALPHA}) - log_total AS log_prob, log_unseen FROM mass JOIN classes USING (label)",
    ),
    "new_tokens": (("scored_docs",), f"SELECT doc_id, {kept_words('norm')} AS t FROM scored_docs"),
    "new_tf": (
        ("new_tokens",),
        """SELECT doc_id, term, count(*) AS tf FROM (
          SELECT doc_id, unnest(t) AS term FROM new_tokens
          UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM new_tokens)
        GROUP BY ALL""",
    ),
    "new_vec": (
        ("new_tf", "vocab"),
        """SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS tfidf
        FROM new_tf JOIN vocab USING (term)""",
    ),
    "gains": (
        ("new_vec", "weights"),
        """SELECT doc_id, label, sum(tfidf * (log_prob - log_unseen)) AS gain
        FROM new_vec JOIN weights USING (term) GROUP BY ALL""",
    ),
    "scores": (
        ("scored_docs", "classes", "new_vec", "gains"),
        """SELECT d.doc_id, c.label,
          round(log_prior + coalesce(w, 0) * log_unseen + coalesce(gain, 0), 9) AS score
        FROM scored_docs d CROSS JOIN classes c
        LEFT JOIN (SELECT doc_id, sum(tfidf) AS w FROM new_vec GROUP BY doc_id) s ON s.doc_id = d.doc_id
        LEFT JOIN gains g ON g.doc_id = d.doc_id AND g.label = c.label""",
    ),
    "ranked": (
        ("scores",),
        """SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank,
          exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS p
        FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM scores)""",
    ),
    "best": (("ranked",), "SELECT doc_id, label AS subfolder, p AS confidence FROM ranked WHERE rank = 1"),
    "sizes": (("corpus",), "SELECT label, count(*) AS n_docs FROM corpus GROUP BY label HAVING count(*) >= 2"),
    "quota": (
        ("sizes",),
        f"""SELECT label, n_docs, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= total_test - sum(whole) OVER () THEN 1 ELSE 0 END AS n_test
        FROM (SELECT label, n_docs, total_test, (total_test * n_docs) // total AS whole, (total_test * n_docs) % total AS rest
          FROM (SELECT label, n_docs, total, ceil(total * {settings.TEST_SHARE}::DOUBLE)::BIGINT AS total_test
            FROM (SELECT label, n_docs, (sum(n_docs) OVER ())::BIGINT AS total FROM sizes)))""",
    ),
    "parts": (
        ("corpus", "quota"),
        f"""SELECT doc_id, label, norm, (place <= n_test)::INTEGER AS is_test FROM (
          SELECT doc_id, label, norm, row_number() OVER (PARTITION BY label ORDER BY md5('{settings.SPLIT_SEED}:' || doc_id), doc_id) AS place FROM corpus)
        JOIN quota USING (label)""",
    ),
    "report_counts": (
        (),
        """SELECT label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS n_predicted, sum(h)::BIGINT AS hits FROM (
          SELECT truth AS label, 1 AS t, 0 AS p, (truth = predicted)::INTEGER AS h FROM pairs
          UNION ALL SELECT predicted, 0, 1, 0 FROM pairs) GROUP BY label""",
    ),
    "report_classes": (
        ("report_counts",),
        """SELECT label, support, hits,
          CASE WHEN n_predicted > 0 THEN hits / n_predicted ELSE 0 END AS precision,
          CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
          CASE WHEN support + n_predicted > 0 THEN 2.0 * hits / (support + n_predicted) ELSE 0 END AS f1_score
        FROM report_counts""",
    ),
    "report": (
        ("report_classes",),
        """SELECT label, 'class' AS kind, precision, recall, f1_score, support FROM report_classes
        UNION ALL SELECT '', 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support)::BIGINT FROM report_classes
        UNION ALL SELECT '', 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::BIGINT FROM report_classes
        UNION ALL SELECT '', 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1_score * support) / sum(support), sum(support)::BIGINT FROM report_classes""",
    ),
    "doc_dates": (
        (),
        """SELECT o_orderkey, o_orderdate, 'Rechnung ' || o_orderkey || ' vom ' ||
          CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '31.02.%Y')
               WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y - %m / %d')
               ELSE strftime(o_orderdate, '%d.%m.%Y') END AS text FROM orders""",
    ),
    "doc_months": (
        (),
        f"""SELECT o_orderkey, 'Abrechnung ' ||
          CASE WHEN o_orderkey % 4 = 0 THEN upper(title) ELSE title END ||
          CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ' END || (year(o_orderdate) + 4) || ' Blatt ' || o_orderkey AS text
        FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN m || right(m, 1) ELSE m END AS title
          FROM (SELECT *, {_list(MONTH_TITLES)}[month(o_orderdate)] AS m FROM orders))""",
    ),
    "reply_rows": (
        (),
        """SELECT * REPLACE (CASE WHEN o_orderkey % 19 = 0 THEN reply || ' danke' WHEN o_orderkey % 23 = 0 THEN reply || '{"a":1}'
          WHEN o_orderkey % 29 = 0 THEN replace(reply, '"', '''') ELSE reply END AS reply) FROM (
        SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'keine Antwort ' || o_orderkey
          WHEN o_orderkey % 11 = 0 THEN '[' || o_orderkey || ', 2]'
          WHEN o_orderkey % 5 = 0 THEN '{"date":"' || strftime(o_orderdate, '%Y.%-m.%-d') || '"}'
          ELSE '{"date":"' || CASE WHEN o_orderkey % 17 = 0 THEN '2001.2.30'
              WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y.%m.%d')
              ELSE strftime(o_orderdate, '%Y.%-m.%-d') END || '","subject":"' ||
            CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Auftrag ' || o_orderpriority END || '"}' END AS reply
        FROM orders)""",
    ),
    "replies": (
        ("reply_rows",),
        f"SELECT o_orderkey, {replied('reply', 'date')} AS reply_date, {replied('reply', 'subject')} AS reply_subject FROM reply_rows",
    ),
    "inbox": (
        (),
        """SELECT doc_id, lang, source, text, '/inbox/Beleg ' || doc_id || CASE WHEN doc_id % 10 = 0 THEN ' Steuer' ELSE '' END ||
          CASE WHEN doc_id % 15 = 0 THEN ' TAX' ELSE '' END ||
          CASE WHEN doc_id % 13 = 0 THEN '.txt' WHEN doc_id % 9 = 0 THEN '.PDF' ELSE '.pdf' END AS path,
          DATE '2024-01-01' + (doc_id % 300)::INTEGER AS mday,
          CASE WHEN doc_id % 4 = 0 THEN '2023.' || (doc_id % 12 + 1) || '.5' WHEN doc_id % 4 = 1 THEN '' END AS reply_date,
          CASE WHEN doc_id % 4 = 0 THEN 'Vorgang ' || source WHEN doc_id % 4 = 1 THEN '' END AS reply_subject
        FROM documents""",
    ),
    "scored": (
        ("inbox",),
        f"""SELECT doc_id, path, CASE WHEN (doc_id % 40) / 40.0 >= {settings.REVIEW_THRESHOLD} THEN 'Review' ELSE 'Unsure' END AS bucket,
          CASE WHEN doc_id % 8 = 0 THEN '' ELSE lang || '/' || source END AS subfolder, '2024.01.01 ' || lang || '.pdf' AS name
        FROM inbox""",
    ),
    "targets": (
        ("scored",),
        "SELECT *, bucket || '/' || CASE WHEN subfolder = '' THEN '' ELSE subfolder || '/' END || name AS target FROM scored",
    ),
    "filed": (
        ("targets",),
        """SELECT *, CASE WHEN k = 0 THEN target ELSE left(target, length(target) - 4) || ' (' || k || ').pdf' END AS dst
        FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY doc_id) - 1 AS k FROM targets)""",
    ),
    "review": (
        (),
        "SELECT page_id, '/Review/' || replace(split_part(url, '//', 2), '?', '/') || '/' || page_id || '.pdf' AS path FROM pages",
    ),
    "hashed": ((), "SELECT doc_id, text, md5(text) AS content_hash FROM documents"),
    "cached": (("hashed",), f"SELECT DISTINCT content_hash, {norm('text')} AS norm_text FROM hashed WHERE doc_id % 3 = 0"),
    "page_lines": ((), "SELECT page_id, html, 4 * ((strlen(page_id || '|' || html) + 2) // 3) + 1 AS n_bytes FROM pages"),
    "marks": (
        (),
        """SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events)""",
    ),
    "sessions": (
        ("marks",),
        """SELECT user_id AS inbox, min(ts) AS first, max(ts) + INTERVAL 1 HOUR AS settled, count(*) AS n_events
        FROM marks GROUP BY user_id, session""",
    ),
}


STEPS["month_texts"] = (("doc_months",), "SELECT o_orderkey AS id, text FROM doc_months")
STEPS["rule_docs"] = (
    ("doc_months",),
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN 'de/src1' WHEN 2 THEN '{fund}' ELSE '{pay}' END AS subfolder,
      CASE o_orderkey % 6 WHEN 0 THEN 'Meldebescheinigung zur Sozialversicherung ' WHEN 2 THEN 'Quartalsbericht ERTRAGSAUSSCHÜTTUNG '
        WHEN 3 THEN 'Quartalsbericht ' WHEN 4 THEN 'Abrechnungder Brutto/Netto-Bezüge ' ELSE 'Brutto Abrechnung ' END || text AS text
    FROM doc_months""".replace("{fund}", settings.FUND_FOLDER).replace("{pay}", settings.PAYROLL_FOLDER),
)
STEPS["rule_norms"] = (("rule_docs",), f"SELECT id, {norm('text')} AS norm FROM rule_docs")


def _with_months(final: str, texts: str, *needs: str) -> str:
    """``final`` behind the steps that end in ``near_months``."""
    steps = fuzzy_sql.months(texts, norm, NEWEST)
    own = ",\n".join(f"{n} AS MATERIALIZED (\n  {sql}\n)" for n, sql in steps)
    return build("", texts, *needs).rstrip() + ",\n" + own + "\n" + final


def build(final: str, *needs: str, **replaced: str) -> str:
    """``final`` with the steps it needs in front; ``replaced`` puts other text in for a step."""
    order: list[str] = []

    def visit(name: str, path: tuple[str, ...] = ()) -> None:
        if name in order:
            return
        wanted = _needs(replaced[name]) if name in replaced else STEPS[name][0]
        for n in wanted:
            visit(n, (*path, name))
        order.append(name)

    for need in needs:
        visit(need)
    steps = [f"{n} AS MATERIALIZED (\n  {replaced.get(n) or STEPS[n][1]}\n)" for n in order]
    return ("WITH " + ",\n".join(steps) + "\n" if steps else "") + final


def _needs(sql: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(n for n in re.findall(r"\b(?:FROM|JOIN) (\w+)", sql) if n in STEPS))


MOMENT = "'%Y-%m-%d %H:%M:%S.%f'"
DATE = "'%Y-%m-%d'"
SESSION_COLUMNS = f"inbox, strftime(first, {MOMENT}) AS first_event, strftime(settled, {MOMENT}) AS settled_at, n_events"
REPORT = "SELECT label, kind, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM report"
MODEL_TABLE = """SELECT label, n_docs, round(log_prior, 9) AS log_prior, round(log_unseen, 9) AS log_unseen,
  coalesce(n_weights, 0) AS n_weights, coalesce(sum_log_prob, 0) AS sum_log_prob
FROM classes LEFT JOIN (SELECT label, count(*) AS n_weights, round(sum(log_prob), 4) AS sum_log_prob FROM weights GROUP BY label) USING (label)"""
DIGEST = "page_id, md5(html) AS digest"
KEYS = "regexp_matches(lower(string_split(src, '/')[-1]), 'tax|steuer')"
MODEL = ("classes", "weights")


def oracles() -> dict[str, str]:
    exact = (
        rf"(?i)({'|'.join(name for name, _ in settings.MONTHS)})\s*([0-9]{{4}})"
    )
    codes = "MAP {" + ", ".join(f"'{n}': '{c}'" for n, c in settings.MONTHS) + "}"
    month = f"{codes}[lower(regexp_extract(text, '{exact}', 1))]"
    year = f"try_cast(regexp_extract(text, '{exact}', 2) AS INTEGER)"
    plausible = f"{year} BETWEEN {settings.OLDEST_YEAR} AND {NEWEST}"
    path = "split_part(url, '?', 1) || CASE WHEN page_id % 3 = 0 THEN '.v2.PDF' ELSE '' END"
    name = "split_part(path, '/', -1)"
    suffix = rf"regexp_extract({name}, '[^.].*(\.[^.]+)$', 1)"
    out = {
        "normalize": build("SELECT doc_id, norm FROM norms", "norms"),
        "tokens": build(
            f"SELECT doc_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token FROM (SELECT doc_id, {words('norm')} AS t FROM norms)",
            "norms",
        ),
        "stopwords": build(f"SELECT doc_id, array_to_string({kept_words('norm')}, ' ') AS kept FROM norms", "norms"),
        "bigrams": build(
            f"""SELECT doc_id, unnest(range(len(t) - 1))::INTEGER AS pos,
              unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair
            FROM (SELECT doc_id, {kept_words('norm')} AS t FROM norms) WHERE len(t) > 1""",
            "norms",
        ),
        "term_freq": build("SELECT doc_id, term, tf FROM tf", "tf"),
        "doc_freq": build("SELECT term, df, cf FROM freqs", "freqs"),
        "vocab": build("SELECT term, df, cf, round(idf, 9) AS idf FROM vocab", "vocab"),
        "tfidf": build("SELECT doc_id, term, round(tfidf, 9) AS tfidf FROM vec", "vec"),
        "class_priors": build(
            "SELECT label, count(*) AS n_docs, round(ln(count(*) / (SELECT count(*) FROM corpus)), 9) AS log_prior FROM corpus GROUP BY label",
            "corpus",
        ),
        "nb_weights": build("SELECT label, term, round(log_prob, 6) AS log_prob FROM weights", "weights"),
        "label_count": build("SELECT count(DISTINCT label) AS n_labels FROM corpus", "corpus"),
        "classify": build(
            """SELECT doc_id, CASE WHEN text = '' THEN '' ELSE subfolder END AS subfolder,
              CASE WHEN text = '' THEN 0.0 ELSE round(confidence, 6) END AS confidence
            FROM documents JOIN best USING (doc_id)""",
            "best",
        ),
        "top3": build("SELECT doc_id, rank::INTEGER AS rank, label, round(p, 6) AS p FROM ranked WHERE rank <= 3", "ranked"),
        "top_terms": build(
            """SELECT label, rank::INTEGER AS rank, term, round(log_prob, 6) AS log_prob FROM (
              SELECT label, term, log_prob, row_number() OVER (PARTITION BY label ORDER BY round(log_prob, 9) DESC, term) AS rank
              FROM (SELECT label, term, coalesce(log_prob, c.log_unseen) AS log_prob
                FROM (SELECT label, log_unseen FROM classes ORDER BY label LIMIT 20) c CROSS JOIN (SELECT term FROM vocab)
                LEFT JOIN (SELECT label, term, log_prob FROM weights) USING (label, term)))
            WHERE rank <= 10""",
            "weights",
            "vocab",
        ),
        "model_summary": build(
            "SELECT (SELECT count(DISTINCT label) FROM corpus) AS n_classes, (SELECT count(*) FROM vocab) AS n_terms", "vocab"
        ),
        "model_roundtrip": build(MODEL_TABLE, *MODEL),
        "train_folder": build(
            MODEL_TABLE,
            *MODEL,
            fitted=f"""SELECT doc_id, 'lang=' || lang || '/source=' || source AS label, norm FROM documents JOIN norms USING (doc_id)
            WHERE length(trim(norm)) > {settings.MIN_TEXT}""",
        ),
        "ingest_folder": build(
            """SELECT bucket, subfolder, 'MOVE' AS action, count(*) AS n_files, count(*) AS n_targets
            FROM (SELECT subfolder, CASE WHEN confidence >= 0.75 THEN 'Review' ELSE 'Unsure' END AS bucket
              FROM best JOIN pages ON page_id = doc_id WHERE page_id % 4 <> 3) GROUP BY bucket, subfolder""",
            "best",
            scored_docs=f"SELECT page_id AS doc_id, {norm('html')} AS norm FROM pages",
        ),
        # Files at the top of the folder have no label.
        "train": build(MODEL_TABLE, *MODEL, fitted="SELECT doc_id, label, norm FROM corpus WHERE doc_id % 50 <> 0"),
        "train_changes": build(MODEL_TABLE, *MODEL, fitted="SELECT doc_id, label, norm FROM corpus WHERE doc_id % 50 <> 0"),
        "class_filter": build("SELECT doc_id, label FROM fine JOIN fine_sizes USING (label) WHERE n_docs >= 2", "fine_sizes"),
        "excluded_classes": build("SELECT label FROM fine_sizes WHERE n_docs < 2", "fine_sizes"),
        "data_guard": build(
            f"""SELECT *, CASE WHEN n_docs = 0 THEN 'no training data' WHEN n_labels < 2 THEN 'fewer than two labels'
              WHEN n_kept_labels < 2 THEN 'fewer than two labels with enough samples'
              WHEN ceil(n_kept * {settings.TEST_SHARE}::DOUBLE) < n_kept_labels THEN 'test part smaller than the number of labels' END AS reason
            FROM (SELECT sum(n_docs)::BIGINT AS n_docs, count(*) AS n_labels,
              coalesce(sum(n_docs) FILTER (n_docs >= 2), 0)::BIGINT AS n_kept, count(*) FILTER (n_docs >= 2) AS n_kept_labels FROM fine_sizes)""",
            "fine_sizes",
        ),
        "split": build("SELECT doc_id, label, is_test FROM parts", "parts"),
        "class_report": build(
            REPORT,
            "report",
            report_counts=STEPS["report_counts"][1].replace(
                "FROM pairs", "FROM (SELECT 'k' || quality AS truth, 'k' || toxic * 2 AS predicted FROM labels)"
            ),
        ),
        "evaluate": build(
            REPORT,
            "best",
            "report",
            fitted="SELECT doc_id, label, norm FROM parts WHERE is_test = 0",
            scored_docs="SELECT doc_id, norm FROM parts WHERE is_test = 1",
            report_counts=STEPS["report_counts"][1].replace(
                "FROM pairs",
                "FROM (SELECT label AS truth, subfolder AS predicted FROM parts JOIN best USING (doc_id) WHERE is_test = 1)",
            ),
        ),
        "text_date": build(f"SELECT o_orderkey, strftime({text_day('text')}, {DATE}) AS day FROM doc_dates", "doc_dates"),
        "month_exact": build(
            f"""SELECT o_orderkey, CASE WHEN {plausible} THEN {month} END AS month, CASE WHEN {plausible} THEN {year} END AS year
            FROM doc_months""",
            "doc_months",
        ),
        "sanitize": f"SELECT doc_id, {clean('text')} AS subject FROM documents",
        "build_name": f"""SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') || ' ' ||
          {clean("(o_orderpriority || ': <' || o_orderstatus || '>  Nr. ' || o_orderkey || '?')")} || '.pdf' AS name FROM orders""",
        "first_line": f"SELECT doc_id, {first_line_subject('text')} AS subject FROM documents",
        "keyword_subject": """SELECT doc_id, CASE WHEN contains(text, 'Que') THEN 'Frage' WHEN contains(text, 'und') THEN 'Verbindung'
          WHEN contains(text, 'the') THEN 'Artikel' END AS subject FROM documents""",
        "reply_parse": build(
            "SELECT o_orderkey, reply_date, reply_subject, (reply_date IS NOT NULL)::INTEGER AS complete FROM replies", "replies"
        ),
        "reply_date": build(f"SELECT o_orderkey, strftime({reply_day('reply_date')}, {DATE}) AS day FROM replies", "replies"),
        "prompt": f"SELECT doc_id, left(text, {settings.PROMPT_CHARS}) AS prompt FROM documents",
        "fill_date": build(
            f"""SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderkey % 4 = 1 THEN DATE '2020-02-29' END,
              {reply_day('reply_date')}, {text_day('text')}, (o_orderdate + INTERVAL 20 DAY)::DATE), {DATE}) AS day
            FROM doc_dates JOIN replies USING (o_orderkey)""",
            "doc_dates",
            "replies",
        ),
        "fill_subject": build(
            f"""SELECT doc_id, coalesce(known, nullif({first_line_subject('text')}, ''), '{settings.UNKNOWN_SUBJECT}') AS subject,
              CASE WHEN known IS NULL THEN 0.0::DOUBLE ELSE (doc_id % 100) / 100.0::DOUBLE END AS confidence
            FROM (SELECT *, coalesce(CASE WHEN doc_id % 6 = 0 THEN 'Aus Regel' END, nullif(reply_subject, '')) AS known FROM inbox)""",
            "inbox",
        ),
        "plugin_extractor": """SELECT doc_id, CASE WHEN asked THEN '2024.5.1' END AS reply_date,
          CASE WHEN asked THEN least(length(text), 4000) || ' Zeichen' END AS reply_subject
          FROM (SELECT *, doc_id % 3 = 0 OR doc_id % 2 <> 0 AS asked FROM documents)""",
        "label_from_path": "SELECT doc_id, lang || '/' || source AS label FROM documents WHERE doc_id % 50 <> 0",
        "path_parts": rf"""SELECT page_id, left(path, length(path) - length({name}) - 1) AS parent, {name} AS name,
          left({name}, length({name}) - length({suffix})) AS stem, {suffix} AS suffix, CASE WHEN starts_with(path, 'http:/') THEN substring(path, 7) END AS relative
          FROM (SELECT page_id, {path} AS path FROM pages)""",
        "suffix_filter": build("SELECT doc_id, path FROM inbox WHERE lower(path) LIKE '%.pdf'", "inbox"),
        "min_text": build(f"SELECT doc_id, length(norm)::INTEGER AS n FROM norms WHERE length(trim(norm)) > {settings.MIN_TEXT}", "norms"),
        "route": build("SELECT doc_id, bucket FROM scored", "scored"),
        "target_path": build("SELECT doc_id, target FROM targets", "targets"),
        "collisions": """WITH wanted AS (SELECT p_partkey AS doc_id, 'Review/' || p_brand AS folder, p_name FROM part),
          used AS (SELECT folder, p_name, list(DISTINCT doc_id % 40) AS taken FROM (
              SELECT folder, p_name, CASE WHEN doc_id % 40 = 3 THEN 40 ELSE doc_id END AS doc_id FROM wanted WHERE doc_id % 10 = 3)
            GROUP BY ALL),
          turns AS (SELECT *, row_number() OVER (PARTITION BY folder, p_name ORDER BY doc_id) AS k FROM wanted),
          free AS (SELECT doc_id, folder, p_name,
            list_filter(range(k + len(coalesce(taken, []))), lambda i: NOT list_contains(coalesce(taken, []), i))[k] AS n
            FROM turns LEFT JOIN used USING (folder, p_name))
          SELECT doc_id, folder, p_name || CASE WHEN n = 0 THEN '' ELSE ' (' || n || ')' END || '.pdf' AS final_name FROM free""",
        "collisions_mixed": """WITH RECURSIVE parts AS (SELECT p_partkey AS doc_id, 'Review/' || p_brand AS folder, p_name,
              p_name || CASE WHEN p_partkey % 7 = 0 THEN ' (' || (p_partkey % 5 + 1) || ')' ELSE '' END AS base FROM part),
            turns AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS turn FROM parts),
            there AS (SELECT folder, list(p_name || CASE WHEN doc_id % 40 = 3 THEN '' ELSE ' (' || (doc_id % 40) || ')' END) AS taken
              FROM parts WHERE doc_id % 10 = 3 GROUP BY folder),
            placed AS (
              SELECT folder, 0::BIGINT AS turn, coalesce(taken, []) AS taken, NULL::BIGINT AS doc_id, NULL::VARCHAR AS final
              FROM (SELECT DISTINCT folder FROM parts) LEFT JOIN there USING (folder)
              UNION ALL
              SELECT folder, turn, list_append(taken, final), doc_id, final FROM (
                SELECT p.folder, t.turn, p.taken, t.doc_id, list_filter(
                  list_transform(range(len(p.taken) + 1), lambda k: CASE WHEN k = 0 THEN t.base ELSE t.base || ' (' || k || ')' END),
                  lambda f: NOT list_contains(p.taken, f))[1] AS final
                FROM placed p JOIN turns t ON t.folder = p.folder AND t.turn = p.turn + 1))
            SELECT doc_id, folder, final || '.pdf' AS final_name FROM placed WHERE doc_id IS NOT NULL""",
        "manifest": build("SELECT doc_id, path AS src, dst, bucket, subfolder, 'COPY' AS action FROM filed", "filed"),
        "manifest_view": build(
            """SELECT doc_id, string_split(path, '/')[-1] AS source,
              CASE WHEN bucket = 'Review' THEN substring(target, 8) ELSE target END AS target FROM targets""",
            "targets",
        ),
        "tax_copies": build(
            f"""SELECT max(doc_id) AS doc_id, max_by(dst, doc_id) AS src, '{'Review/' + settings.TAX_FOLDER}/' || string_split(dst, '/')[-1] AS dst,
              'Review' AS bucket, '{settings.TAX_FOLDER}' AS subfolder, 'COPY' AS action
            FROM (SELECT *, path AS src FROM filed) f WHERE {KEYS} GROUP BY string_split(dst, '/')[-1]""",
            "filed",
        ),
        "promote": build("SELECT path AS src, '/Archiv' || substring(path, 8) AS dst FROM review", "review"),
        "promote_conflicts": build(
            "SELECT path AS src, '/Archiv' || substring(path, 8) AS dst FROM review WHERE length(path) % 7 = 0", "review"
        ),
        "empty_dirs": """WITH dirs AS (SELECT doc_id, '/Review/' || lang AS a, '/Review/' || lang || '/' || source AS b,
            '/Review/' || lang || '/' || source || '/' || (doc_id % 40) AS c FROM documents)
          SELECT dir FROM (SELECT unnest([a, b, c]) AS dir, doc_id FROM dirs) GROUP BY dir HAVING count(*) FILTER (doc_id % 11 = 0) = 0""",
        "folder_counts": """SELECT bucket, count(doc_id) AS n_files FROM (SELECT unnest(['Inbox', 'Review', 'Unsure']) AS bucket)
          LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 10 < 6 THEN 'Inbox' ELSE 'Review' END AS bucket FROM documents) USING (bucket) GROUP BY bucket""",
        "move_summary": "SELECT count(*) FILTER (doc_id % 9 <> 4) AS moved, count(*) AS total FROM documents",
        "progress": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents",
        "page_assembly": """SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) FILTER ((conv_id * 7 + turn) % 6 <> 0 AND text <> '') AS text
          FROM conversations GROUP BY conv_id""",
        "scan_inbox": f"SELECT {DIGEST} FROM pages WHERE page_id % 4 <> 3",
        "scan_corpus": f"SELECT {DIGEST} FROM pages",
        "scan_review": build(
            """SELECT '.pdf' AS ext, count(*) AS n_files, sum(n_bytes)::BIGINT AS n_bytes FROM page_lines
            UNION ALL SELECT '.txt', count(*), sum(n_bytes)::BIGINT FROM page_lines WHERE page_id % 10 = 0""",
            "page_lines",
        ),
        "read_errors": """SELECT CASE WHEN page_id % 9 = 0 THEN -1 ELSE page_id END AS page_id, (page_id % 9 = 0)::INTEGER AS failed,
          CASE WHEN page_id % 9 = 0 THEN -1 ELSE length(page_id::VARCHAR) + 1 + length(html) END::INTEGER AS n_chars FROM pages""",
        "content_hash": "SELECT doc_id, md5(text) AS content_hash FROM documents",
        "cache_hits": build("SELECT doc_id, content_hash FROM hashed WHERE content_hash IN (SELECT content_hash FROM cached)", "cached", "hashed"),
        "cache_misses": build(
            "SELECT DISTINCT content_hash FROM hashed WHERE content_hash NOT IN (SELECT content_hash FROM cached)", "cached", "hashed"
        ),
        "cache_refresh": build(f"SELECT DISTINCT content_hash, {norm('text')} AS norm_text FROM hashed", "hashed"),
        "cache_stats": build(
            """SELECT n - fresh AS hits, fresh AS new_entries, total FROM (SELECT count(*) AS n, count(DISTINCT content_hash) AS total,
              count(DISTINCT content_hash) FILTER (content_hash NOT IN (SELECT content_hash FROM cached)) AS fresh FROM hashed)""",
            "cached",
            "hashed",
        ),
        "settle_batch": build(f"SELECT {SESSION_COLUMNS} FROM sessions", "sessions"),
        "settle_stream": build(f"SELECT {SESSION_COLUMNS} FROM sessions", "sessions"),
        "stream_intake": f"SELECT {DIGEST} FROM pages WHERE page_id % 4 <> 3",
        "stream_once": "SELECT page_id, 1 AS n_times, page_id % 2 AS batch_id FROM pages",
        "stream_settled": "SELECT page_id, 1 AS n_times, 2 AS batch_id FROM pages",
        "stream_metrics": "SELECT page_id % 2 AS batch_id, count(*) AS n_files, count(*) AS n_rows FROM pages GROUP BY 1",
        "stream_poison": """SELECT page_id, CASE WHEN page_id = 1 THEN 0 ELSE 1 END AS n_times, CASE WHEN page_id = 1 THEN 3 ELSE 0 END AS attempts
            FROM pages WHERE page_id % 4 <> 3""",
        "stream_process": build(
            """SELECT doc_id, CASE WHEN k = 0 THEN base ELSE base || ' (' || k || ')' END || '.pdf' AS dst, bucket, subfolder, 'MOVE' AS action
            FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id % 2, doc_id) - 1 AS k
              FROM (SELECT *, bucket || '/' || subfolder || '/2024.05.01 ' || n || ' Zeichen' AS base
                FROM (SELECT doc_id, subfolder, CASE WHEN confidence >= 0.75 THEN 'Review' ELSE 'Unsure' END AS bucket, least(length(html), 4000) AS n
                  FROM best JOIN pages ON page_id = doc_id)))""",
            "best",
            scored_docs=f"SELECT page_id AS doc_id, {norm('html')} AS norm FROM pages",
        ),
        "stream_retry": "SELECT page_id, 1 AS n_times FROM pages WHERE page_id % 4 <> 3",
        "fuzzy_match": build(_whole_match("p_partkey", norm("p_name || ', ' || p_type"), "part", "small ring economy", 60)),
        "fuzzy_match_docs": build(_whole_match("doc_id", norm("text"), "documents", _norm(NEEDLE), 50)),
        "fuzzy_short": build(
            f"""SELECT p_partkey, coalesce(score >= {0.7 * 100}::DOUBLE, false)::INTEGER AS hit FROM part
            LEFT JOIN ({fuzzy_sql.part_scores(f"(SELECT p_partkey AS id, {norm('p_name')} AS norm FROM part)", _norm(LONG_NEEDLE))}) p ON p.id = p_partkey"""
        ),
        "fuzzy_contains": build(
            f"""SELECT doc_id, coalesce(score >= {0.6 * 100}::DOUBLE, false)::INTEGER AS hit FROM norms
            LEFT JOIN ({fuzzy_sql.part_scores('(SELECT doc_id AS id, norm FROM norms)', _norm(NEEDLE))}) p ON p.id = doc_id""",
            "norms",
        ),
        "fuzzy_find": build(
            f"""SELECT doc_id, span_start::INTEGER AS span_start, span_end::INTEGER AS span_end FROM norms
            LEFT JOIN ({fuzzy_sql.spans('(SELECT doc_id AS id, norm FROM norms)', _norm(NEEDLE), 60)}) p ON p.id = doc_id""",
            "norms",
        ),
        "month_fuzzy": _with_months(
            "SELECT m.id AS o_orderkey, month, year FROM month_texts m LEFT JOIN near_months USING (id)", "month_texts"
        ),
        "month_year": _with_months(
            f"""SELECT m.id AS o_orderkey, CASE WHEN {plausible} THEN {month} ELSE near.month END AS month,
              CASE WHEN {plausible} THEN {year} ELSE near.year END AS year
            FROM month_texts m LEFT JOIN near_months near USING (id)""",
            "month_texts",
        ),
        "rules": _with_months(
            f"""SELECT d.id AS o_orderkey, CASE
              WHEN subfolder = '{settings.FUND_FOLDER}' THEN CASE WHEN contains(text, 'ERTRAGSAUSSCHÜTTUNG') THEN 'Ertragsausschüttung'
                WHEN contains(text, 'Quartalsbericht') THEN 'Quartalsbericht' END
              WHEN subfolder = '{settings.PAYROLL_FOLDER}' THEN CASE WHEN b.score >= 65 THEN 'Meldebescheinigung zur Sozialversicherung'
                WHEN a.score >= 65 THEN 'Abrechnung Canway ' || CASE WHEN {plausible} THEN {year} ELSE near.year END || '.' ||
                  CASE WHEN {plausible} THEN {month} ELSE near.month END END END AS subject
            FROM rule_docs d LEFT JOIN near_months near USING (id)
            LEFT JOIN ({fuzzy_sql.part_scores('rule_norms', 'abrechnung der brutto')}) a ON a.id = d.id
            LEFT JOIN ({fuzzy_sql.part_scores('rule_norms', 'meldebescheinigung zur sozialversicherung')}) b ON b.id = d.id""",
            "rule_docs",
            "rule_norms",
        ),
        "ingest": build(
            f"""SELECT doc_id, path AS src, dst, bucket, subfolder, 'MOVE' AS action FROM named
            UNION ALL
            SELECT max(doc_id), max_by(dst, doc_id), 'Review/{settings.TAX_FOLDER}/' || string_split(dst, '/')[-1], 'Review', '{settings.TAX_FOLDER}', 'COPY'
            FROM (SELECT *, path AS src FROM named) f WHERE {KEYS} GROUP BY string_split(dst, '/')[-1]""",
            "named",
        ),
    }
    return out


STEPS["understood"] = (
    ("inbox", "best"),
    f"""SELECT doc_id, path, subfolder, text, known, CASE WHEN known IS NULL THEN 0.0 ELSE confidence END AS confidence,
      coalesce(known, nullif({first_line_subject('text')}, ''), '{settings.UNKNOWN_SUBJECT}') AS subject,
      coalesce({reply_day('reply_date')}, {text_day('text')}, mday) AS day
    FROM (SELECT *, coalesce(
        CASE WHEN subfolder = 'de/src2' AND contains(text, 'und') THEN 'Deutscher Beleg'
          WHEN subfolder = 'en/src1' AND contains(text, 'the') THEN 'Englischer Beleg'
          WHEN subfolder = 'en/src1' AND contains(text, 'and') THEN 'Zweiter Beleg' END, nullif(reply_subject, '')) AS known
      FROM (SELECT i.*, CASE WHEN text = '' THEN '' ELSE b.subfolder END AS subfolder, CASE WHEN text = '' THEN 0.0 ELSE b.confidence END AS confidence
        FROM inbox i JOIN best b USING (doc_id) WHERE lower(path) LIKE '%.pdf'))""",
)
STEPS["named"] = (
    ("understood",),
    f"""SELECT *, CASE WHEN k = 0 THEN target ELSE left(target, length(target) - 4) || ' (' || k || ').pdf' END AS dst
    FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY doc_id) - 1 AS k
      FROM (SELECT *, bucket || '/' || CASE WHEN subfolder = '' THEN '' ELSE subfolder || '/' END ||
          strftime(day, '%Y.%m.%d') || ' ' || {clean('subject')} || '.pdf' AS target
        FROM (SELECT *, CASE WHEN confidence >= 0.5 THEN 'Review' ELSE 'Unsure' END AS bucket FROM understood)))""",
)
