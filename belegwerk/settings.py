"""Fixed values and job parameters."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

# --- Fixed values. Results depend on every one of them. ---

# German stop words, dropped before word pairs are formed.
STOP_WORDS = tuple(
    """
    der die das ein eine einer einem einen
    ich du er sie es wir ihr ihnen
    mein meine meiner meinem meinen
    dein deine deiner deinem deinen
    sein seine seiner seinem seinen
    ihr ihre ihrer ihrem ihren
    von vom zu zum zur mit bei nach
    für auf aus in im an am unter
    über durch gegen ohne
    und oder aber sowie dass da weil
    wenn als ob
    ist sind war waren wird werden
    hat haben hatte hatten
    kann können soll sollen
    auch noch bereits nur nicht kein
    eines einem einer des dem den
    gmbh kg ag mbh euro eur
    rechnung konto datum
    """.split()
)

# Month names in search order, with their codes.
MONTHS = (
    ("januar", "01"),
    ("februar", "02"),
    ("märz", "03"),
    ("maerz", "03"),
    ("april", "04"),
    ("mai", "05"),
    ("juni", "06"),
    ("juli", "07"),
    ("august", "08"),
    ("september", "09"),
    ("oktober", "10"),
    ("november", "11"),
    ("dezember", "12"),
)

# A term is a whole word of three or more of these characters.
TERM_PATTERN = "[a-z0-9äöüß]{3,}"
# A word is a run of letters, digits and underscores of any script.
WORD_PATTERN = r"[\p{L}\p{N}_]+"

YEAR_FIRST = r"([0-9]{4})\s*[.\-/]\s*([0-9]{1,2})\s*[.\-/]\s*([0-9]{1,2})"
DAY_FIRST = r"([0-9]{1,2})\s*[.\-/]\s*([0-9]{1,2})\s*[.\-/]\s*([0-9]{4})"
OLDEST_YEAR = 2000

MIN_DF = 2
MAX_DF = 0.9
MAX_TERMS = 50_000
ALPHA = 0.01
MIN_TEXT = 10

REVIEW_THRESHOLD = 0.75
TEST_SHARE = 0.2
SPLIT_SEED = 42
PROMPT_CHARS = 4000
NAME_CHARS = 120
LINE_CHARS = 50
NO_SUBJECT = "No Subject"
UNKNOWN_SUBJECT = "Unbekannt"
TAX_FOLDER = "Steuererklärung/neue Belege"
TAX_WORDS = ("tax", "steuer")
SETTLE_SECONDS = 5.0
ERROR_PAUSE_SECONDS = 7200.0
FILE_ATTEMPTS = 3

PAYROLL_FOLDER = "Lohnabrechnungen/2016.06.01 Canway"
FUND_FOLDER = "Versicherungen/Investmentfonds Riester - Deka"

# --- Job parameters. ---


@dataclass(frozen=True)
class Rule:
    """One subject rule. ``kind`` is ``keyword`` (case kept), ``phrase`` (fuzzy) or ``monthly``.

    A ``monthly`` rule fires on a fuzzy phrase plus a month and year; its template has the
    places ``{year}`` and ``{month}``.
    """

    rule_order: int
    subfolder: str
    kind: str
    pattern: str
    template: str
    threshold: float = 0.65
    month_threshold: float = 0.85
    # Rules that share a group exclude each other: the first hit of the group counts.
    group: str = ""


DEFAULT_RULES = (
    Rule(1, PAYROLL_FOLDER, "monthly", "Abrechnung der Brutto", "Abrechnung Canway {year}.{month}"),
    Rule(
        2,
        PAYROLL_FOLDER,
        "phrase",
        "Meldebescheinigung zur Sozialversicherung",
        "Meldebescheinigung zur Sozialversicherung",
    ),
    Rule(3, FUND_FOLDER, "keyword", "ERTRAGSAUSSCHÜTTUNG", "Ertragsausschüttung", group="fund"),
    Rule(4, FUND_FOLDER, "keyword", "Quartalsbericht", "Quartalsbericht", group="fund"),
)


@dataclass(frozen=True)
class JobSettings:
    """Settings of one processing job; ``mode`` is NO_CHANGE, MOVE or COPY."""

    as_of: datetime.date = field(default_factory=datetime.date.today)
    mode: str = "MOVE"
    review_root: str = "Review"
    unsure_root: str = "Unsure"
    threshold: float = REVIEW_THRESHOLD
    rules: tuple[Rule, ...] = DEFAULT_RULES

    def __post_init__(self) -> None:
        if self.mode not in ("NO_CHANGE", "MOVE", "COPY"):
            raise ValueError(f"mode must be NO_CHANGE, MOVE or COPY, not {self.mode!r}")
