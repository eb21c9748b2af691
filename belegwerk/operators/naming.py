"""Free file names: ``name``, then ``name (1)``, ``name (2)`` and so on, in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.functions.paths import stem, suffix
from belegwerk.operators.ranking import numbered, running_sum
from belegwerk.workspace import Workspace

NUMBERED = r"^(.*) \(([1-9][0-9]*)\)$"
ENDINGS = r"( \([1-9][0-9]*\))+$"


def used_numbers(names: DataFrame) -> DataFrame:
    """``folder, base, ext, number`` that existing ``folder, name`` rows take up.

    ``a (1).pdf`` is number 1 of ``a.pdf`` and number 0 of its own name.
    """
    parts = names.select("folder", stem("name").alias("stem"), suffix("name").alias("ext"))
    inner = F.regexp_extract("stem", NUMBERED, 1)
    # More than 18 digits cannot be a number that was ever given.
    number = F.regexp_extract("stem", NUMBERED, 2).try_cast("long")
    own = F.struct(F.col("stem").alias("base"), F.lit(0).cast("long").alias("number"))
    as_numbered = F.struct(inner.alias("base"), number.alias("number"))
    takes = F.when(number.isNotNull() & (inner != ""), F.array(own, as_numbered)).otherwise(F.array(own))
    return parts.select("folder", "ext", F.inline(takes)).distinct()


def _in_turn(ws: Workspace, docs: DataFrame) -> DataFrame:
    """Add ``_k``, the turn of each newcomer of a name, from 1."""
    return numbered(ws, docs, ["folder", "base", "ext"], ["doc_id"], "_k")


def _free_numbers(ws: Workspace, newcomers: DataFrame, used: DataFrame) -> DataFrame:
    """Add ``number`` to rows with a turn: the k-th newcomer of a name takes the k-th number not used.

    With the used numbers of a name in order, the j-th one (from 0) has ``number - j`` free numbers
    below it. The k-th free number is k plus the count of used ones with at most k free below. One
    running sum over both kinds of rows gives that count, so no list per name is built.
    """
    name = ["folder", "base", "ext"]
    wanted = newcomers.select(*name).distinct()
    used = ws.stage(used.join(wanted, name, "left_semi"), "taken")
    if used.isEmpty():
        return newcomers.withColumn("number", F.col("_k") - 1)
    gaps = numbered(ws, used, name, ["number"], "_j").select(
        *name, (F.col("number") - F.col("_j") + 1).alias("_at"), F.col("number").alias("_seq")
    )
    both = gaps.withColumn("_new", F.lit(0)).unionByName(
        newcomers.withColumns({"_at": F.col("_k") - 1, "_seq": F.col("_k"), "_new": F.lit(1)}),
        allowMissingColumns=True,
    )
    counted = running_sum(ws, both, name, ["_at", "_new", "_seq"], 1 - F.col("_new"), "_skipped")
    return (
        counted.where("_new = 1")
        .withColumn("number", F.col("_at") + F.col("_skipped"))
        .drop("_at", "_seq", "_new", "_skipped")
    )


def final_name(base: str = "base", number: str = "number", ext: str = "ext"):
    n = F.col(number)
    mark = F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.col(base), mark, F.col(ext))


def resolve_names(ws: Workspace, docs: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``number`` and ``final_name`` to ``doc_id, folder, name``, given ``folder, name`` on disk.

    The result is what one would get by placing the documents one by one in ``doc_id`` order. Names
    that themselves end in a number can meet the numbers given to the shorter name before it. They
    are settled by the depth of such endings, shallow names first: the rounds grow with that depth, not
    with the rows.
    """
    docs = docs.withColumns({"base": stem("name"), "ext": suffix("name")})
    docs = docs.withColumn("_family", F.regexp_replace("base", ENDINGS, ""))
    endings = F.regexp_extract("base", f"({ENDINGS})", 1)
    docs = ws.stage(docs.withColumn("_depth", F.size(F.split(endings, " \\(")) - 1), "wanted")
    keys = ["folder", "_family", "ext"]
    used = used_numbers(existing).withColumn("_family", F.regexp_replace("base", ENDINGS, ""))
    used = ws.stage(used.join(docs.select(*keys).distinct(), keys, "left_semi").drop("_family"), "used")
    depths = [row[0] for row in docs.select("_depth").distinct().orderBy("_depth").collect()]
    out: DataFrame | None = None
    for depth in range(depths[-1] + 1 if depths else 0):
        newcomers = docs.where(F.col("_depth") == depth)
        if depth not in depths:
            continue
        newcomers = ws.stage(_in_turn(ws, newcomers), "turns")
        blocked, lost = used, None
        if depth + 1 in depths:
            skipped, lost = _meetings(ws, newcomers, docs.where(F.col("_depth") == depth + 1), used)
            blocked = used.unionByName(skipped)
        given = _free_numbers(ws, newcomers, blocked)
        out = given if out is None else out.unionByName(given)
        if lost is not None:
            used = ws.stage(used.unionByName(lost), "used")
    if out is None:
        out = docs.withColumns({"_k": F.lit(1).cast("long"), "number": F.lit(0).cast("long")})
    return out.withColumn("final_name", final_name()).drop("base", "ext", "_family", "_depth", "_k")


def _meetings(ws: Workspace, newcomers: DataFrame, longer: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who gets the names that both a number of a newcomer and a longer wanted name would take.

    Returns the numbers that the newcomers must pass over, and the longer names that are gone, as number
    0 of themselves, both as ``folder, base, ext, number``.

    Only the first document that wants ``a (n)`` can take that name itself. Newcomers of ``a`` take rising
    numbers, so the one whose turn is n's place among the free numbers, less the numbers passed over
    before, is the only one that can want it: it does if it came before that document. Per longer name
    three integers are enough, and one is carried from number to number.
    """
    name = ["folder", "base", "ext"]
    inner, number = F.regexp_extract("base", NUMBERED, 1), F.regexp_extract("base", NUMBERED, 2).try_cast("long")
    first = longer.groupBy(*name).agg(F.min("doc_id").alias("first"))
    first = first.select("folder", inner.alias("base"), "ext", number.alias("number"), "first").where("number is not null")
    first = first.join(newcomers.select(*name).distinct(), name, "left_semi")
    first = ws.stage(first.join(used, [*name, "number"], "left_anti"), "longer")
    taken = used.join(first.select(*name).distinct(), name, "left_semi")
    numbers = taken.withColumns({"first": F.lit(None).cast(first.schema["first"].dataType), "_used": F.lit(1)})
    numbers = running_sum(ws, numbers.unionByName(first.withColumn("_used", F.lit(0))), name, ["number"], F.col("_used"), "_below")
    placed = numbers.where("_used = 0").select(*name, "number", "first", (F.col("number") + 1 - F.col("_below")).alias("place"))
    arrivals = placed.select(*name, F.col("first").alias("doc_id"), "number", "place", F.lit(0).alias("_new"))
    turns = newcomers.join(first.select(*name).distinct(), name, "left_semi").select(*name, "doc_id", F.lit(1).alias("_new"))
    arrivals = arrivals.unionByName(turns, allowMissingColumns=True)
    # A document wants one name, so no two rows of a name share a key.
    counted = running_sum(ws, arrivals, name, ["doc_id", "number"], F.col("_new"), "before")
    rows = counted.where("_new = 0").select(*name, "number", "place", "before")
    total = newcomers.groupBy(*name).agg(F.count(F.lit(1)).alias("turns"))
    rows = rows.join(total, name).repartition(*name).sortWithinPartitions(*name, "number")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, passed = None, 0
        for pdf in batches:
            gone = []
            for *of, place, before, turns in zip(*(pdf[c] for c in (*name, "place", "before", "turns"))):
                if of != current:
                    current, passed = of, 0
                turn = place - passed
                if turn > before:
                    passed += 1
                    gone.append(0)
                else:
                    gone.append(int(turn <= turns))
            if len(pdf):
                yield pdf[[*name, "number"]].assign(gone=gone)

    settled = rows.mapInPandas(settle, "folder string, base string, ext string, number long, gone int")
    settled = ws.stage(settled, "settled")
    skipped = settled.where("gone = 0").select(*name, "number")
    whole = F.concat("base", F.lit(" ("), F.col("number").cast("string"), F.lit(")"))
    lost = settled.where("gone = 1").select("folder", whole.alias("base"), "ext", F.lit(0).cast("long").alias("number"))
    return skipped, lost
