"""Matching rows to clues without a row-by-clue loop or a nested-loop join.

A short list of clues is a caller's parameter and becomes an array expression.  Plain texts that are data
meet the pieces of the texts that have their lengths.  Regexes that are data meet the texts through an
inverted index: every regex needs some literal, every literal has grams of
up to ``GRAM`` characters, and a text that fits holds them all.  The rarest gram of a literal meets the
grams of the distinct texts in an equi join, and only what met is tested with the clue itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept

#: Longest gram of the index.  Longer grams are rarer, and a text has no more of them than of short ones.
GRAM = 12
#: Most clues of a table that may lack a literal; these are tested on every distinct text.
MOST_LOOSE = 200

# fixed values: characters with a meaning in a regex, and what stands for them while they are escaped
_META = r"\^$.|?*+()[]{}"
_ASIDE = "".join(chr(0xE000 + i) for i in range(len(_META)))
_GAP = "\x00"


def with_clues(df: DataFrame, column: str, clues: Sequence[str], into: str = "clue") -> DataFrame:
    """One output row per row and matching regex clue.

    The clue list is a caller's parameter, so it becomes an array expression: the
    table is scanned once for all clues and nothing is shuffled.
    """
    hits = F.array(*[F.when(F.col(column).rlike(c), F.lit(c)) for c in clues])
    return df.withColumn(into, F.explode(F.array_compact(hits)))


# -- what a regex needs ----------------------------------------------------------


def required_literals(clue: Column) -> Column:
    """One literal per alternative of a regex: whatever the regex finds holds at least one of them.

    Null if some alternative has no literal that is certain: look-arounds, flags, back references,
    numbered characters and deeply nested groups are not read.  What is left out of a literal
    (classes, groups, optional characters) only makes it shorter, never wrong.
    """
    text = clue
    for i, sign in enumerate(_META):  # an escaped sign is a plain character
        text = F.replace(text, F.lit("\\" + sign), F.lit(_ASIDE[i]))
    unread = text.rlike(r"\(\?[^:]|\\[^dDwWsSbBAzZ]|\x00") | clue.rlike(f"[{_ASIDE[0]}-{_ASIDE[-1]}]")
    text = F.regexp_replace(text, r"\\[dDwWsSbBAzZ]", _GAP)
    text = F.regexp_replace(text, r"\[\^?[^\[\]]+\]", _GAP)
    # a pair of brackets around the whole clue is no group of its own
    text = F.regexp_replace(text, r"^\((?:\?:)?([^()]*)\)$", "$1")
    for _ in range(3):  # a group is opaque: its alternatives are not those of the clue
        text = F.regexp_replace(text, r"\([^()]*\)", _GAP)
    text = F.regexp_replace(text, r"[^?*+{}|](?:[?*]|\{[0-9,]*\})[?+]?", _GAP)
    text = F.regexp_replace(text, r"\+[?+]?", _GAP)
    text = F.regexp_replace(text, r"[.^$]", _GAP)
    unread = unread | text.rlike(r"[()\[\]{}?*\\]")
    longest = F.transform(
        F.split(text, r"\|", -1),
        lambda part: F.element_at(
            F.array_sort(
                F.transform(F.split(part, _GAP, -1), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))
            ),
            1,
        )["p"],
    )
    plain = F.transform(longest, lambda p: F.translate(p, _ASIDE, _META))
    return F.when(unread | F.array_contains(plain, ""), None).otherwise(plain)


# -- clues that are data ------------------------------------------------------------


def _grams(text: Column, size: int | Column) -> Column:
    """Distinct grams of a text; none if it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def _candidates(distinct: DataFrame, value: str, literals: DataFrame) -> DataFrame:
    """(value, __clue): texts that hold the rarest gram of a literal (__clue, __literal) of the clue.

    The distinct texts are read twice, so they are written first.  Their grams are not: frequent ones would be
    rows for nothing, as a literal meets texts by its rarest gram only.  A clue table has many more grams than its
    size lets Spark expect, and the rows of an exploded table are not counted before a broadcast: joins with grams
    and clues are merge joins, so that the driver never holds them.
    """
    distinct = kept(distinct)
    size = F.least(F.length("__literal"), F.lit(GRAM))
    wanted = literals.select("__clue", "__literal", F.explode(_grams(F.col("__literal"), size)).alias("__gram"))
    # a short literal has one gram, itself; as many rows as there are gram sizes, so safe to broadcast
    sizes = literals.select(size.alias("__size")).distinct()
    sized = distinct.withColumn("__size", F.explode(F.sequence(F.lit(1), F.least(F.length(value), F.lit(GRAM)))))
    sized = sized.where(F.length(value) > 0).join(F.broadcast(sizes), "__size", "left_semi")
    index = sized.select(value, F.explode(_grams(F.col(value), F.col("__size"))).alias("__gram"))
    asked = index.join(wanted.select("__gram").distinct().hint("merge"), "__gram", "left_semi")
    seen = asked.groupBy("__gram").agg(F.count(F.lit(1)).alias("__texts"))
    # a literal with a gram that no text has fits nothing
    rated = wanted.join(seen.hint("merge"), "__gram", "left").groupBy("__clue", "__literal")
    rarest = rated.agg(
        F.count_if(F.col("__texts").isNull()).alias("__missing"), F.min(F.struct("__texts", "__gram")).alias("__rare")
    )
    chosen = rarest.where("__missing = 0").select("__clue", F.col("__rare.__gram").alias("__gram")).distinct()
    return index.join(chosen.hint("merge"), "__gram").select(value, "__clue")


def _texts(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def containing_values(
    values: DataFrame, value: str, clues: DataFrame, clue: str
) -> DataFrame:
    """Distinct (value, clue) pairs where the text ``value`` contains the text ``clue``.

    For clues that are data themselves.  Comparing every value with every clue
    would be a cross product; instead each distinct value is cut into its
    substrings, only of lengths that some clue has, and the pieces meet the clues
    in an equi join.  The work per value is bounded by the square of its length,
    whatever the number of clues.
    """
    wanted = clues.select(F.col(clue)).where(F.col(clue).isNotNull() & (F.col(clue) != "")).distinct()
    # as many rows as there are text lengths, so at most the longest clue: safe to broadcast
    lengths = wanted.select(F.length(clue).alias("__n")).distinct()
    distinct = values.select(F.col(value)).where(F.col(value).isNotNull()).distinct()
    sized = distinct.withColumn("__n", F.explode(F.sequence(F.lit(1), F.length(value)))).join(
        F.broadcast(lengths), "__n", "left_semi"
    )
    pieces = sized.select(
        F.col(value),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length(value) - F.col("__n") + 1),
                    lambda i: F.substring(F.col(value), i, F.col("__n")),
                )
            )
        ).alias("__piece"),
    )
    wanted = wanted.select(F.col(clue).alias("__clue"))
    return pieces.join(wanted, pieces["__piece"] == wanted["__clue"]).select(
        F.col(value), F.col("__clue").alias(clue)
    )


def matching_values(
    values: DataFrame, value: str, clues: DataFrame, clue: str, most_loose: int = MOST_LOOSE
) -> DataFrame:
    """Distinct (value, clue) pairs where the regex ``clue`` finds something in the text ``value``.

    For clue tables.  A regex with a required literal in each of its alternatives is looked up in the
    index; one without (``.``, ``[ab]+``) has to see every text, so these are tested as an array expression
    on the scan of the distinct texts, and more than ``most_loose`` of them are refused.  Unknown texts and
    clues are in no pair; an empty clue fits every text; an invalid regex raises.
    """
    wanted = _texts(clues, clue, "__clue").withColumn("__literals", required_literals(F.col("__clue")))
    distinct = _texts(values, value, value)
    unread = wanted.where("__literals is null").select("__clue")
    loose = [row["__clue"] for row in unread.limit(most_loose + 1).collect()]
    if len(loose) > most_loose:
        raise ValueError(f"more than {most_loose} clues have no literal to look up, such as {loose[0]!r}")
    literals = wanted.select("__clue", F.explode("__literals").alias("__literal")).distinct()
    met = _candidates(distinct, value, literals).distinct()
    pairs = met.where(F.regexp_like(F.col(value), F.col("__clue"))).select(F.col(value), F.col("__clue").alias(clue))
    return pairs.unionByName(with_clues(distinct, value, loose, clue)) if loose else pairs
