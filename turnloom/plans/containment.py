"""Substring matches between two vocabularies as equi-joins.

"Needle occurs in word" is turned into a join on the needle's first characters against every
position of the word, followed by an exact comparison. Only distinct strings take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4


def words_of(text, min_length: int = GRAM):
    """Distinct runs of letters, digits and dashes: a token can only occur inside one of them."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9-]{%d,}" % min_length), F.lit(0))
    return F.array_distinct(runs)


def positions(words: DataFrame, word: str) -> DataFrame:
    """Adds gram: a row for each position of a word, with the characters that a token found there begins with."""
    rows = words.filter(F.length(word) >= GRAM)
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.length(word) - (GRAM - 1)))).withColumn("gram", F.expr(f"substring({word}, i, {GRAM})"))


def texts_containing(
    needles: DataFrame, texts: DataFrame, key: str, needle: str = "needle", text: str = "low", longest: int | None = None
) -> DataFrame:
    """(key, needle) for short texts and arbitrary needles, by first 1 to 4 characters at every position.

    With the length of the longest needle a position carries only that many characters, not the rest of the text.
    """
    probes = (
        needles.select(F.col(needle).alias("needle"))
        .filter(F.length("needle") > 0)
        .distinct()
        .withColumn("gram", F.expr(f"substring(needle, 1, {GRAM})"))
    )
    starts = texts.select(key, F.col(text).alias("low")).filter(F.length("low") > 0)
    starts = starts.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("low"))))
    here = F.col("low").substr(F.col("i"), F.lit(max(longest, GRAM)) if longest is not None else F.length("low"))
    starts = starts.select(key, here.alias("here"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.col("here").substr(F.lit(1), n)))
    starts = starts.distinct().select(key, "here", F.explode(grams).alias("gram"))
    return starts.join(probes, "gram").filter(F.col("here").startswith(F.col("needle"))).select(key, "needle").distinct()
