"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin capitals and the plain letters they fold to.
ACCENTED = "ÀÁÂÃÄÅĀĂĄÇĆČĎÈÉÊËĒĖĘĚÌÍÎÏĪĮŁÑŃŇÒÓÔÕÖØŌŐŔŘŚŠŤÙÚÛÜŪŮŰŲÝŸŹŻŽ"
PLAIN = "AAAAAAAAACCCDEEEEEEEEIIIIIILNNNOOOOOOOORRSSTUUUUUUUUYYZZZ"


def fold(c: Column) -> Column:
    """Upper case without accents; null stays null."""
    return F.translate(F.upper(c), ACCENTED, PLAIN)


def words(c: Column, least: int = 1) -> Column:
    """The runs of letters of folded text that are at least ``least`` long, in order; null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(fold(c), F.lit("")), F.lit(f"([A-Z]{{{least},}})"), 1)
    return found


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0.95 at least where the shorter one (4 letters or more) starts the longer."""
    near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    starts = (F.least(F.length(a), F.length(b)) >= 4) & (F.startswith(a, b) | F.startswith(b, a))
    return F.when(starts, F.greatest(near, F.lit(0.95))).otherwise(near)


def opening_similarity(a: Column, b: Column) -> Column:
    """How well ``a``, perhaps cut off and misspelt, agrees with the opening of ``b``; 0 for less than five letters."""
    n = F.length(a)
    off = F.least(F.levenshtein(a, F.left(b, n)), F.levenshtein(a, F.left(b, n + 1)))
    return F.when((n >= 5) & (F.length(b) >= n - 1), 1 - off / n).otherwise(F.lit(0.0))
