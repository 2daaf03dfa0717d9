"""Nucleotide strings as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC codes with the bases that they stand for, and their complements.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT",
    "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT = str.maketrans("ACGTURYKMBDHVSWN", "TGCAAYRMKVHDBSWN")


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(seq: Column | str) -> Column:
    """Upper case, without white space and gaps."""
    return F.upper(F.regexp_replace(_column(seq), r"[\s-]", ""))


def reverse_complement(seq: Column | str) -> Column:
    """Of DNA; U counts as T, other letters stay as they are."""
    return F.reverse(F.translate(_column(seq), "ACGTUacgtu", "TGCAAtgcaa"))


def reverse_complement_iupac(pattern: str) -> str:
    """Of a pattern of IUPAC codes, at plan time."""
    return pattern.upper().translate(COMPLEMENT)[::-1]


def iupac_regex(pattern: str) -> str:
    """A regular expression of the target bases that a pattern matches; N in a target matches nothing."""
    return "".join(f"[{IUPAC[c]}]" if len(IUPAC[c]) > 1 else IUPAC[c] for c in pattern.upper())


def iupac_match(seq: Column | str, pattern: str) -> Column:
    """Whether a whole string matches the pattern."""
    return F.upper(F.translate(_column(seq), "Uu", "Tt")).rlike(f"^{iupac_regex(pattern)}$")


def hamming(seq: Column | str, guide: str, start: Column | int = 1) -> Column:
    """Mismatches of the guide against seq from a 1-based start; written out by position, so that code is generated for it.

    Case is ignored and U is T; positions beyond the end of seq don't count.
    """
    s = F.upper(F.translate(_column(seq), "Uu", "Tt"))
    at = F.lit(start) if isinstance(start, int) else start
    return reduce(lambda a, b: a + b, [(~F.substring(s, at + i, F.lit(1)).isin(base, "")).cast("int") for i, base in enumerate(guide.upper().replace("U", "T"))])


def gc_fraction(seq: Column | str) -> Column:
    """Share of G and C among the A, C, G and T of a string; null where there are none."""
    s = F.upper(_column(seq))
    gc = F.length(F.regexp_replace(s, "[^GC]", ""))
    return F.try_divide(gc.cast("double"), F.length(F.regexp_replace(s, "[^ACGT]", "")).cast("double"))


def _slide(s: Column, start: Column, size: Column, reach: Column) -> Column:
    here, there = F.substring(s, start, reach), F.substring(s, start + size, reach)
    pairs = F.arrays_zip(F.split(here, "").alias("a"), F.split(there, "").alias("b"))
    same = F.transform(pairs, lambda p: F.coalesce((F.upper(p["a"]) == F.upper(p["b"])) & (p["b"] != ""), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("long")


def slide(seq: Column | str, start: Column, size: Column, reach: int = 1024) -> Column:
    """How far a run of `size` bases at 1-based start can move right with an equal result.

    It is the length of the longest run from start that repeats with period size, looked for in `reach` bases first
    and, where it goes on beyond them, in the whole sequence.
    """
    s = _column(seq)
    near = _slide(s, start, size, F.lit(reach))
    return F.when(near < reach, near).otherwise(_slide(s, start, size, F.length(s)))


def right_aligned_deletion(seq: Column | str, start: Column, size: Column) -> Column:
    """The last of the equivalent 1-based starts of a deletion."""
    return start + slide(seq, start, size)


def right_aligned_insertion(seq: Column | str, after: Column, bases: Column, reach: int = 1024) -> Column:
    """struct(position, bases): the last of the equivalent placements of an insertion after a 1-based position.

    Inserted bases followed by the reference repeat with their own length as far as the insertion can move.
    """
    n = F.length(bases)
    context = F.concat(bases, F.substring(_column(seq), after + 1, F.lit(reach)))
    whole = F.concat(bases, F.substring(_column(seq), after + 1, F.length(_column(seq))))
    near = _slide(context, F.lit(1), n, F.lit(reach))
    k = F.when(near < reach, near).otherwise(_slide(whole, F.lit(1), n, F.length(whole)))
    turned = F.substring(context, (k % n).cast("int") + 1, n)
    wrapped = F.concat(F.substring(bases, (k % n).cast("int") + 1, n), F.substring(bases, F.lit(1), (k % n).cast("int")))
    return F.struct((after + k).alias("position"), F.when(n > 0, wrapped).otherwise(turned).alias("bases"))


#: What a mismatch costs at each of a spacer's 20 positions, the last next to the PAM (Hsu and others, 2013).
POSITION_COST = (0.0, 0.0, 0.014, 0.0, 0.0, 0.395, 0.317, 0.0, 0.389, 0.079, 0.445, 0.508, 0.613, 0.851, 0.732, 0.828, 0.615, 0.804, 0.685, 0.583)


def site_score(guide: Column, target: Column) -> Column:
    """The published score of a site by its mismatches, 0 to 100: by position, crowding and number; null unless both have 20 letters.

    Product tables leave it out, as it hasn't been held against an accepted implementation.
    """
    at = lambda x, i: F.upper(F.substring(x, i, F.lit(1)))
    wrong = F.filter(F.sequence(F.lit(1), F.lit(20)), lambda i: at(guide, i) != at(target, i))
    n = F.size(wrong).cast("double")
    kept = F.aggregate(wrong, F.lit(1.0), lambda a, i: a * (1 - F.get(F.array(*map(F.lit, POSITION_COST)), i - 1)))
    gap = F.when(n > 1, (F.array_max(wrong) - F.array_min(wrong)) / (n - 1)).otherwise(19.0)  # neighbours' gaps add up to the span
    score = F.when(n == 0, 100.0).otherwise(100 * kept / ((19 - gap) / 19 * 4 + 1) / (n * n))
    return F.when((F.length(guide) == 20) & (F.length(target) == 20), score)
