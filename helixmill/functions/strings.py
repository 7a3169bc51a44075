"""Column functions over sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes of the DNA alphabet are the places of its characters, the endmarker first.
ALPHABET = "$ACGTN"


def encode(c: Column) -> Column:
    """Code of a character; raises for a character outside the alphabet."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when((at > 0) & (F.length(c) == 1), at - 1).otherwise(F.raise_error(F.concat(F.lit("not in the alphabet: "), c)))


def decode(code: Column) -> Column:
    return F.substring(F.lit(ALPHABET), code + 1, F.lit(1))


def dna(text: Column) -> Column:
    """A text as DNA, character by character: A, C, G, T and N in upper case, and N for every other character, so that places stay."""
    return F.regexp_replace(F.translate(text, "acgtn", "ACGTN"), "(?s)[^ACGTN]", "N")


def only_dna(text: Column) -> Column:
    """A text of A, C, G, T and N as it is; raises for one with another character."""
    return F.when(text.rlike("^[ACGTN]*$"), text).otherwise(F.raise_error(F.concat(F.lit("not of the letters ACGTN: "), F.substring(text, 1, 40))))


def bit_width(x: Column) -> Column:
    """Bits that an integer of 0 or more takes; 1 for 0."""
    return F.length(F.bin(x)).cast("int")


def point(interval: Column, offset: Column) -> Column:
    """A place in an interval map. Structs of it are equal and in order as the places are: by interval, then offset."""
    return F.struct(interval.alias("interval"), offset.alias("offset"))


def characters(text: Column) -> Column:
    """The characters of a text, in order; none of an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def order_key(s: Column) -> Column:
    """What suffixes of DNA sort by: N comes behind T."""
    return F.translate(s, "N", "Z")


def common_prefix(a: Column, b: Column, longest: int) -> Column:
    """Length of the longest common prefix of two strings of up to longest characters, by doubling steps."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, longest.bit_length())))))
    least = F.least(F.length(a), F.length(b))

    def step(n: Column, p: Column) -> Column:
        return F.when((n + p <= least) & (F.substring(a, n + 1, p) == F.substring(b, n + 1, p)), n + p).otherwise(n)

    return F.aggregate(steps, F.lit(0), step).cast("long")
