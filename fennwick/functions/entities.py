"""Character references of HTML as column expressions: names, with or without their semicolon, and numbers."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from fennwick.functions.text import let, quoted

#: A reference after its ampersand: decimal, hexadecimal or a name of at most 32 characters.
DECIMAL, HEXADECIMAL, NAME = r"^#([0-9]+);?", r"^#[xX]([0-9a-fA-F]+);?", r"^([^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "�"


@lru_cache(maxsize=2)
def _names(closed: bool) -> str:
    """SQL for the map of the names that end with a semicolon, or of those that need none."""
    return "map(" + ", ".join(quoted(pair) for pair in sorted(html5.items()) if pair[0].endswith(";") == closed) + ")"


@lru_cache(maxsize=1)
def _longest_open() -> int:
    return max(len(name) for name in html5 if not name.endswith(";"))


def _controls() -> dict[int, str]:
    """What the numbers 128 to 159 stand for: Windows' characters where it has one."""
    return {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: REPLACEMENT, 0x0D: "\r"}


def character(number: Column) -> Column:
    """The character of a number, by HTML's rules for those that have none. Null for null."""
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    known = F.create_map(*[F.lit(x) for pair in _controls().items() for x in pair])[number.cast("int")]
    none = number.between(1, 8) | number.between(0x0E, 0x1F) | number.isin(0x0B, 0x7F) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    out_of_range = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return F.when(out_of_range, REPLACEMENT).when(known.isNotNull(), known).when(none, "").otherwise(plain)


def unescape(text: Column) -> Column:
    """``text`` with its character references decoded: the longest name that fits counts, what is none stays. Null stays null."""

    def one(piece: Column) -> Column:
        """The text after an ampersand, decoded."""
        digits, hexes = F.regexp_extract(piece, DECIMAL, 1), F.regexp_extract(piece, HEXADECIMAL, 1)
        # Numbers of more digits than any character has are out of range, whatever they are.
        small = lambda d, n: F.regexp_replace(d, "^0+(?=.)", "").substr(1, n)
        number = F.when(digits != "", small(digits, 9).cast("long")).when(hexes != "", F.conv(small(hexes, 8), 16, 10).cast("long"))
        told = F.when(digits != "", F.regexp_extract(piece, DECIMAL, 0)).otherwise(F.regexp_extract(piece, HEXADECIMAL, 0))
        return let(F.struct(number.alias("n"), told.alias("t"), F.regexp_extract(piece, NAME, 1).alias("w")), lambda r: F.when(r["n"].isNotNull(), F.concat(character(r["n"]), piece.substr(F.length(r["t"]) + 1, F.length(piece)))).otherwise(named(piece, r["w"])))

    def named(piece: Column, word: Column) -> Column:
        closed, opened = F.expr(_names(True)), F.expr(_names(False))
        fits = F.filter(F.sequence(F.least(F.length(word), F.lit(_longest_open())), F.lit(2), F.lit(-1)), lambda i: opened[word.substr(F.lit(1), i)].isNotNull())
        found = F.when(F.length(word) >= 2, F.get(fits, F.lit(0)))
        rest = lambda n: piece.substr(n + 1, F.length(piece))
        short = let(F.struct(found.alias("i")), lambda r: F.when(r["i"].isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(opened[word.substr(F.lit(1), r["i"])], rest(r["i"]))))
        whole = F.when(word.endswith(";"), closed[word])
        return let(F.struct(whole.alias("x")), lambda r: F.when(r["x"].isNotNull(), F.concat(r["x"], rest(F.length(word)))).otherwise(short))

    pieces = F.split(text, "&")
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)
