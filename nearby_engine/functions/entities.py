"""Character references of markup as column expressions, decoded as the HTML standard says."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# A reference, a run of other text, or an ampersand that starts no reference.
PARTS = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"
# Names that count without a semicolon, also as the beginning of a longer word.
OPEN_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
LONGEST_OPEN = max(map(len, OPEN_NAMES))
MOST = 0x10FFFF


def _windows(code: int) -> str:
    """Numbers 128 to 159 mean the characters of the old Windows table, where it has any."""
    return bytes([code]).decode("cp1252", "replace").replace("�", chr(code))


REPLACED = {0: "�", 13: "\r", **{code: _windows(code) for code in range(0x80, 0xA0)}}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _table(values: dict[str, str]) -> Column:
    """One literal, however many entries it has."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _number(reference: Column) -> Column:
    """The code point of a numeric reference; one beyond the last for a number of any length."""
    digits = F.regexp_replace(F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1), "^0+(?=.)", "")
    base16 = F.conv(digits, 16, 10).try_cast("int")
    number = F.when(F.substring(reference, 3, 1).isin("x", "X"), base16).otherwise(digits.try_cast("int"))
    return F.when(F.length(digits) > 7, F.lit(MOST + 1)).otherwise(number)


def _char(code: Column) -> Column:
    """A code point as text, by way of UTF-32."""
    dropped = [code.between(1, 8), code.between(0xE, 0x1F), code.between(0x7F, 0x9F), code.between(0xFDD0, 0xFDEF), code == 0xB]
    dropped.append(code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(code.isin(list(REPLACED)), F.try_element_at(_table({str(k): v for k, v in REPLACED.items()}), code.cast("string")))
        .when(code.between(0xD800, 0xDFFF) | (code > MOST), F.lit("�"))
        .when(reduce(Column.__or__, dropped), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _named(reference: Column) -> Column:
    """A named reference; else one whose longest known beginning is decoded; else as it is."""
    name = F.substr(reference, F.lit(2))
    openings = F.sequence(F.least(F.length(name) - 1, F.lit(LONGEST_OPEN)), F.lit(2), F.lit(-1))
    beginnings = F.filter(F.transform(openings, lambda n: F.left(name, n)), lambda head: F.map_contains_key(_table(OPEN_NAMES), head))

    def begun(head: Column) -> Column:
        return F.when(head.isNotNull(), F.concat(F.try_element_at(_table(OPEN_NAMES), head), F.substr(name, F.length(head) + 1)))

    partly = F.when(F.length(name) > 2, let(F.get(beginnings, F.lit(0)), begun))
    return F.coalesce(F.try_element_at(_table(html5), name), partly, reference)


def unescape(text: Column, closed: bool = False) -> Column:
    """Every character reference decoded once; a text without an ampersand is not looked at.

    With ``closed`` only references that end in a semicolon count, as the SQL of the checks has it.
    """

    def decoded(part: Column) -> Column:
        kept = (part == "&") | ~part.startswith("&")
        return (
            F.when(kept | ~part.endswith(";") if closed else kept, part)
            .when(part.startswith("&#"), F.when(part.rlike("^&#[xX]?[0-9a-fA-F]"), let(_number(part), _char)).otherwise(part))
            .when(part == "&amp;", F.lit("&"))
            .otherwise(F.coalesce(F.try_element_at(_table(html5), F.substr(part, F.lit(2))), part) if closed else _named(part))
        )

    parts = F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(text)
