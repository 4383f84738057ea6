"""Names, excerpts, addresses, hashes and trigrams as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby_engine.functions.entities import let, unescape

# White space as text tools outside the JVM see it (the JVM class alone is ASCII).
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD_GAP = r"[^\p{L}\p{N}_]+"
TRIGRAM_GAP = r"[^\p{L}\p{N}]+"
TRIGRAM_THRESHOLD = 0.3


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(text: Column) -> Column:
    """Stripped text, null when nothing is left. The text is read once."""
    filled = SPACE.replace("[", "[^", 1)
    return F.get(F.regexp_extract_all(text, F.lit(f"(?s){filled}.*{filled}|{filled}"), F.lit(0)), F.lit(0))


def _fold_exceptions() -> dict[str, str]:
    """Characters whose full case folding is not what lower() gives."""
    return {
        chr(c): chr(c).casefold()
        for c in range(0x80, 0x1FFFF)
        if not 0xD800 <= c <= 0xDFFF and chr(c).lower().casefold() != chr(c).lower() and len(chr(c).lower()) == 1
    }


FOLDS = _fold_exceptions()
COMMON_FOLDS = ["ß", "ς"]


def casefold(text: Column) -> Column:
    """Full case folding: lower() and two replacements, character by character only for rare scripts."""
    lowered = F.lower(text)
    for char in COMMON_FOLDS:
        lowered = F.replace(lowered, F.lit(char), F.lit(char.casefold()))
    rare = {char: fold for char, fold in FOLDS.items() if char not in COMMON_FOLDS}
    # One literal instead of a node per entry keeps plans that fold case small.
    table = F.from_json(F.lit(json.dumps(FOLDS)), "map<string,string>")
    folded = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c))), ""
    )
    is_rare = F.length(F.translate(text, "".join(rare), "")) < F.length(text)
    return F.when(is_rare, folded).otherwise(lowered)


def normalized_name(name: Column) -> Column:
    """Case-folded, every run of non-word characters one space, trimmed."""
    return F.trim(F.regexp_replace(casefold(name), WORD_GAP, " "))


def unescape_entities(text: Column, closed: bool = False) -> Column:
    """HTML entities to characters; with ``closed`` only those that end in a semicolon."""
    return unescape(text, closed)


def visible_text(markup: Column, closed: bool = False) -> Column:
    """Tags to spaces, entities decoded, white space squeezed."""
    return squeeze(unescape_entities(F.regexp_replace(markup, "<[^>]+>", " "), closed))


def clean_excerpt(markup: Column, max_length: int = 300, closed: bool = False) -> Column:
    """Short plain text with an ellipsis when cut; null when nothing is left."""
    text = visible_text(markup, closed)
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(F.length(text) > max_length, F.concat(F.rtrim(F.substring(text, 1, max_length)), F.lit("...")))
        .otherwise(text)
    )


def plain_text(markup: Column, max_length: int = 500, closed: bool = False) -> Column:
    """Plain text cut at ``max_length`` without an ellipsis; empty for null."""
    return F.coalesce(F.substring(visible_text(markup, closed), 1, max_length), F.lit(""))


def title_head(title: Column) -> Column:
    """The part before the first dash, then before the first bar."""
    return strip(F.split_part(F.split_part(title, F.lit("-"), F.lit(1)), F.lit("|"), F.lit(1)))


def join_present(separator: str, *parts: Column) -> Column:
    """Join the parts that are not blank."""
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def display_address(address: Column) -> Column:
    """Readable address; blank or placeholder text gets a fixed label."""
    commas = F.regexp_replace(address, r",\s*,+", ", ")
    ends = F.regexp_replace(F.regexp_replace(commas, SPACE + "+", " "), r"^,\s*|,\s*$", "")
    placeholder = F.coalesce(strip(address), F.lit("")).isin("") | (F.lower(address) == "address registered")
    return F.when(placeholder, F.lit("Registered office location")).otherwise(strip(ends))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of every word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), TRIGRAM_GAP), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigrams_of(text: str) -> list[str]:
    """The same for one query string on the driver."""
    grams: set[str] = set()
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        grams.update(padded[i : i + 3] for i in range(len(word) + 1))
    return sorted(grams)


def _overlap(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right)).cast("double")
    either = F.size(left) + F.size(right) - shared
    return F.when(either > 0, shared / either).otherwise(F.lit(0.0))


def trigram_similarity(left: Column, right: Column | str) -> Column:
    """Shared 3-grams over all 3-grams, 0 to 1."""
    other = F.array(*[F.lit(g) for g in trigrams_of(right)]) if isinstance(right, str) else trigrams(right)
    if isinstance(right, str):
        other = other.cast("array<string>")
    return _overlap(trigrams(left), other)


def trigram_similar(text: Column, query: str, threshold: float = TRIGRAM_THRESHOLD) -> Column:
    return trigram_similarity(text, query) >= F.lit(threshold)


def contains_ignoring_case(text: Column, query: str) -> Column:
    """ILIKE with the query inside wildcards; the query's own wildcards stay active."""
    return text.ilike(f"%{query}%")


def digest(separator: str, *parts: Column) -> Column:
    """sha256 over the joined parts; a missing part counts as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def nul_digest(*parts: Column) -> Column:
    return digest("\0", *parts)


def job_hash(source: Column, job_id: Column, title: Column, url: Column) -> Column:
    """Identifies a posting; the id keeps its case."""
    low = lambda c: F.lower(strip(c))
    return digest(":", low(source), strip(job_id), low(title), low(url))


def company_hash(name: Column, domain: Column, record_id: Column) -> Column:
    low = lambda c: F.lower(strip(c))
    return digest(":", low(name), low(domain), low(record_id))


def number_text(value: Column) -> Column:
    """A coordinate as hash text: empty when missing or exactly zero."""
    return F.when(value.isNull() | (value == 0), F.lit("")).otherwise(value.cast("string"))


def page_company_hash(name: Column, domain: Column, address: Column, lat: Column, lng: Column) -> Column:
    return digest("|", F.lower(name), domain, F.lower(address), number_text(lat), number_text(lng))


def page_job_hash(company: Column, title: Column, url: Column, location: Column) -> Column:
    return digest("|", F.lower(company), F.lower(title), url, F.lower(location))


def address_hash(address: Column) -> Column:
    """White space squeezed, case kept."""
    return nul_digest(strip(F.regexp_replace(F.coalesce(address, F.lit("")), SPACE + "+", " ")))
