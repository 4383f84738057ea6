"""Page markup: scripts, links, titles and JSON-LD entities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby_engine.functions.geo import valid_pair
from nearby_engine.functions.text import (
    blank_to_null,
    squeeze,
    strip,
    unescape_entities,
)

LD_JSON = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?[^\"'>]*application/ld\+json[^>]*>(.*?)</script\s*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
ADDRESS = r"(?is)<address[^>]*>(.*?)</address\s*>"
PHONE_LINK = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'](tel:[^\"']*)"
HREF = r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"'])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
ANCHOR = r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"'])href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
LOC = r"(?is)<(?:[A-Za-z0-9_]+:)?loc\s*>\s*(.*?)\s*</(?:[A-Za-z0-9_]+:)?loc\s*>"

ENTITY_OR_TEXT = r"(?s)&#[xX][0-9a-fA-F]{1,6};?|&#[0-9]{1,7};?|&[a-z]{2,4};|[^&]+|&"
# The named entities of markup itself.
NAMED_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

# Markup of pages that need a script engine, and their visible-text limit.
SHELL_ROOT = r"(?i)<div\b[^>]*\bid=[\"'](?:root|app|__next|__nuxt)[\"'][^>]*>|<app-root\b[^>]*>"
SHELL_HINT = r"(?is)<noscript\b[^>]*>.*?(?:enable|require|javascript|js).*?</noscript>"
SHELL_TEXT_LIMIT = 200


def page_title(page: Column, closed: bool = False) -> Column:
    return unescape_entities(F.regexp_extract(page, TITLE, 1), closed)


def without_comments(page: Column) -> Column:
    return F.when(page.contains("<!--"), F.regexp_replace(page, r"(?s)<!--.*?-->", "")).otherwise(page)


def decode_entities(text: Column) -> Column:
    """Numeric entities and the five named ones of markup, each once."""
    parts = F.regexp_extract_all(text, F.lit(ENTITY_OR_TEXT), F.lit(0))

    def decoded(part: Column) -> Column:
        code = F.when(
            part.rlike("^&#[xX]"), F.conv(F.regexp_extract(part, "([0-9a-fA-F]+);?$", 1), 16, 10).try_cast("int")
        ).otherwise(F.regexp_extract(part, "([0-9]+);?$", 1).try_cast("int"))
        # A code point as UTF-32 text.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])
        return F.when(part.rlike("^&#[0-9xX]"), F.when(code.between(1, 0x10FFFF), char).otherwise(part)).otherwise(
            F.coalesce(F.try_element_at(named, part), part)
        )

    return F.when(text.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def links(page: Column) -> Column:
    """All link targets in page order, blanks dropped; comments hold none."""
    found = F.transform(
        F.regexp_extract_all(without_comments(page), F.lit(ANCHOR), F.lit(0)),
        lambda a: F.concat(*[F.regexp_extract(a, HREF, i) for i in (1, 2, 3)]),
    )
    return F.filter(F.transform(found, lambda x: strip(decode_entities(x))), lambda x: x != "")


def address_text(page: Column) -> Column:
    parts = F.regexp_extract_all(page, F.lit(ADDRESS), F.lit(1))
    return squeeze(unescape_entities(F.regexp_replace(F.array_join(parts, " "), "<[^>]+>", " ")))


def phone_link(page: Column) -> Column:
    return blank_to_null(F.replace(F.regexp_extract(page, PHONE_LINK, 1), F.lit("tel:"), F.lit("")))


def sitemap_urls(xml: Column) -> Column:
    """URLs of a sitemap; text that is not a closed sitemap document gives none."""
    closed = xml.rlike(r"(?is)</(?:[A-Za-z0-9_]+:)?(urlset|sitemapindex)\s*>\s*$")
    found = F.transform(
        F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)), lambda u: strip(F.replace(u, F.lit("&amp;"), F.lit("&")))
    )
    return F.when(closed, F.filter(found, lambda u: u != "")).otherwise(F.array().cast("array<string>"))


def is_sitemap(url: Column, body: Column) -> Column:
    return (
        F.lower(url).endswith(".xml")
        | F.lower(F.substring(body, 1, 100)).contains("<?xml")
        | F.lower(F.substring(body, 1, 200)).contains("<urlset")
    )


def shell_text(page: Column) -> Column:
    """Visible text left after scripts, styles, noscript blocks, comments and tags."""
    text = page
    for tag in ("script", "style", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return squeeze(F.regexp_replace(text, r"<[^>]+>", " "))


def needs_script_engine(page: Column) -> Column:
    """A script root or a noscript hint around almost no visible text."""
    body = strip(page)
    shell = body.rlike(SHELL_ROOT) | (body.contains("<div") & body.rlike(SHELL_HINT))
    return F.coalesce(shell & (F.length(shell_text(body)) < SHELL_TEXT_LIMIT), F.lit(False))


# --- JSON-LD -------------------------------------------------------------------------------


def node(entity: Column, at: str) -> Column:
    return F.try_variant_get(entity, at, "variant")


def text_at(entity: Column, at: str) -> Column:
    """Text only; null for numbers, objects, lists and blank strings."""
    is_text = F.schema_of_variant(node(entity, at)) == "STRING"
    return F.when(is_text, blank_to_null(F.try_variant_get(entity, at, "string")))


def scalar_at(entity: Column, at: str) -> Column:
    """Text, number or boolean as text; null when blank."""
    return blank_to_null(F.try_variant_get(entity, at, "string"))


def is_truthy(entity: Column, at: str) -> Column:
    """Present and not null, false, zero or empty."""
    shown = F.to_json(node(entity, at))
    return F.coalesce(~shown.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def first_text(entity: Column, first: str, second: str) -> Column:
    """The first of two fields that is set, if it is text that is not blank."""
    return F.when(is_truthy(entity, first), text_at(entity, first)).otherwise(text_at(entity, second))


def is_object(entity: Column, at: str) -> Column:
    return F.coalesce(F.schema_of_variant(node(entity, at)).startswith("OBJECT"), F.lit(False))


def is_list(entity: Column, at: str) -> Column:
    return F.coalesce(F.schema_of_variant(node(entity, at)).startswith("ARRAY"), F.lit(False))


def _no_entities() -> Column:
    return F.array().cast("array<variant>")


def is_typed(block: Column) -> Column:
    return node(block, '$["@type"]').isNotNull()


def children(block: Column) -> Column:
    """What a block holds one level down: the elements of a list, or of its ``@graph``."""
    graph = node(block, '$["@graph"]')
    return F.coalesce(
        F.try_variant_get(block, "$", "array<variant>"),
        F.try_variant_get(block, '$["@graph"]', "array<variant>"),
        F.when(F.schema_of_variant(graph).startswith("OBJECT"), F.array(graph)),
        _no_entities(),
    )


def ld_blocks(page: Column) -> Column:
    """Parsed JSON-LD blocks of a page in page order; malformed blocks are left out."""
    found = F.regexp_extract_all(without_comments(page), F.lit(LD_JSON), F.lit(1))
    return F.filter(F.transform(found, F.try_parse_json), lambda b: b.isNotNull())


def entity_types(entity: Column) -> Column:
    """Distinct lower-case type names without URL or prefix."""
    raw = F.coalesce(
        F.try_variant_get(entity, '$["@type"]', "array<string>"),
        F.array(F.try_variant_get(entity, '$["@type"]', "string")),
    )
    short = F.transform(raw, lambda t: F.lower(strip(F.regexp_replace(t, r"(?s)^.*[/:]", ""))))
    return F.array_distinct(F.filter(short, lambda t: t.isNotNull() & (t != "")))


def identifier(entity: Column) -> Column:
    """The ``identifier`` as text: its value, its id, or the text itself."""
    return F.when(
        is_object(entity, "$.identifier"),
        F.coalesce(scalar_at(entity, "$.identifier.value"), scalar_at(entity, '$.identifier["@id"]')),
    ).otherwise(text_at(entity, "$.identifier"))


def _address_struct(entity: Column, at: str) -> Column:
    country = F.when(
        is_object(entity, f"{at}.addressCountry"), scalar_at(entity, f"{at}.addressCountry.name")
    ).otherwise(scalar_at(entity, f"{at}.addressCountry"))
    parts = [
        scalar_at(entity, f"{at}.{part}")
        for part in ("streetAddress", "addressLocality", "addressRegion", "postalCode")
    ]
    return F.concat_ws(", ", *parts, country)


def postal_address(entity: Column, at: str = "$.address") -> Column:
    """Text, a five-part struct, or a list of either joined by semicolons; empty otherwise."""
    items = F.try_variant_get(entity, at, "array<variant>")
    each = F.transform(
        items,
        lambda v: F.when(is_object(v, "$"), _address_struct(v, "$")).otherwise(F.coalesce(text_at(v, "$"), F.lit(""))),
    )
    return (
        F.when(is_object(entity, at), _address_struct(entity, at))
        .when(is_list(entity, at), F.array_join(F.filter(each, lambda a: a != ""), "; "))
        .otherwise(F.coalesce(text_at(entity, at), F.lit("")))
    )


def raw_point(entity: Column, at: str = "$") -> Column:
    """Struct (lat, lng) as found in ``geo``, or in the entity itself without one."""

    def read(place: str) -> Column:
        return F.struct(
            F.try_variant_get(entity, f"{place}.latitude", "double").alias("lat"),
            F.try_variant_get(entity, f"{place}.longitude", "double").alias("lng"),
        )

    return F.when(is_object(entity, f"{at}.geo"), read(f"{at}.geo")).otherwise(read(at))


def valid_point(point: Column) -> Column:
    """The point, or null unless both numbers are present and in range."""
    return F.when(valid_pair(point["lat"], point["lng"]), point)
