"""The registered queries: name, Spark plan, and the equivalent SQL of the check engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Plan
    sql: str | None


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Add a query; without SQL only its rows can be checked."""

    def add(plan: Plan) -> Plan:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(name, plan, sql)
        return plan

    return add


# --- SQL fragments shared by the checks ------------------------------------------------------

SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_distance(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Haversine by the arcsine form."""
    h = (
        f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians(({lng2}) - ({lng1})) / 2), 2))"
    )
    return f"(2 * 6371000.0e0 * asin(sqrt(least(1.0e0, {h}))))"


def sql_squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACES}+', ' ', 'g'))"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def sql_unescape(text: str) -> str:
    """The entities that occur in the tables."""
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def sql_visible(text: str) -> str:
    return sql_squeeze(sql_unescape(f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"))


def sql_normalized(text: str) -> str:
    return rf"trim(regexp_replace(replace(replace(lower({text}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_trigrams(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    grams = "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))"
    return f"list_distinct(flatten(list_transform({words}, {grams})))"


def sql_similarity(left: str, right: str) -> str:
    a, b = sql_trigrams(left), sql_trigrams(right)
    both = f"len(list_intersect({a}, {b}))"
    return f"(CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}))"


URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def sql_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{URL}', {group})"


def sql_host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({sql_part(url, 2)}, '^.*@', ''), ':[0-9]*$', ''))"


def sql_domain(url: str) -> str:
    return f"regexp_replace({sql_host(url)}, '^www\\.', '')"


def sql_iso(instant: str) -> str:
    return f"strftime({instant}, '%Y-%m-%dT%H:%M:%SZ')"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
