"""Directory list and detail pages to company evidence.

Selectors are tag, class, id and attribute tests with descendant steps, and end in ``::text`` or
``::attr(name)``. Pages are read in Arrow batches, one page at a time, so a task holds one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby_engine.functions.text import page_company_hash, strip
from nearby_engine.functions.urls import bare_domain, fill_template, resolve
from nearby_engine.operators.ranking import keep_first

DEFAULT_CARD = ".directory-card"
CARD_FIELDS = ["name", "source_record_id", "address", "phone", "website", "detail_url"]
DETAIL_FIELDS = ["address", "phone", "website", "lat", "lng", "description"]
CARDS_A_FRAME = 4096
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
STEP = re.compile(r"([.#]?)([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: "_Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[_Node | str] = []

    def walk(self) -> Iterator["_Node"]:
        stack: list[_Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))


class _Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def _fits(node: _Node, step: str) -> bool:
    for mark, word, attr, value in STEP.findall(step):
        if attr:
            held = node.attrs.get(attr)
            if held is None or (value and held != value):
                return False
        elif mark == ".":
            if word not in node.attrs.get("class", "").split():
                return False
        elif mark == "#":
            if node.attrs.get("id") != word:
                return False
        elif node.tag != word.lower():
            return False
    return True


def _select(scope: _Node, selector: str) -> list[_Node]:
    """Nodes under ``scope`` that fit; steps apart by blanks mean any ancestor inside the page."""
    *above, last = selector.split()
    found = []
    for node in scope.walk():
        if node is scope and node.tag == "":
            continue
        if not _fits(node, last):
            continue
        ancestor, wanted = node.parent, list(above)
        while ancestor is not None and wanted:
            if _fits(ancestor, wanted[-1]) and ancestor.tag:
                wanted.pop()
            ancestor = ancestor.parent
        if not wanted:
            found.append(node)
    return found


def _value(scope: _Node, selector: str | None) -> str | None:
    """First text or attribute the selector gives, stripped; null when blank or absent."""
    if not selector:
        return None
    path = selector.strip().removeprefix("css:").strip()
    path, _, pick = path.partition("::")
    nodes = _select(scope, path) if path else [scope]
    if pick == "text":
        texts = (c for n in nodes for c in n.children if isinstance(c, str))
        value = next(texts, None)
    elif pick.startswith("attr("):
        name = pick[5:-1].strip()
        value = next((n.attrs[name] for n in nodes if name in n.attrs), None)
    else:
        return None
    return (value or "").strip() or None


def _card_rows(card: str, fields: dict[str, str]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["directory_id", "page", "url", "position", *CARD_FIELDS]
        for batch in batches:
            rows: list[tuple] = []
            for directory, page, url, body in zip(batch.directory_id, batch.page, batch.url, batch.html):
                cards = _select(_Tree(body or "").root, card)
                rows += [
                    (directory, page, url, i, *[_value(c, fields.get(f)) for f in CARD_FIELDS])
                    for i, c in enumerate(cards)
                ]
                # A frame costs more than a page: cards of many pages go into one.
                if len(rows) >= CARDS_A_FRAME:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return read


def _detail_rows(fields: dict[str, str]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, body in zip(batch.url, batch.html):
                root = _Tree(body or "").root
                out.append((url, *[_value(root, fields.get(f)) for f in DETAIL_FIELDS]))
            yield pd.DataFrame(out, columns=["url", *DETAIL_FIELDS])

    return read


def _text_schema(*named: tuple[str, T.DataType], fields: list[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(n, k) for n, k in named] + [T.StructField(f, T.StringType()) for f in fields]
    )


def page_cards(
    pages: DataFrame, selectors: dict[str, str], start_page: int = 1
) -> DataFrame:
    """Cards of all landed list pages from the first on."""
    wanted = pages.filter(F.col("page") >= start_page).select(
        "directory_id", F.col("page").cast("int").alias("page"), "url", "html"
    )
    schema = _text_schema(
        ("directory_id", T.StringType()), ("page", T.IntegerType()), ("url", T.StringType()),
        ("position", T.IntegerType()), fields=CARD_FIELDS,
    )
    return wanted.mapInPandas(_card_rows(selectors.get("card", DEFAULT_CARD), selectors), schema)


def directory_companies(
    cards: DataFrame, details: DataFrame | None = None, detail_selectors: dict[str, str] | None = None
) -> DataFrame:
    """Company evidence of named cards; a landed detail page overrides what it has.

    ``details`` has (url, html).
    """
    named = cards.filter(F.col("name").isNotNull()).withColumn(
        "detail", F.when(F.col("detail_url").isNotNull(), resolve(F.col("detail_url"), F.col("url")))
    )
    if details is None or not detail_selectors:
        empty = F.lit(None).cast("string")
        joined = named.select("*", *[empty.alias(f"d_{f}") for f in DETAIL_FIELDS])
    else:
        read = details.select("url", "html").mapInPandas(
            _detail_rows(detail_selectors), _text_schema(("url", T.StringType()), fields=DETAIL_FIELDS)
        )
        read = read.select(F.col("url").alias("detail"), *[F.col(f).alias(f"d_{f}") for f in DETAIL_FIELDS])
        joined = named.join(read, "detail", "left")

    def bounded(name: str, limit: float) -> Column:
        number = F.col(name).try_cast("double")
        return F.when(number.between(-limit, limit), number)

    website = F.coalesce("d_website", "website")
    rows = joined.select(
        "directory_id", F.concat_ws("#", "directory_id", F.col("page").cast("string")).alias("page"),
        F.struct(F.col("page").alias("page"), "position").alias("arrival"), "name", "source_record_id",
        F.coalesce("detail", "url").alias("evidence_url"), bare_domain(website).alias("domain"),
        F.coalesce("d_address", "address", F.lit("")).alias("address"),
        bounded("d_lat", 90.0).alias("lat"), bounded("d_lng", 180.0).alias("lng"),
        F.coalesce("d_phone", "phone").alias("phone"),
        F.to_json(F.struct("directory_id", F.col("d_description").alias("description"))).alias("metadata"),
    ).withColumn(
        "content_hash",
        page_company_hash(F.col("name"), F.col("domain"), F.col("address"), F.col("lat"), F.col("lng")),
    )
    return keep_first(rows, ["directory_id", "content_hash"], ["arrival"]).drop("arrival", "directory_id")


def page_requests(
    runs: DataFrame, template: str, pages: int, start_page: int = 1
) -> DataFrame:
    """The URLs of the first ``pages`` list pages to land for every run: (id, page, url)."""
    paged = runs.select("*", F.explode(F.sequence(F.lit(start_page), F.lit(start_page + pages - 1))).alias("page"))
    values = {
        "lat": F.col("lat"), "lng": F.col("lng"), "radius": F.col("radius_km"),
        "radius_km": F.col("radius_km"), "page": F.col("page"),
    }
    return paged.select("id", "page", fill_template(F.lit(template), values).alias("url"))
