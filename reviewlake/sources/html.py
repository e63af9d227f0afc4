"""Fields out of stored HTML pages: S8, S9.

Flat elements are read with regular expressions in the JVM: a field is an ordered list of
patterns and a default. Elements that may hold other elements, as those of review cards do,
are read as a tree in Python, a page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions.text import strip
from reviewlake.lexicons import CARD_PLACEHOLDERS
from reviewlake.schemas import BRONZE_REVIEWS, conform
from reviewlake.session import ship_package

_TAG = r"<[^>]*>"
_BLOCKS = {"address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
           "header", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"}
_UNSEEN = {"script", "style", "head", "template", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}


@dataclass(frozen=True)
class Field:
    """``patterns`` in order of preference; group 1 is the value, tags are removed."""

    name: str
    patterns: tuple[str, ...]
    default: str | None = None


def by_attribute(attribute: str, value: str, tag: str = r"\w+") -> str:
    """Inner HTML of the first element with this attribute value (no nested twin)."""
    return rf'(?s)<{tag}\b[^>]*\b{attribute}="{value}"[^>]*>(.*?)</'


def attribute_of(tag: str, attribute: str, where: str = "") -> str:
    """An attribute's value on the first such tag whose text contains ``where``."""
    return rf'<{tag}\b(?=[^>]*{where})[^>]*\b{attribute}="([^"]*)"'


def first_match(html: Column, patterns: Sequence[str], default: str | None = None) -> Column:
    """The first pattern with a non-empty value wins, else the default."""
    found = [
        F.nullif(strip(F.regexp_replace(F.regexp_extract(html, p, 1), _TAG, "")), F.lit(""))
        for p in patterns
    ]
    return F.coalesce(*found, F.lit(default))


def extract_fields(df: DataFrame, html: str, fields: Sequence[Field]) -> DataFrame:
    """S8 on a whole page: one column per field beside the existing ones."""
    return df.select(
        *df.columns, *[first_match(F.col(html), f.patterns, f.default).alias(f.name) for f in fields]
    )


def extract_cards(
    df: DataFrame, html: str, card: str, fields: Sequence[Field], keep: Sequence[str]
) -> DataFrame:
    """One row per match of ``card`` (group 0), with its position and fields.

    A page explodes into its own cards, so a page with very many cards stays a
    stream of rows on its task.
    """
    cards = df.select(
        *keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(card), 0)).alias("card_no", "_card")
    )
    return cards.select(
        *keep,
        "card_no",
        *[first_match(F.col("_card"), f.patterns, f.default).alias(f.name) for f in fields],
    )


class _Node:
    """An element: its attributes and, in order, its texts and inner elements."""

    __slots__ = ("tag", "attributes", "parts")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.parts = tag, attributes, []

    def all(self) -> Iterator[_Node]:
        """The elements inside, in document order."""
        waiting = [p for p in reversed(self.parts) if isinstance(p, _Node)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [p for p in reversed(node.parts) if isinstance(p, _Node)]

    def text(self) -> str:
        """All text inside as a reader sees it: one line per block, single blanks."""
        out: list[str] = []
        waiting: list[_Node | str] = [self]
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag == "br":
                out.append("\n")
            elif part.tag not in _UNSEEN:
                edge = ["\n"] if part.tag in _BLOCKS else []
                waiting += [*edge, *reversed([_flat(p) for p in part.parts]), *edge]
        lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line)

    def written(self) -> str:
        """All text inside as it stands in the source."""
        out: list[str] = []
        waiting: list[_Node | str] = [self]
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                waiting += reversed(part.parts)
        return "".join(out)


def _flat(part: _Node | str) -> _Node | str:
    """Line ends of the source are blanks."""
    return " ".join(part.split("\n")) if isinstance(part, str) else part


class _Reader(HTMLParser):
    """A page as a tree. Entities are decoded, either quote is read, and an end tag closes
    what is open inside its element."""

    def __init__(self) -> None:
        super().__init__()
        self.open = [_Node("", {})]

    def handle_starttag(self, tag, attrs):
        # A paragraph ends where a block begins, and a list item where the next one does.
        if self.open[-1].tag == "p" and tag in _BLOCKS or self.open[-1].tag == "li" == tag:
            self.open.pop()
        node = _Node(tag, {name: value or "" for name, value in reversed(attrs)})
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def read_page(html: str | None) -> _Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.open[0]


@dataclass(frozen=True)
class Pick:
    """The first element with this tag whose attribute equals or contains ``value``.

    ``take`` names the attribute that is the value; without it the whole text is.
    """

    tag: str
    attribute: str = ""
    value: str = ""
    contains: bool = False
    take: str = ""
    inside: tuple[str, str, str] | None = None

    def matches(self, node: _Node) -> bool:
        if node.tag != self.tag:
            return False
        if not self.attribute:
            return True
        found = node.attributes.get(self.attribute, "")
        return self.value in found if self.contains else found == self.value

    def of(self, node: _Node) -> str | None:
        """The value, ``""`` for an empty element, None if there is no element."""
        scopes = [node]
        if self.inside:
            tag, attribute, value = self.inside
            scopes = [n for n in node.all() if n.tag == tag and n.attributes.get(attribute) == value]
        for scope in scopes:
            for inner in scope.all():
                if self.matches(inner):
                    return inner.attributes.get(self.take, "").strip() if self.take else inner.text()
        return None


@dataclass(frozen=True)
class Picked:
    """A field: its picks in order of preference, and the text stored when there is none.

    ``fill_empty`` passes over elements without text as well.
    """

    name: str
    picks: tuple[Pick, ...]
    default: str
    fill_empty: bool = False

    def of(self, node: _Node) -> str:
        for pick in self.picks:
            value = pick.of(node)
            if value or (value is not None and not self.fill_empty):
                return value
        return self.default


# The element marks of a page of review cards.
REVIEW_CARD = Pick("div", "data-testid", "review-card")
PAGE_FIELDS = [
    Picked("city", (Pick("a", "class", "bui_breadcrumb__link_masked"),
                    Pick("a", "class", "breadcrumb", contains=True, inside=("nav", "aria-label", "Breadcrumb"))),
           CARD_PLACEHOLDERS["city"]),
]
CARD_FIELDS = [
    Picked("reviewer_name", (Pick("div", "class", "b08850ce41 f546354b44"),), CARD_PLACEHOLDERS["reviewer_name"]),
    Picked("reviewer_nationality", (Pick("img", "class", "b8d1620349", contains=True, take="alt"), Pick("img", take="alt"),
                                    Pick("span", "class", "nationality", contains=True)),
           CARD_PLACEHOLDERS["reviewer_nationality"], fill_empty=True),
    Picked("duration", (Pick("span", "data-testid", "review-num-nights"),), CARD_PLACEHOLDERS["duration"]),
    Picked("check_in_date", (Pick("span", "data-testid", "review-stay-date"),), CARD_PLACEHOLDERS["check_in_date"]),
    Picked("travel_type", (Pick("span", "data-testid", "review-traveler-type"),), CARD_PLACEHOLDERS["travel_type"]),
    Picked("room_type", (Pick("span", "data-testid", "review-room-name"),), CARD_PLACEHOLDERS["room_type"]),
    Picked("review_date", (Pick("span", "data-testid", "review-date"),), CARD_PLACEHOLDERS["review_date"]),
    Picked("positive_review", (Pick("div", "class", "b99b6ef58f d14152e7c3"),), CARD_PLACEHOLDERS["positive_review"]),
    Picked("negative_review", (Pick("div", "data-testid", "review-negative-text"),), CARD_PLACEHOLDERS["negative_review"]),
]


def read_cards(
    df: DataFrame, html: str, keep: Sequence[str], card: Pick, fields: Sequence[Picked], page: Sequence[Picked] = ()
) -> DataFrame:
    """S8 with nested elements: one row per card of a page, read in one pass.

    Returns ``keep``, ``card_no`` and the ``page`` and card fields, whole texts each. A page is
    read as a tree on the task that holds it; a NULL page has no cards.
    """
    ship_package(df.sparkSession)
    types = {c: df.schema[c].dataType.simpleString() for c in keep}
    names = [f.name for f in (*page, *fields)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "card_no int", *(f"`{n}` string" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, numbers, rows = [], [], []
            for owner, source in enumerate(batch.column(len(keep)).to_pylist()):
                tree = read_page(source)
                whole = [f.of(tree) for f in page]
                for number, node in enumerate(n for n in tree.all() if card.matches(n)):
                    owners.append(owner)
                    numbers.append(number)
                    rows.append([*whole, *(f.of(node) for f in fields)])
            kept = [batch.column(k).take(pa.array(owners, pa.int64())) for k in range(len(keep))]
            values = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))]
            columns = [*kept, pa.array(numbers, pa.int32()), *values]
            yield pa.record_batch(columns, names=[*keep, "card_no", *names])

    return df.select(*keep, html).mapInArrow(run, schema)


def review_cards(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """The reviews of each page and its city, placeholders where a field is missing."""
    return read_cards(df, html, keep, REVIEW_CARD, CARD_FIELDS, PAGE_FIELDS)


def cards_to_bronze(pages: DataFrame, key: str, html: str, hotel_name: str, scraped_at: Column | None = None) -> DataFrame:
    """Bronze reviews from pages with their hotel's name; ``id`` is made of page and card."""
    named = pages.select(F.col(key).alias("_page"), F.col(hotel_name).alias("hotel_name"), F.col(html).alias("_html"))
    cards = review_cards(named, "_html", ["_page", "hotel_name"])
    stamped = cards.withColumns(
        {"id": F.xxhash64("_page", "card_no"), "scraped_at": F.current_timestamp() if scraped_at is None else scraped_at}
    )
    return conform(stamped, BRONZE_REVIEWS)


def nested_text(df: DataFrame, key: str, html: str, attribute: str, value: str, name: str) -> DataFrame:
    """(key, ``name``): text of the first element with the attribute, nested elements included,
    white space as in the source."""
    ship_package(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source in batch.column(1).to_pylist():
                found = next((n for n in read_page(source).all() if n.attributes.get(attribute) == value), None)
                texts.append((found.written().strip() or None) if found else None)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, name])

    return df.select(key, html).mapInArrow(read, f"`{key}` {key_type}, `{name}` string")
