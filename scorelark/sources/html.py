"""Table functions over HTML columns (SRC5, SRC6, SRC14).

Each is registered under its name and used with LATERAL:

    SELECT p.url, l.* FROM pages p, LATERAL html_links(p.html, p.url) l
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import urljoin, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..session import computed
from .dom import Node, parse

_SKIPPED = ("mailto:", "tel:", "javascript:", "#")
#: Header labels of the calendar's table.
CALENDAR_HEADERS = {"date": ["date"], "name": ["event name", "event"], "location": ["event location", "location"], "country": ["country"]}
#: A path from a site's root without steps up, empty steps, parameters or a query.
_PATH = re.compile(r"(?:/[A-Za-z0-9_~-][A-Za-z0-9_.~-]*)+/?")


@lru_cache(maxsize=1024)
def _site(base: str) -> str | None:
    at = urlparse(base)
    return f"{at.scheme}://{at.netloc}" if at.scheme in ("http", "https") and at.netloc else None


def absolute(base: str, href: str) -> str:
    """``urljoin``; plain paths, which most links are, need no parsing."""
    if _PATH.fullmatch(href):
        site = _site(base)
        if site is not None:
            return site + href
    return urljoin(base, href)


class HtmlRows:
    """table_no, row_no, cells (text), links (first link of each cell), images, classes, header."""

    def eval(self, html: str):
        for t, table in enumerate(parse(html, shared=True).all("table")):
            rows = [r for r in table.all("tr") if r.up("table") is table]
            for r, row in enumerate(rows):
                cells = row.own("td", "th")
                link = [c.first("a") for c in cells]
                image = [c.first("img") for c in cells]
                yield t, r, [c.text() for c in cells], [a.attrs.get("href") if a else None for a in link], [a.text() if a else None for a in link], [i.attrs.get("src") if i else None for i in image], row.attrs.get("class", "").lower(), bool(cells) and all(c.tag == "th" for c in cells)


class CalendarRows(HtmlRows):
    """row_no and raw cells of the rows below the calendar's header in its table; what a ragged row hasn't got is null."""

    def eval(self, html: str):
        table = at = None
        for t, r, cells, hrefs, link_texts, images, classes, header in super().eval(html):
            if table is None:
                lower = [c.lower() for c in cells]
                at = {k: next((lower.index(label) for label in labels if label in lower), len(cells)) for k, labels in CALENDAR_HEADERS.items()}
                if at["date"] < len(cells) and at["name"] < len(cells):
                    # what the header hasn't got is in no row
                    table, at = t, {k: i if i < len(cells) else None for k, i in at.items()}
            elif t != table:
                return
            elif not header:
                get = lambda values, k: values[at[k]] if at[k] is not None and at[k] < len(values) else None
                yield r, get(cells, "date"), get(cells, "name"), get(link_texts, "name"), get(hrefs, "name"), get(cells, "location"), get(hrefs, "country"), get(images, "country"), get(cells, "country"), classes


class HtmlLinks:
    """ord, text, href (absolute) of the links that lead to a page."""

    def eval(self, html: str, base: str):
        n = 0
        for a in parse(html, shared=True).all("a"):
            href = (a.attrs.get("href") or "").strip()
            if "href" not in a.attrs or href.startswith(_SKIPPED):
                continue
            yield n, a.text(), absolute(base or "", href)
            n += 1


class HtmlOutline:
    """ord, kind (text or link), text, href of everything in document order."""

    def eval(self, html: str, base: str):
        n = 0
        for node in parse(html, shared=True).walk():
            if isinstance(node, Node):
                if node.tag == "a" and node.attrs.get("href"):
                    yield n, "link", node.text(), absolute(base or "", node.attrs["href"])
                    n += 1
            elif node.strip():
                yield n, "text", " ".join(node.split()), None
                n += 1


_TABLE_FUNCTIONS = {
    "html_rows": (HtmlRows, "table_no int, row_no int, cells array<string>, hrefs array<string>, link_texts array<string>, images array<string>, classes string, header boolean"),
    "calendar_rows": (CalendarRows, "row_index int, date_raw string, name_cell string, link_text string, href string, location_raw string, flag_href string, flag_image string, flag_text string, classes string"),
    "html_links": (HtmlLinks, "ord int, text string, href string"),
    "html_outline": (HtmlOutline, "ord int, kind string, text string, href string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    from . import sheets

    for name, (handler, schema) in (_TABLE_FUNCTIONS | sheets.TABLE_FUNCTIONS).items():
        spark.udtf.register(name, udtf(handler, returnType=schema))


#: Rows that leave a table function together.
_ROWS = 8192


def _column(values: list, kind):
    """An Arrow column; a number that its type can't hold is null."""
    import pyarrow as pa

    if pa.types.is_map(kind):
        values = [v if v is None else list(v.items()) for v in values]
    try:
        return pa.array(values, kind)
    except (OverflowError, pa.ArrowInvalid):
        if not pa.types.is_integer(kind):
            raise
        top = 1 << kind.bit_width - 1
        return pa.array([v if v is not None and -top <= v < top else None for v in values], kind)


def _table_rows(handler, n_kept: int, schema):
    """What a task does: rows of a handler for each row of Arrow batches, with the columns that are kept beside them."""

    def run(batches):
        import pyarrow as pa

        read = handler().eval
        for batch in batches:
            kept, given = batch.columns[:n_kept], zip(*(c.to_pylist() for c in batch.columns[n_kept:]), strict=True)
            at, rows = [], []

            def out(kept=kept):
                columns = [_column(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[n_kept:], strict=True)]
                index = pa.array(at, pa.int32())
                return pa.RecordBatch.from_arrays([*(c.take(index).cast(f.type) for c, f in zip(kept, schema, strict=False)), *columns], schema=schema)

            for i, row in enumerate(given):
                for found in read(*row):
                    at.append(i)
                    rows.append(found)
                    if len(rows) == _ROWS:
                        yield out()
                        at, rows = [], []
            if rows:
                yield out()

    return run


def lateral(df: DataFrame, function: str, *args: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` joined to the rows that a table function makes of each of its rows.

    The same as LATERAL with the registered function, but rows travel in Arrow batches: a row at a time costs more than reading its page.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from . import sheets

    handler, made = (_TABLE_FUNCTIONS | sheets.TABLE_FUNCTIONS)[function]
    rows = df.select(*(F.col(c) for c in (keep if keep is not None else df.columns)), *(F.col(a).alias(f"_{i}") for i, a in enumerate(args)))
    kept = len(rows.columns) - len(args)
    schema = StructType(rows.schema.fields[:kept] + StructType.fromDDL(made).fields)
    return rows.mapInArrow(_table_rows(handler, kept, to_arrow_schema(schema)), schema)


STATUS = r"(?i)\b(registry|trial)\s+event\b"


def calendar_cells(pages: DataFrame, key: str = "run_id") -> DataFrame:
    """SRC5: raw cells of the calendar: the first table with the headers Date and Event (Name), ragged rows filled with nulls.

    ``pages`` has ``key`` and html; one row per table row below the header.  A page without such a table has no row.
    """
    return lateral(pages, "calendar_rows", "html", keep=[key])


def year_index(pages: DataFrame) -> DataFrame:
    """SRC6: provider 1's events of a year with their result links.

    A text "Month day - day, year - Name" names the event of the links after it (W10: the last header is carried
    forward).  The first header of a slug wins, and a link counts once (W8).
    """
    from pyspark.sql import Window as W

    from ..functions.text import PROVIDER_1_SHEET

    header = r"^\s*([A-Z][a-z]{2,8}\.?\s+\d{1,2}(?:\s*[-–]\s*(?:[A-Z][a-z]{2,8}\.?\s+)?\d{1,2})?,?\s+\d{4})\s*[-–—]\s*(.+?)\s*$"
    items = lateral(pages, "html_outline", "html", "url", keep=["url"])
    heads = F.when((F.col("kind") == "text") & F.col("text").rlike(header), F.struct(F.regexp_extract("text", header, 1).alias("date_raw"), F.regexp_extract("text", header, 2).alias("name")))
    slug = F.when(F.col("kind") == "link", F.regexp_extract(F.try_parse_url("href", F.lit("PATH")), PROVIDER_1_SHEET, 1))
    items = computed(items.select("url", "ord", "text", "href", heads.alias("head"), F.nullif(slug, F.lit("")).alias("slug")), "head", "slug").where("head IS NOT NULL OR slug IS NOT NULL")
    links = items.withColumn("head", F.last("head", ignorenulls=True).over(W.partitionBy("url").orderBy("ord"))).where("slug IS NOT NULL AND head IS NOT NULL")
    once = links.groupBy("url", "slug", "text", "href").agg(F.min_by("head", "ord").alias("head"), F.min("ord").alias("ord"))
    listed = once.groupBy("url", "slug").agg(F.min_by("head", "ord").alias("head"), F.array_sort(F.collect_list(F.struct("ord", F.col("text").alias("title"), F.col("href").alias("url")))).alias("links"))
    return listed.select("url", F.col("slug").alias("provider_key"), "head.name", "head.date_raw", F.transform("links", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("links"))


def host(url: str) -> str:
    """Host of an address without www."""
    return urlparse(url).netloc.lower().removeprefix("www.")




def calendar_events(cells: DataFrame, key: str = "run_id") -> DataFrame:
    """Parsed calendar rows; ``error`` tells why a row is no event, and such rows are kept apart by it."""
    from ..functions import dates, places, text

    name = F.coalesce(F.nullif("link_text", F.lit("")), F.trim(F.regexp_replace("name_cell", STATUS, "")))
    flag = text.flag_code(F.col("flag_href"), F.col("flag_image"), F.col("flag_text"))
    d = cells.withColumns({"name": name, "flag": flag, "range": dates.parse_date_range(F.col("date_raw")), "loc": places.parse_location(F.col("location_raw"))})
    d = computed(d, "name", "range")
    d = d.withColumn("split", text.split_event_name(F.col("name"))).withColumn("land", places.country_of(F.col("loc.country_code"), F.col("flag")))
    error = F.when(F.coalesce("name", F.lit("")) == "", "empty event name").when(F.col("range").isNull(), F.concat(F.lit("unrecognized date "), F.coalesce("date_raw", F.lit(""))))
    hint = F.when(F.contains(F.coalesce("classes", F.lit("")), F.lit("unconfirmed")) | F.contains(F.lower("name_cell"), F.lit("unconfirmed")), True)
    return d.select(
        key, "row_index", "name", text.normalize_event_name(F.col("name")).alias("normalized_name"), F.col("split.canonical").alias("canonical_name"), F.col("split.aliases").alias("aliases"),
        F.coalesce(F.lower(F.nullif(F.regexp_extract("name_cell", STATUS, 1), F.lit(""))), F.lit("unknown")).alias("event_status"), text.detect_hiatus(F.col("name")).alias("hiatus"),
        F.col("range.start").alias("start_date"), F.col("range.end").alias("end_date"), "location_raw", "loc.city", "loc.region", F.col("land.country").alias("country"), F.nullif("flag", F.lit("")).alias("country_raw"),
        text.clean_url(F.col("href")).alias("website_url"), hint.alias("unconfirmed_hint"), F.col("land.warning").alias("warning"), error.alias("error"),
    )
