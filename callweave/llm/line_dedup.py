"""Line dedup by site-relative frequency.

For each site (host), the share of its pages that contain a line; lines above the boilerplate ratio are dropped from all pages
of that site.  A line counts once per page, is compared without surrounding blanks, and must stand on a few pages at least, so
that sites with one or two pages keep their text.

Only 64-bit line hashes travel; each row is counted and marked through its own key, so a busy site or line is summed before the
shuffle and no task holds a site.  Pages without a flagged line keep their text byte for byte.

``copies`` (key, page), with ``row_key`` as key, names the rows that are one page: rows of one page count once, in a line's pages
and in those of the site.  Without it every row is a page.

A null site is a site of its own.  Null text stays null and has no lines; empty lines are kept and never counted.  Repeated
rows are pages each.  An empty table gives an empty result.  Very long texts are one cell each, read once a pass.  Other columns are carried along untouched; names starting with
``_line_dedup_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\x0b\f"
RATIO = 0.07
LEAST_PAGES = 3


def _own(name: str) -> str:
    return f"_line_dedup_{name}"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _filled(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def row_key(site: str, text: str) -> Column:
    return F.xxhash64(F.col(site), F.col(site).isNull(), F.col(text), F.col(text).isNull())


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES, copies: DataFrame | None = None) -> DataFrame:
    """(site, line): hashes of the lines on more than ``ratio`` of a site's pages."""
    key = F.xxhash64(F.col(site), F.col(site).isNull()).alias(_own("site"))
    found = F.explode(F.array_distinct(F.transform(_filled(_lines(text)), _hash))).alias(_own("line"))
    lines, counted = pages.select(key, found), pages.select(key)
    if copies is not None:
        page, row = copies.select(F.col("key").alias(_own("row")), F.col("page").alias(_own("page"))), row_key(site, text).alias(_own("row"))
        lines, counted = (x.distinct().join(page, _own("row")).drop(_own("row")).distinct() for x in (pages.select(key, row, found), pages.select(key, row)))
    counts = lines.groupBy(_own("site"), _own("line")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    totals = counted.groupBy(_own("site")).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, _own("site")).where(F.col("n") > ratio * F.col("total")).select(_own("site"), _own("line"))


def without_boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES, copies: DataFrame | None = None) -> DataFrame:
    """All rows and columns with ``text`` freed of its site's boilerplate, and the hashes dropped (``_line_dedup_drop``, null if none)."""
    flagged = boilerplate(pages, site, text, ratio, least, copies)
    keyed = pages.withColumns({_own("site"): F.xxhash64(F.col(site), F.col(site).isNull()), _own("key"): row_key(site, text)})
    lines = keyed.select(_own("key"), _own("site"), F.explode(F.array_distinct(F.transform(_filled(_lines(text)), _hash))).alias(_own("line")))
    marks = lines.join(flagged, [_own("site"), _own("line")], "left_semi").groupBy(F.col(_own("key")).alias(_own("row"))).agg(
        F.collect_set(_own("line")).alias(_own("drop")))
    joined = keyed.join(marks, F.col(_own("key")) == F.col(_own("row")), "left")
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col(_own("drop")), _hash(F.btrim(x, F.lit(BLANKS)))))
    clean = F.when(F.col(_own("drop")).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in pages.columns], _own("drop"), F.col(text).alias(_own("before")))


def cleaned(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES, copies: DataFrame | None = None) -> DataFrame:
    """The input's rows and columns, with boilerplate lines gone from ``text``."""
    return without_boilerplate(pages, site, text, ratio, least, copies).select(*pages.columns)


def line_counts(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """The cleaned rows with n_lines (lines with content before) and n_removed."""
    done = without_boilerplate(pages, site, text, ratio, least)
    before, after = (F.coalesce(F.size(_filled(_lines(c))), F.lit(0)) for c in (_own("before"), text))
    n_lines = F.when(F.col(_own("before")).isNull(), 0).otherwise(before).cast("long")
    kept = F.when(F.col(text).isNull(), 0).otherwise(after).cast("long")
    return done.select(*pages.columns, n_lines.alias("n_lines"), (n_lines - kept).alias("n_removed"))


def host(url: Column) -> Column:
    """The host of a URL, lower-cased, without port or credentials; null if there is none."""
    name = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(name != "", name)


FEW = 32  # openings that are searched for one by one
UNSEEN = "<\uffff"  # U+FFFF is no character; it stands behind the "<" of an opening that nothing closes


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _times(text: Column, *marks: str) -> Column:
    """How often the marks, of which no two overlap, stand in a text."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / len(m) for m in marks)


def _upto(text: Column, rest, before, after) -> Column:
    """``after`` of the end of a text that ``rest`` gives, behind ``before`` of all that precedes it."""
    return _let(text, lambda t: _let(rest(t), lambda end: F.concat(before(F.substr(t, F.lit(1), F.length(t) - F.length(end))), after(end))))


def visible_lines(html: Column) -> Column:
    """The text blocks of a page, one per line: scripts, styles and comments removed, a line for each block element.

    An opening that nothing closes stays as text.  A search for its end reads the rest of the page, so pages with more than ``FEW``
    openings take a path of their own: there the openings behind the last closing, which nothing closes, are not searched for.  The time is linear in
    the page whatever it holds, and both paths give the same text.  A page of null is null, an empty one empty; a U+FFFF behind a "<" may be dropped.
    """
    same = lambda x: x
    behind = lambda mark: lambda x: F.substring_index(x, mark, -1)
    behind_script = lambda x: F.regexp_replace(x, r"(?is)^.*</(?:script|style)\s*>", "")

    def bare(text: Column) -> Column:
        return F.regexp_replace(text, r"(?is)<(?:(?:script|style)\b.*?</(?:script|style)\s*>|!--.*?-->|!doctype[^>]*>)", "")

    def unscripted(text: Column) -> Column:
        text = _upto(text, behind_script, same, lambda x: F.regexp_replace(x, r"(?i)<(?=(?:script|style)\b)", UNSEEN))
        text = _upto(text, behind("-->"), same, lambda x: F.replace(x, F.lit("<!--"), F.lit(f"{UNSEEN}!--")))
        return F.replace(bare(text), F.lit(UNSEEN), F.lit("<"))

    def untagged(text: Column) -> Column:
        text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|nav|header|footer|article|section|h[1-6]|br|tr|table|title|body|head|html)\b[^>]*>", "\n")
        return F.regexp_replace(text, r"<[^>]*>", "")

    def unbroken(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r")), F.regexp_replace(text, r"[\n\r]+", " ")).otherwise(text)

    def unblanked(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(" \n")), F.regexp_replace(text, r"(?<! ) +\n", "\n")).otherwise(text)

    # Bound names also keep the optimiser from trying both paths on a constant page.
    text = _let(html, lambda x: F.when(_times(x, "<s", "<S", "<!") <= FEW, bare(x)).otherwise(_upto(x, behind(">"), unscripted, same)))
    text = _let(_let(text, unbroken), lambda x: F.when(_times(F.substring_index(x, ">", -1), "<") <= FEW, untagged(x)).otherwise(
        _upto(x, behind(">"), untagged, same)))
    return _let(F.regexp_replace(text, r"\n[ \n]+", "\n"), unblanked)
