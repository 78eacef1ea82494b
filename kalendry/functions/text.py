"""Column functions on text, HTML and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kalendry.functions import addresses


def squeezed(c: Column) -> Column:
    """Lower case without any white space (Unicode white space too)."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def folded(c: Column) -> Column:
    """Lower case, white space collapsed to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"^ | $", "")


#: Characters that Java writes as several in upper case, with the one that stands for each in simple case mapping.
_ONE_EACH = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}
_ONES = f"[{''.join(_ONE_EACH)}]"


def upper_each(c: Column) -> Column:
    """Upper case of each character by itself, so no text grows and lower case leads back: \u00df is \u1e9e, not SS."""
    kept = F.create_map(*[F.lit(x) for pair in _ONE_EACH.items() for x in pair])
    pieces = F.regexp_extract_all(c, F.lit(f"(?s)({_ONES}|[^{_ONES[1:]}+)"), F.lit(1))
    return F.when(c.rlike(_ONES), F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(kept, x), F.upper(x))), "")).otherwise(F.upper(c))


def or_default(c: Column, default) -> Column:
    """Empty text and null alike give the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


#: Fixed: elements whose content is not page text, elements that end a line, and named characters.
HIDDEN = ("script", "style", "noscript", "svg", "head", "nav", "footer")
BLOCKS = "p|div|li|tr|table|h[1-6]|section|article"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&"))


def _character(piece: Column) -> Column:
    """&#n; as its character; beyond Unicode and for surrogates the replacement character."""
    n = F.regexp_extract(piece, r"^&#0*(\d{1,8});$", 1).try_cast("long")
    real = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    known = F.decode(F.unhex(F.lpad(F.hex(F.when(real, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    return F.when(piece.rlike(r"^&#\d+;$"), F.coalesce(known, F.lit("\ufffd"))).otherwise(piece)


def decoded(c: Column) -> Column:
    """Decimal references first, then the eight names, so &#38;lt; ends as <; hexadecimal ones stay."""
    pieces = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(&#\d+;|[^&]+|&)"), F.lit(1)), _character)
    out = F.when(F.contains(c, F.lit("&#")), F.array_join(pieces, "")).otherwise(c)
    for name, text in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(text))
    return out


def html_text(html: Column) -> Column:
    """Visible text of a page: hidden elements and comments go, cells are set apart, blocks end lines."""
    out = F.regexp_replace(html, rf"(?is)<({'|'.join(HIDDEN)})\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</t[dh]>", " | ")
    out = F.regexp_replace(out, rf"(?i)<(br|hr)\b[^>]*>|</({BLOCKS})>", "\n")
    out = F.regexp_replace(decoded(F.regexp_replace(out, r"<[^>]+>", " ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"(?U)^\s+|\s+$", "")


def links(html: Column) -> Column:
    """Array of (href, text) of anchors with a quoted address, in page order."""
    anchor = F.lit(r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a\s*>""")
    pairs = F.arrays_zip(F.regexp_extract_all(html, anchor, F.lit(1)).alias("href"), F.regexp_extract_all(html, anchor, F.lit(2)).alias("text"))
    return F.transform(pairs, lambda p: F.struct(p["href"].alias("href"), F.trim(F.regexp_replace(html_text(p["text"]), r"(?U)\s+", " ")).alias("text")))


def page_links(html: Column, base: Column, most: int = 200) -> Column:
    """Array of (href, text): absolute, fetchable, with a text, each address once (its first), at most `most`.

    `most` is the reader's own limit on a page's list.
    """
    full = F.transform(links(html), lambda p: F.struct(normal_url(addresses.resolved(p["href"], base)).alias("href"), p["text"].alias("text")))
    usable = F.filter(full, lambda p: p["href"].isNotNull() & (p["text"] != "") & url_refusal(p["href"]).isNull())

    def first_of_each(rows: Column) -> Column:
        """One pass by hash over the addresses; each is then found at its first place."""
        hrefs = F.transform(rows, lambda p: p["href"])
        return addresses.bound(hrefs, lambda h: F.transform(F.array_distinct(h), lambda x: F.get(rows, (F.array_position(h, x) - 1).cast("int"))))

    return F.slice(addresses.bound(usable, first_of_each), 1, most)


def normal_url(url: Column) -> Column:
    """The key of a page: its address without fragment and closing slash; null if it cannot be read."""
    return addresses.normal(url)


def url_refusal(url: Column) -> Column:
    """Why an address must not be fetched (null: it may be): scheme, host or private."""
    return addresses.refusal(url)


#: Pages with less text than this are fetched again by other means.
LEAST_TEXT = 200


def too_short(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_TEXT


def page_key(url: Column) -> Column:
    """The name under which a page is kept."""
    return F.left(F.sha2(url, 256), F.lit(24))
