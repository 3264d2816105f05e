"""Text from HTML and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import squeeze

#: Named character references that are decoded beside all numbers (fixed values); the ampersand comes last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "\u2014", "ndash": "\u2013", "hellip": "\u2026", "lsquo": "\u2018", "rsquo": "\u2019",
            "ldquo": "\u201c", "rdquo": "\u201d", "bull": "\u2022", "deg": "\u00b0", "micro": "\u00b5", "plusmn": "\u00b1", "times": "\u00d7", "eacute": "\u00e9",
            "alpha": "\u03b1", "beta": "\u03b2", "gamma": "\u03b3", "kappa": "\u03ba", "amp": "&"}


def numbered(x: Column) -> Column:
    """Decimal and hexadecimal character references decoded; those beyond Unicode stay."""
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});")))
    hexadecimal = lambda r: F.lower(F.substring(r, 1, 1)) == "x"
    point = lambda r: F.when(hexadecimal(r), F.conv(F.substring(r, 2, 9), 16, 10)).otherwise(r).cast("int")
    char = lambda r: F.decode(F.unhex(F.lpad(F.hex(point(r)), 8, "0")), "UTF-32")
    valid = lambda r: point(r).between(1, 0x10FFFF) & ~point(r).between(0xD800, 0xDFFF)
    return F.aggregate(F.filter(found, valid), x, lambda t, r: F.replace(t, F.concat(F.lit("&#"), r, F.lit(";")), char(r)))


def plain(x: Column) -> Column:
    """Text without tags, numbered and common named references decoded, white space squeezed."""
    x = numbered(F.regexp_replace(x, r"(?s)<[^>]*>", " "))
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return squeeze(x)


def paragraphs(pages: DataFrame) -> DataFrame:
    """One row per paragraph of a page, from 1, with its heading's text before it: page_id, n, text."""
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:p|h[1-6])\b[^>]*>(.*?)(?=</(?:p|h[1-6])>|<p\b|<h[1-6]\b|</article|\z)"))
    texts = F.filter(F.transform(found, plain), lambda t: t != "")
    return pages.select("page_id", F.posexplode(texts).alias("i", "text")).select("page_id", (F.col("i") + 1).alias("n"), "text")
