"""Text cleaning and token functions as Column expressions. Null counts as the empty string unless said otherwise."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Sections and passage types that are left out, and the types kept by section (fixed values).
SKIPPED_SECTIONS = ("REF", "METHODS", "ABBR", "SUPPL", "COMP_INT", "CASE", "APPENDIX", "ACK_FUND")
SKIPPED_IN_SECTION = ("author", "auth", "affiliation", "correspond", "table", "tabel", "fig", "figure")
SKIPPED_IN_TYPE = ("table", "fig", "figure", "author", "affiliation", "correspond", "ref")
KEPT_TYPES = {"ABSTRACT": ("abstract", "paragraph", ""), "TITLE": ("title", "front", "")}
KEPT_ELSE = ("paragraph", "paragrpah", "body", "text", "section", "subsection", "")
#: Section labels by the first pattern found in a heading (fixed values).
SECTION_LABELS = (
    ("introduction|background", "INTRO"), ("method|material|experimental", "METHODS"), ("result|finding", "RESULTS"),
    ("discussion", "DISCUSSION"), ("conclusion", "CONCLUSION"), ("case report|case presentation", "CASE"),
    ("supplement", "SUPPLEMENT"), ("reference|bibliograph", "REFERENCES"),
)
BOOLEANS = ("and", "or", "not")
#: Infons with such keys belong to author lists (fixed value).
AUTHOR_KEYS = "^(name_|aff_)|affiliation|orcid"


def given(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def squeeze(x: Column) -> Column:
    """Runs of white space, of Unicode's too, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(given(x), r"(?U)\s+", " "))


def norm(x: Column) -> Column:
    """Squeezed and lower-cased: the form in which labels are compared."""
    return F.lower(squeeze(x))


def clean_text(x: Column) -> Column:
    """All line ends become line feeds, NULs go, lines lose white space at their ends, the whole at both."""
    x = F.regexp_replace(given(x), r"\r\n|[\r\x{2028}\x{2029}\x{85}]", "\n")
    x = F.regexp_replace(F.replace(x, F.lit("\0"), F.lit("")), r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def sanitize_query(x: Column) -> Column:
    """One line: controls and white space become single spaces."""
    return squeeze(F.regexp_replace(clean_text(x), r"[\x00-\x1f\x7f]", " "))


def sanitize_chunk(x: Column) -> Column:
    """Pipes, replacement characters, controls and other category C characters become spaces, runs of which one."""
    return F.trim(F.regexp_replace(F.regexp_replace(given(x), r"[|\x{FFFD}\p{C}]", " "), r"(?U)\s+", " "))


def keep_passage(section: Column, kind: Column, infon_keys: Column | None = None) -> Column:
    """Whether a passage is kept, by its section, its type and the keys of its infons."""
    s, t = clean_text(section), F.lower(clean_text(kind))
    upper, lower = F.upper(s), F.lower(s)
    drop = upper.isin(*SKIPPED_SECTIONS) | lower.rlike("|".join(SKIPPED_IN_SECTION)) | t.rlike("|".join(SKIPPED_IN_TYPE))
    if infon_keys is not None:
        drop = drop | F.coalesce(F.exists(infon_keys, lambda k: F.lower(k).rlike(AUTHOR_KEYS)), F.lit(False))
    keep = F.when(upper == "ABSTRACT", t.isin(*KEPT_TYPES["ABSTRACT"])).when(upper == "TITLE", t.isin(*KEPT_TYPES["TITLE"])).otherwise(t.isin(*KEPT_ELSE))
    return ~drop & keep


def section_label(heading: Column) -> Column:
    """The label of a section by its heading; BODY if no pattern is found."""
    low, out = F.lower(given(heading)), None
    for pattern, label in SECTION_LABELS:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out.otherwise("BODY")


def doc_key(pmcid: Column, pmid: Column, canonical: Column) -> Column:
    """First identifier given, with other characters than letters, digits, dot, dash and underscore replaced."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    raw = F.coalesce(some(pmcid), some(pmid), some(canonical), F.lit("unknown"))
    return F.substring(F.regexp_replace(raw, r"[^A-Za-z0-9._-]+", "_"), 1, 200)


def safe_name(x: Column) -> Column:
    """A file name: a slug of at most 64 characters and 12 digits of a hash."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(given(x), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, 64)
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(given(x), 256), 1, 12))


def split_tokens(x: Column) -> Column:
    """Words and single punctuation marks; an underscore stands alone."""
    return F.regexp_extract_all(given(x), F.lit(r"((?U)[^\W_]+|[^\w\s]|_)"))


def singular(w: Column) -> Column:
    """A word without its plural ending, by the first rule that fits."""
    ends = lambda *xs: w.rlike(f"(?:{'|'.join(xs)})$")
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (F.when(~ends("s"), w)
            .when(ends("viruses"), cut(2))
            .when(ends("ies") & ~ends("eies", "aies"), F.concat(cut(3), F.lit("y")))
            .when(ends("sses") & ~ends("aes", "ees", "oes"), cut(2))
            .when(ends("es") & ~ends("aes", "ees", "oes"), cut(1))
            .when(ends("us", "ss"), w)
            .otherwise(cut(1)))


def singular_text(x: Column) -> Column:
    """Tokens of a text, each singular, joined by spaces."""
    return F.array_join(F.transform(split_tokens(x), singular), " ")


def abbreviation_key(x: Column) -> Column:
    """Without white space and dashes of seven kinds."""
    return F.regexp_replace(given(x), r"(?U)[\s\x{2D}\x{2010}-\x{2014}\x{2212}]+", "")


def abbreviation_variants(x: Column) -> Column:
    """The key, and it with or without a plural s; an empty one of them is left out."""
    k = abbreviation_key(x)
    other = F.when(k.endswith("s"), F.substring(k, F.lit(1), F.length(k) - 1)).otherwise(F.concat(k, F.lit("s")))
    return F.filter(F.array_distinct(F.array(k, other)), lambda v: v != "")


def looks_abbreviated(x: Column) -> Column:
    """A key of more than one character, and in the text an upper-case letter, digit, plus, minus or slash, or no space
    and a key of at most 12."""
    t, key = F.trim(given(x)), abbreviation_key(x)
    return (F.length(key) > 1) & (t.rlike(r"[\p{Lu}\p{N}+/-]") | ((F.length(key) <= 12) & ~t.contains(" ")))


def keyword_atoms(query: Column) -> Column:
    """Quoted phrases and all words of a query but booleans, distinct, in order; article ids and field tags in brackets
    go."""
    q = F.regexp_replace(F.lower(sanitize_query(query)), r"(?:pmcid\s*[:=]?\s*)?pmc\s*\d+(?:\.\d+)?", " ")
    q = F.regexp_replace(q, r"\[[^\]]+\]", " ")
    phrases = F.filter(F.transform(F.regexp_extract_all(q, F.lit('"([^"]+)"')), squeeze), lambda p: p != "")
    words = F.filter(F.regexp_extract_all(q, F.lit(r"([a-z][a-z0-9_-]*\*?)")), lambda w: ~w.isin(*BOOLEANS))
    return F.array_distinct(F.concat(phrases, words))


def strict_pmcid(x: Column, implied: bool = False) -> Column:
    """PMC and digits standing alone in a text; a bare number only where the key it stands under implies it."""
    t = clean_text(x)
    found = F.regexp_extract(t, r"(?i)\bPMC\s*(\d+)\b", 1)
    bare = F.when(t.rlike(r"^\d+$"), t) if implied else F.lit(None).cast("string")
    return F.concat(F.lit("PMC"), F.coalesce(F.nullif(found, F.lit("")), bare))


#: Entity types by the names that annotation services give them (fixed values).
TYPE_NAMES = {
    "gene": "gene", "gene/protein": "gene", "protein": "gene", "chemical": "chemical", "chemicals": "chemical", "chemical entity": "chemical",
    "drug": "chemical", "drug/chemical": "chemical", "drug chemical": "chemical",
}
#: What the beginning of an answer without a full text says, and how much of it is looked at (fixed values).
UNAVAILABLE = ("not found", "no document", "not available", "no full text", "does not exist")
BEGINNING = 1000


def service_type(x: Column) -> Column:
    """gene or chemical by a service's name for a type; null for others."""
    names = F.create_map(*[F.lit(v) for kv in TYPE_NAMES.items() for v in kv])
    return F.try_element_at(names, F.lower(squeeze(x)))


def infon(infons: Column, *keys: str) -> Column:
    """The first filled value under one of some keys, which are compared without case, spaces, dashes and underscores."""
    plain = lambda k: F.regexp_replace(F.lower(k), r"[\s_-]", "")
    by_key = F.transform_keys(F.map_filter(infons, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != ""), lambda k, v: plain(k))
    return F.coalesce(*[F.try_element_at(by_key, plain(F.lit(k))) for k in keys])


def says_unavailable(body: Column) -> Column:
    """Whether the beginning of an answer says that there is no full text."""
    start = F.lower(F.substring(given(body), 1, BEGINNING))
    out = F.lit(False)
    for marker in UNAVAILABLE:
        out = out | start.contains(marker)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def places(text: pd.Series, query: pd.Series, low_text: pd.Series, low_query: pd.Series) -> pd.Series:
    """In time linear in the text: by built-in functions each place costs a walk from the text's start."""
    def found(t: str | None, q: str | None) -> list[int]:
        out = []
        at = t.find(q) if t and q else -1
        while at >= 0:
            out.append(at)
            at = t.find(q, at + 1)
        return out

    return pd.Series([found(t, q) or found(x, y) for t, q, x, y in zip(text, query, low_text, low_query, strict=True)], dtype=object)


def occurrences(text: Column, query: Column) -> Column:
    """Places (from 0) where a query stands in a text, overlapping ones too; lower-cased if it stands nowhere as is."""
    return places(text, query, F.lower(text), F.lower(query))


def nearest(places: Column, at: Column) -> Column:
    """The place nearest to another, the first of ties; null for none."""
    return F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - at).alias("far"), p.alias("place"))))["place"]


def has_parenthetical(a: Column, b: Column) -> Column:
    """Whether what stands in parentheses in one text is the other."""
    inside = lambda x, y: F.exists(F.regexp_extract_all(F.lower(given(x)), F.lit(r"\(([^()]*)\)")), lambda p: F.trim(p) == F.lower(F.trim(given(y))))
    return inside(a, b) | inside(b, a)


def identifier_parts(x: Column) -> Column:
    """Pieces between commas, semicolons and pipes; blanks and placeholders go."""
    return F.filter(F.transform(F.split(given(x), r"[,;|]"), lambda p: F.trim(p)), lambda p: ~F.lower(p).isin("", "-", "none", "null", "nan"))


def boolean_match(x: Column, wanted: list[str], excluded: list[str]) -> Column:
    """Whether a text holds any wanted term (all texts do, if there is none) and no excluded one, whatever the case."""
    low = F.lower(given(x))
    holds = lambda terms, start: functools.reduce(lambda a, t: a | low.contains(t.lower()), terms, F.lit(start))
    return holds(wanted, not wanted) & ~holds(excluded, False)


def json_number(x: Column, path: str) -> Column:
    """A whole number in a JSON text; null if there is none."""
    return F.get_json_object(x, path).try_cast("long")
