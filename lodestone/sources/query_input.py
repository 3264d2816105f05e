"""What a user types: keywords, exclusions and identifiers, and the search clause made of them."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

#: Longest PMID, in digits (fixed value).
PMID_DIGITS = 9
#: Words that join terms and are none themselves (fixed values).
BOOLEANS = {"and", "or", "not"}


@dataclass
class Parsed:
    keywords: list[str] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    pmids: list[str] = field(default_factory=list)
    pmcids: list[str] = field(default_factory=list)


def items(raw: str) -> list[str]:
    """Pieces between commas (a line end is a space); quotes hold a piece together. Raises ValueError for an open quote."""
    one_line = " ".join("".join(c if c.isprintable() else " " for c in raw).split())
    try:
        rows = list(csv.reader([one_line], skipinitialspace=True, strict=True))
    except csv.Error as e:
        raise ValueError(f"a quotation mark is not closed: {raw}") from e
    return [" ".join(x.split()) for row in rows for x in row if x.strip()]


def labelled(item: str) -> tuple[str, str]:
    """A label in front (not, pmid, pmcid, pmc or none) and what follows it. A label ends at a space, colon, equals sign
    or, before a number, at once; `not` needs a space or colon."""
    low = item.lower()
    for label in ("pmcid", "pmid", "pmc", "not"):
        if low.startswith(label):
            rest = item[len(label):]
            ends = rest[:1] in ("", " ", ":") or (label != "not" and (rest[:1] == "=" or rest[:1].isdigit() or (label == "pmcid" and rest[:3].lower() == "pmc")))
            if ends:
                rest = rest.lstrip()
                if label != "pmc" and rest[:1] in ((":",) if label == "not" else (":", "=")):
                    rest = rest[1:]
                return label, rest.strip()
    return "", item


def digits(x: str, versioned: bool = False) -> str:
    """A text that is a number (with a version after a dot, if one may stand there), without the version; else empty."""
    number, dot, version = x.partition(".")
    whole = number.isascii() and number.isdigit() and (not dot or (versioned and version.isascii() and version.isdigit()))
    return number if whole else ""


def article(item: str) -> tuple[str, str]:
    """pmid or pmcid and the identifier; empty if the piece is none."""
    label, rest = labelled(item)
    if label == "pmcid" and rest.lower().startswith("pmc"):
        rest = rest[3:].strip()
    if label in ("pmc", "pmcid"):
        number = digits(rest, versioned=True)
        return ("pmcid", f"PMC{number}") if number else ("", "")
    if label in ("", "pmid"):
        if rest.endswith("]") and rest[:-1].rpartition("[")[2].strip().lower() == "pmid":  # a field tag
            rest = rest.rpartition("[")[0].strip()
        number = digits(rest)
        if number.strip("0") and len(number) <= PMID_DIGITS:
            return "pmid", number.lstrip("0")
    return "", ""


def keyword(value: str) -> str:
    """A keyword without the quotes around it. Raises ValueError if it holds neither letter nor digit."""
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1].strip()
    if not any(c.isascii() and c.isalnum() for c in value):
        raise ValueError(f"a keyword must hold a word or number: {value}")
    return value


def parse(raw: str) -> Parsed:
    """Each piece as an identifier, an exclusion (not x, not: x) or a keyword, repeated ones too. Raises ValueError for a
    bare `not`, an excluded identifier, a number that is no PMID, a malformed identifier and a piece without a word."""
    out = Parsed()
    for item in items(raw):
        label, rest = labelled(item)
        kind, value = article(item)
        if label == "not":
            if not rest:
                raise ValueError("nothing after not")
            if article(keyword(rest))[0]:
                raise ValueError(f"an identifier can't be excluded: {rest}")
            out.exclusions.append(keyword(rest))
        elif kind:
            (out.pmids if kind == "pmid" else out.pmcids).append(value)
        elif digits(item):
            raise ValueError(f"not a PMID: {item}")
        elif label in ("pmid", "pmcid") or item[:3].lower() == "pmc":
            raise ValueError(f"malformed identifier: {item}")
        else:
            out.keywords.append(keyword(item))
    return out


def atoms(query: str) -> set[str]:
    """Comparable terms of a query: its quoted phrases, and all words but booleans; article ids and field tags go."""
    low = re.sub(r"\[[^\]]+\]", " ", re.sub(r"(?:pmcid\s*[:=]?\s*)?pmc\s*\d+(?:\.\d+)?", " ", query.lower()))
    parts = low.split('"')
    quoted = parts[1:len(parts) - 1 + len(parts) % 2:2]
    phrases = {" ".join(x.split()) for x in quoted if x.strip()}
    return phrases | {w for w in re.findall(r"[a-z][a-z0-9_-]*\*?", " ".join(parts)) if w not in BOOLEANS}


def atom_covered(atom: str, known: set[str]) -> bool:
    """Whether known atoms hold an atom: as it is, or, for single words, by a wildcard on either side."""
    if atom in known:
        return True
    words = [k for k in known if " " not in k] if " " not in atom else []
    stem = atom.removesuffix("*")
    return any((k.endswith("*") and stem.startswith(k[:-1])) or (atom.endswith("*") and k.removesuffix("*").startswith(stem)) for k in words)


def covered(keyword_: str, known: set[str]) -> bool:
    """Whether known atoms make a keyword needless: all of its own are covered, and it has some."""
    own = atoms(keyword_)
    return bool(own) and all(atom_covered(a, known) for a in own)


def clause(default: str, given: Parsed) -> str:
    """The default query or any keyword, but no exclusion."""
    quoted = lambda x: f'"{x}"' if " " in x else x
    wanted = [f"({default})"] * bool(default) + [quoted(k) for k in given.keywords]
    out = " OR ".join(wanted)
    return f"({out})" + "".join(f" NOT {quoted(x)}" for x in given.exclusions)


def identity(value: str) -> str:
    return " ".join(value.casefold().split())


def new_ones(values: list[str], seen: set[str], needless=lambda x: False) -> tuple[list[str], int]:
    """Values not seen before and not needless, in order, and how many were left out."""
    out: list[str] = []
    for v in values:
        if identity(v) not in seen and not needless(v):
            out.append(v)
        seen = seen | {identity(v)}
    return out, len(values) - len(out)


def effective(given: Parsed, known: set[str], default_ids: set[str]) -> tuple[Parsed, int]:
    """What is new: exclusions once each, keywords neither excluded nor covered, identifiers not among the defaults; and
    how many of all were not."""
    without, a = new_ones(given.exclusions, set())
    words, b = new_ones(given.keywords, {identity(x) for x in without}, lambda k: covered(k, known))
    held = {identity(x) for x in default_ids}
    pmids, c = new_ones(given.pmids, held)
    pmcids, d = new_ones(given.pmcids, held)
    return Parsed(words, without, pmids, pmcids), a + b + c + d
