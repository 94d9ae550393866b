"""User input to plans: full-text terms, inline filters, live prefixes, bookmarks, regular expressions."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

ROLES = ("parentfile", "childfile", "inputfile", "outputfile", "paramfile")


class ValidationError(ValueError):
    """The request cannot be run."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; with *prefix* the last one may go on."""

    tokens: tuple[str, ...]
    prefix: bool = False


def split_terms(query: str) -> list[tuple[str, bool]]:
    """(text, is prefix) of each term: quoted runs are phrases, a trailing star asks for a prefix.

    NUL characters are dropped, as are terms of white space alone; a lone star is a term.
    """
    out: list[tuple[str, bool]] = []
    query = query.replace("\0", "")
    at = 0
    while at < len(query):
        if query[at].isspace():
            at += 1
        elif query[at] == '"':
            end = query.find('"', at + 1)
            end = len(query) if end < 0 else end
            text, at = query[at + 1 : end], end + 1
            star = at < len(query) and query[at] == "*"
            at += star
            if text.strip():
                out.append((text, star))
        else:
            end = at
            while end < len(query) and not query[end].isspace() and query[end] != '"':
                end += 1
            text, at = query[at:end], end
            if text.endswith("*") and len(text) > 1:
                out.append((text.rstrip("*") or "*", True) if text.strip("*") else (text, False))
            else:
                out.append((text, False))
    return out


def sanitised(query: str) -> str:
    """The terms written out, each quoted."""
    return " ".join(f'"{t}"' + "*" * p for t, p in split_terms(query))


def tokenize(text: str) -> tuple[str, ...]:
    """The tokens of a query's term, as columns are tokenized."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return tuple(re.findall(r"[^\W_]+", plain))


def phrases(query: str) -> list[Phrase]:
    """What all must match; empty if the query can match nothing."""
    return [p for p in (Phrase(tokenize(t), star) for t, star in split_terms(query)) if p.tokens]


def check_limit(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= (1 << 63) - 1 or not 0 <= offset <= (1 << 63) - 1:
        raise ValidationError(f"limit {limit} or offset {offset} is out of range")


def check_role(role: str | None, declares: bool) -> None:
    if role is not None and (not declares or role not in ROLES):
        raise ValidationError(f"role {role!r} needs a search of declared files and must be one of {', '.join(ROLES)}")


def inline_filters(query: str) -> tuple[str, dict[str, str]]:
    """The query without lang:, language:, owner: and tag: tokens, and what they ask for; the last wins."""
    names = {"lang": "language", "language": "language", "owner": "owner", "tag": "tag"}
    rest, found = [], {}
    for word in query.split():
        key, colon, value = word.partition(":")
        if colon and key in names:
            if value:
                found[names[key]] = value
        else:
            rest.append(word)
    return " ".join(rest), found


def live_prefix(query: str) -> str:
    """The query as typed so far: an open quote is closed and the last term is a prefix."""
    query = query.rstrip()
    if not query or query.endswith("*"):
        return query
    return query + ('"' if query.count('"') % 2 else "") + "*"


def bookmark(query: str, marks: dict[str, str]) -> str:
    """@name to its text; an unknown name loses its sign."""
    return marks.get(query[1:], query[1:]) if query.startswith("@") else query


def java_regex(pattern: str) -> str:
    """The pattern for Java: Unicode classes, $ at the very end only; look-around and back-references are refused."""
    if re.search(r"(?<!\\)(?:\\\\)*\((?:\?=|\?!|\?<=|\?<!)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValidationError("look-around and back-references are not supported")
    try:
        re.compile(re.sub(r"\\z", r"\\Z", pattern.replace("(?P<", "(?P<")).replace(r"\p{", "[{"))
    except re.error as e:
        raise ValidationError(f"invalid pattern: {e}") from None
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "(?U)" + "".join(out).replace("(?P<", "(?<")
