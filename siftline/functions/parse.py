"""The query mini-syntax: text, an inline type or folder filter, and a scope."""

from __future__ import annotations

from typing import NamedTuple

from siftline.functions.constants import QUERY_EXTENSIONS

DIRECTORY = "__dir__"


class Query(NamedTuple):
    text: str
    type: str | None
    scope: str | None


def parse_query(query: str) -> Query:
    """Text, type filter and scope of a query.

    The first ``in:name`` gives the scope (later and bare ones stay in the text); a leading ``/`` or a last word ``/``,
    ``folder`` or ``dir`` asks for directories; a last word that is a known extension is a type filter.
    """
    scope, rest = None, []
    for word in query.split():
        if scope is None and word.startswith("in:") and len(word) > 3:
            scope = word[3:].lower()
        else:
            rest.append(word)
    text = " ".join(rest)
    if text.startswith("/") and len(text) > 1:
        return Query(text[1:], DIRECTORY, scope)
    if len(rest) > 1:
        *head, last = rest
        if last == "/" or (last.isascii() and last.lower() in ("folder", "dir")):
            return Query(" ".join(head), DIRECTORY, scope)
        kind = last.lstrip(".").lower()
        if kind in QUERY_EXTENSIONS:
            return Query(" ".join(head), kind, scope)
    return Query(text, None, scope)


def path_list(value: str) -> list[str]:
    """Paths of a JSON array, or else of a comma-separated list; trimmed, without empty ones."""
    import json

    try:
        parts = json.loads(value)
        if not isinstance(parts, list):
            raise ValueError
    except ValueError:
        parts = value.split(",")
    return [p for p in (str(x).strip() for x in parts) if p]
