"""The query language: words, "phrases", -exclusions, ext: and path: operators, and what is asked of a search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from searchloom.functions.analysis import lower_ascii_text

#: One piece of a query: an operator with a value, a phrase, or a word. White space is ASCII's.
_S = r"[ \t\n\v\f\r]"
_PIECE = re.compile(
    rf'(?P<op>(?i:ext|path)):(?:"(?P<quoted>[^"]*)"?|(?P<bare>[^ \t\n\v\f\r]*))|(?P<minus>-(?!{_S}|$))?(?:"(?P<phrase>[^"]*)"?|(?P<word>[^ \t\n\v\f\r]+))'
)


@dataclass(frozen=True)
class Token:
    text: str
    phrase: bool = False
    excluded: bool = False


@dataclass(frozen=True)
class Parsed:
    tokens: tuple[Token, ...] = ()
    ext: str | None = None
    path: str | None = None

    @property
    def wanted(self) -> tuple[Token, ...]:
        return tuple(t for t in self.tokens if not t.excluded)

    @property
    def unwanted(self) -> tuple[Token, ...]:
        return tuple(t for t in self.tokens if t.excluded)


def parse(raw: str) -> Parsed:
    """A query's tokens and filters. An unterminated phrase ends with the query; empty phrases, lone minus signs and empty
    operator values are dropped; of several ext: or path: the first counts; -ext:pdf excludes the word ext:pdf."""
    tokens, found = [], {"ext": None, "path": None}
    for m in _PIECE.finditer(raw):
        if m["op"]:
            name, value = m["op"].lower(), m["quoted"] if m["quoted"] is not None else m["bare"]
            if value and found[name] is None:
                found[name] = value
            continue
        text = m["phrase"] if m["phrase"] is not None else m["word"]
        if not text or (text == "-" and m["word"] and not m["minus"]):
            continue
        tokens.append(Token(text, m["phrase"] is not None, bool(m["minus"])))
    ext = found["ext"] and lower_ascii_text(found["ext"])
    return Parsed(tuple(tokens), ext and (ext if ext.startswith(".") else "." + ext), found["path"])


@dataclass(frozen=True)
class SearchQuery:
    pattern: str = ""
    sort_field: str = "relevance"  # relevance, name, modified, size, path
    descending: bool = False
    limit: int | None = 200
    offset: int = 0
    folders_first: bool = True
    exact_words: bool = False
    extensions: tuple[str, ...] = ()
    modified_since: int = 0
    with_snippets: bool = False
    #: Not the default: drop a document with any excluded term, rather than with all of them.
    exclude_any: bool = False
    roots: tuple[str, ...] = ()
