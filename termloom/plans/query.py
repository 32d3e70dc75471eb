"""The query language: text to a tree of OR, AND and tokens.

A query is boolean if it contains `` AND ``, `` OR `` or ``NOT ``; else it is free
text, whose tokens are alternatives and are ranked. Tokens are ``word``, ``prefix*``,
``'a phrase'``, ``'a phrase with a pref'*`` and ``ReplyTo:123``. In boolean queries OR
binds weaker than AND, ``a NOT b`` means ``a AND NOT b``, and each conjunction needs an
operand that isn't negated. Quoted parts are set apart first, so words inside a phrase
are never operators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum


class QueryError(RuntimeError):
    """A query that has no meaning."""


class Kind(Enum):
    KEYWORD = "keyword"
    PREFIX = "prefix"
    PHRASE = "phrase"
    PHRASE_PREFIX = "phrase_prefix"
    REPLY_TO = "reply_to"


@dataclass(frozen=True)
class Token:
    kind: Kind
    text: str  # lower-cased; of a phrase-prefix all but the last word
    suffix: str = ""  # of a phrase-prefix, the last word
    negated: bool = False

    @property
    def words(self) -> list[str]:
        """The words that count in scoring."""
        if self.kind is Kind.REPLY_TO:
            return []
        return [w for w in f"{self.text} {self.suffix}".split(" ") if w]

    @property
    def phrase(self) -> str:
        return f"{self.text} {self.suffix}" if self.kind is Kind.PHRASE_PREFIX else self.text


@dataclass(frozen=True)
class Query:
    """``branches`` are conjunctions, of which any may hold; a free text has one token in each."""

    boolean: bool
    branches: tuple[tuple[Token, ...], ...]

    @property
    def words(self) -> list[str]:
        return [w for branch in self.branches for t in branch for w in t.words]


_LEX = re.compile(r"'([^']*)'(\*?)|([^\s']+)|'")


def token(text: str, *, quoted: bool = False, star: bool = False, negated: bool = False) -> Token:
    text = text.lower()
    if quoted:
        if not text.strip():
            raise QueryError("an empty phrase")
        if not star:
            return Token(Kind.PHRASE, text, negated=negated)
        head, _, last = text.rpartition(" ")
        return Token(Kind.PHRASE_PREFIX, head, last, negated) if head else Token(Kind.PREFIX, last, negated=negated)
    if "*" in text:
        if text.count("*") > 1 or not text.endswith("*"):
            raise QueryError(f"a star stands only at the end of a word: {text}")
        return Token(Kind.PREFIX, text[:-1], negated=negated)
    if text.startswith("replyto:"):
        number = text.removeprefix("replyto:")
        if not re.fullmatch(r"-?\d+", number):
            raise QueryError(f"ReplyTo: takes a number, not {number!r}")
        return Token(Kind.REPLY_TO, number, negated=negated)
    return Token(Kind.KEYWORD, text, negated=negated)


def parse(query: str) -> Query:
    if not query.strip():
        raise QueryError("an empty query")
    boolean = any(mark in query for mark in (" AND ", " OR ", "NOT "))
    if boolean and query.count("'") % 2:
        raise QueryError("an unmatched quote in a boolean query")
    parts = [(m[1], True, m[2] == "*") if m[1] is not None else (m[3], False, False) for m in _LEX.finditer(query) if m[1] is not None or m[3] is not None]
    if not boolean:
        tokens = tuple((token(text, quoted=quoted, star=star),) for text, quoted, star in parts)
        if not tokens:
            raise QueryError("an empty query")
        return Query(False, tokens)
    branches: list[list[Token]] = [[]]
    expecting, negated = True, False
    for text, quoted, star in parts:
        word = None if quoted else text
        if word in ("AND", "OR"):
            if expecting:
                raise QueryError(f"{word} needs an operand before it")
            if word == "OR":
                branches.append([])
            expecting = True
        elif word == "NOT":
            if negated:
                raise QueryError("NOT NOT")
            expecting = negated = True  # `a NOT b` is `a AND NOT b`
        else:
            if not expecting:
                raise QueryError(f"an operator is missing before {text!r}")
            branches[-1].append(token(text, quoted=quoted, star=star, negated=negated))
            expecting = negated = False
    if expecting:
        raise QueryError("an operand is missing at the end")
    if any(all(t.negated for t in branch) for branch in branches):
        raise QueryError("a conjunction of negated operands only")
    return Query(True, tuple(map(tuple, branches)))
