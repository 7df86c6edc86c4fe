"""Keyword search: terms, phrases, proximity and boolean text to one Column.

The building blocks are plain Column functions, so a caller can also combine
them with ``&``, ``|`` and ``~``; ``matches`` reads the search-box spelling.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, functions as F

# The text column that belongs to each search space.
SUMMARY_OF_SPACE = {"english": "summary", "multilingual": "original_language_summary"}


def summary_column(space: str) -> Column:
    return F.col("summary" if space == "english" else "original_language_summary")


def _contains(pattern: str, space: str) -> Column:
    # Spark's LIKE treats a backslash as its escape sign; here it is plain text.
    pattern = pattern.replace("\\", "\\\\")
    return F.col("title").ilike(pattern) | summary_column(space).ilike(pattern)


def term(text: str, space: str = "english") -> Column:
    """Contains-match; ``*`` and ``?`` (and typed ``%``/``_``) are wildcards."""
    pattern = text.translate(str.maketrans("*?", "%_"))
    left = "" if pattern.startswith("%") else "%"
    right = "" if pattern.endswith("%") else "%"
    return _contains(f"{left}{pattern}{right}", space)


def phrase(text: str, space: str = "english") -> Column:
    return _contains(f"%{text}%", space)


def near_pattern(first: str, second: str, distance: int) -> str:
    # Fixed value: what may lie between the two words.
    a, b = (re.escape(re.sub(r"[*?]", "", w)) for w in (first, second))
    gap = rf"(?:\W+\w+){{0,{distance}}}\W+"
    return f"{a}{gap}{b}|{b}{gap}{a}"


def near(first: str, second: str, distance: int, space: str = "english") -> Column:
    """At most ``distance`` words between the two, either order, summary only."""
    return summary_column(space).rlike("(?iu)" + near_pattern(first, second, distance))


# The spelling of the search box, alternatives in order of precedence.
_SPELLING = r'"[^"]*"|\(|\)|NEAR/\d+{edge}|(?:AND|OR|NOT){edge}|[^\s()"]+'


class _Malformed(ValueError):
    pass


def _words(query: str, compat: bool) -> list[tuple[str, str]]:
    pattern = _SPELLING.format(edge="" if compat else r'(?=[\s()"]|$)')
    words = []
    for word in re.findall(pattern, query, re.IGNORECASE):
        upper = word.upper()
        if word[0] == '"':
            words.append(("quoted", word[1:-1]))
        elif word in "()" or upper in ("AND", "OR", "NOT"):
            words.append((upper, word))
        elif re.fullmatch(r"NEAR/\d+", upper):
            words.append(("NEAR", upper[5:]))
        else:
            words.append(("bare", word))
    return words


def _nested(words: list[tuple[str, str]]) -> list:
    """Bracketed runs become sub-lists."""
    stack: list[list] = [[]]
    for kind, text in words:
        if kind == "(":
            stack.append([])
        elif kind == ")":
            if len(stack) == 1:
                raise _Malformed(text)
            group = stack.pop()
            stack[-1].append(("group", group))
        else:
            stack[-1].append((kind, text))
    if len(stack) > 1:
        raise _Malformed("(")
    return stack[0]


def _any_of(run: list, space: str) -> Column:
    clauses: list[list] = [[]]
    for item in run:
        if item[0] == "OR":
            clauses.append([])
        else:
            clauses[-1].append(item)
    return functools.reduce(operator.or_, [_all_of(c, space) for c in clauses])


def _all_of(clause: list, space: str) -> Column:
    """Operands of one clause; AND between neighbours is optional."""
    found: list[Column] = []
    rest = list(clause)
    while True:
        negate = bool(rest) and rest[0][0] == "NOT"
        if negate:
            rest.pop(0)
        if not rest or rest[0][0] not in ("bare", "quoted", "group"):
            raise _Malformed("operand expected")
        kind, value = rest.pop(0)
        if kind == "bare" and rest and rest[0][0] == "NEAR":
            distance = int(rest.pop(0)[1])
            if not rest or rest[0][0] not in ("bare", "quoted"):
                raise _Malformed("word expected after NEAR")
            operand = near(value, rest.pop(0)[1], distance, space)
        elif kind == "bare":
            operand = term(value, space)
        elif kind == "quoted":
            operand = phrase(value, space)
        else:
            operand = _any_of(value, space)
        found.append(~operand if negate else operand)
        if not rest:
            return functools.reduce(operator.and_, found)
        if rest[0][0] == "AND":
            rest.pop(0)


def matches(query: str, space: str = "english", compat: bool = False) -> Column:
    """Predicate for a search-box query.

    A blank query matches everything and a malformed one is searched as one
    phrase. ``compat=True`` recognises AND/OR/NOT also at the start of a longer
    word, the way the original search box does.
    """
    if not query or not query.strip():
        return F.lit(True)
    words = _words(query, compat)
    if words:
        try:
            return _any_of(_nested(words), space)
        except _Malformed:
            pass
    return phrase(query, space)


def highlight_words(query: str) -> list[str]:
    """Distinct words of three or more letters that a result page marks."""
    plain = re.sub(r"\b(?:AND|OR|NOT|NEAR[/(]\d+\)?)(?!\w)", " ", query, flags=re.IGNORECASE)
    plain = re.sub(r"[()'\"\-]", " ", plain)
    return list(dict.fromkeys(re.findall(r"\b\w{3,}\b", plain, re.ASCII)))


def highlight(text: Column, query: str, opening: str = "<em>", closing: str = "</em>") -> Column:
    found = highlight_words(query)
    if not found:
        return text
    pattern = "(?iu)(" + "|".join(re.escape(w) for w in found) + ")"
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{opening}$1{closing}"))
