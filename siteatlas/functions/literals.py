"""Many literal texts as one regular expression.

A list of literals becomes the trie of their characters, so an expression with thousands of them is one node of the plan, and a text is
looked at once per place and not once per literal.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 8


def _quoted(char: str) -> str:
    if char.isascii() and char.isalnum():
        return char
    return "\\" + char if char.isascii() and char.isprintable() and not char.isspace() else f"\\x{{{ord(char):x}}}"


def any_of(literals) -> str:
    """A regular expression that is found in a text where one of the literals is."""
    root: dict = {}
    for literal in literals:
        node = root
        for char in literal:
            if None in node:  # a shorter literal is found wherever this one is
                break
            node = node.setdefault(char, {})
        else:
            node.clear()
            node[None] = {}
    if not root:
        return "(?!)"
    # From the leaves up, without recursion: literals may be long.
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(child for char, child in node.items() if char is not None)
    said: dict[int, str] = {}
    for node in reversed(order):
        if None in node:
            said[id(node)] = ""
            continue
        ends = [c for c, child in node.items() if not said[id(child)]]
        rest = [_quoted(c) + said[id(child)] for c, child in node.items() if said[id(child)]]
        if ends:
            rest.append(_quoted(ends[0]) if len(ends) == 1 else "[" + "".join(map(_quoted, ends)) + "]")
        said[id(node)] = rest[0] if len(rest) == 1 else "(?:" + "|".join(rest) + ")"
    return said[id(root)]


def contains_any(text: Column, parts) -> Column:
    """True where ``text`` holds at least one of the literal ``parts``: a search for each of a few, one expression for more."""
    parts = list(parts)
    if len(parts) > FEW:
        return text.rlike(any_of(parts))
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def alternatives(expressions) -> list[str]:
    """Regular expressions joined into one; those that count or name groups stay by themselves, as do those that set flags."""
    alone = [x for x in expressions if re.search(r"\\[1-9k]|\(\?<[^=!]|\(\?[a-zA-Z-]+\)|\\Q|#", x)]
    together = [x for x in expressions if x not in alone]
    return [*(["|".join(f"(?:{x})" for x in together)] if together else []), *alone]
