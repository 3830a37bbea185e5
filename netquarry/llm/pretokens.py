"""Splitting of texts into pre-tokens by a pattern."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

#: Fixed value: the pattern that has a faster equal for texts of the first characters.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The faster pattern's classes hold the characters below this one; their members come from the slower one's.
BELOW = 0x250


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text."""
    slow = regex.compile(pattern).findall
    if pattern != KNOWN:
        return slow
    chars = [chr(k) for k in range(BELOW)]
    letters, digits, spaces = (re.escape("".join(c for c in chars if regex.match(x, c))) for x in (r"\p{L}", r"\p{N}", r"\s"))
    fast = re.compile(f" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
    beyond = re.compile(f"[^\x00-{chr(BELOW - 1)}]").search
    return lambda text: slow(text) if beyond(text) else fast(text)
