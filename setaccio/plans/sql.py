"""Pieces of the DuckDB SQL that check the queries."""

from __future__ import annotations

from setaccio.functions.text import BLANKS

__all__ = ["BLANKS", "LINES", "PARAS", "STRIP", "WORDS"]


def WORDS(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{BLANKS}]+'), lambda w: w <> '')"


def STRIP(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{BLANKS}]+|[{BLANKS}]+\z', '', 'g')"


def LINES(x: str) -> str:
    return PARAS(x, "chr(10)")


def PARAS(x: str, sep: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {sep}), lambda s: {STRIP('s')}), lambda s: s <> '')"
