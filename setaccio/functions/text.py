"""Text functions as column expressions: cleaning, words, lines, inventories.

Patterns name blanks explicitly, since what counts as one differs between Java's classes, Spark's trim and the rule meant
here: every character at which text is split into words, with no-break and typographic spaces among them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The blanks, as the inside of a character class.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = f"[{BLANKS}]"
#: The same blanks as a string.
BLANK_CHARS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: What isn't printed, as the inside of a character class.
UNPRINTED = r"\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
#: Characters that cleaning replaces or drops.
NARROW, NO_BREAK, BOM, COPYRIGHT, ELLIPSIS, REPLACEMENT = map(chr, (0x202F, 0xA0, 0xFEFF, 0xA9, 0x2026, 0xFFFD))
#: A section heading of an article, on a line of its own.
HEADING = r"(?m)^={1,6}.{0,120}={1,6}\s*$"


def strip(c: Column) -> Column:
    """Without blanks at both ends; null stays null."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def _parts(stripped: Column, pattern: str) -> Column:
    """A stripped text cut at a pattern that takes all blanks with it; no part of an empty one."""
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, pattern))


def words(c: Column) -> Column:
    """The runs of characters between blanks, in order; none of an empty text."""
    return _parts(strip(c), f"{BLANK}+")


def lines(c: Column) -> Column:
    """The lines that aren't blank, stripped."""
    return _parts(strip(c), f"{BLANK}*\n{BLANK}*")


def paragraphs(c: Column, separator: str) -> Column:
    """The stripped parts between separators (a plain string) that aren't blank."""
    return F.filter(F.transform(F.split(c, rf"\Q{separator}\E"), strip), lambda x: x != "")


def _newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def _spaces(c: Column) -> Column:
    """No-break spaces become spaces, byte order marks go."""
    return F.translate(c, NARROW + NO_BREAK + BOM, "  ")


def _typography(c: Column) -> Column:
    """Copyright signs and replacement characters go, an ellipsis becomes three full stops."""
    return F.replace(F.translate(c, COPYRIGHT + REPLACEMENT, ""), F.lit(ELLIPSIS), F.lit("..."))


def _collapse(c: Column) -> Column:
    """One blank between the words of a line, one empty line between paragraphs, none at the ends."""
    per_line = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.array_join(words(x), " ")), "\n")
    return strip(F.regexp_replace(per_line, "\n{3,}", "\n\n"))


def clean_full(c: Column) -> Column:
    """Spaces, typography, line ends, then blanks collapsed."""
    return _collapse(_newlines(_typography(_spaces(c))))


def clean_basic(c: Column) -> Column:
    """As clean_full without the typography; null becomes empty."""
    return _collapse(_newlines(_spaces(F.coalesce(c, F.lit("")))))


def clean_book(normalized: Column) -> Column:
    """Of a text in composed form: spaces, typography and line ends; blanks stay."""
    return _newlines(_typography(_spaces(normalized)))


def clean_article(normalized: Column) -> Column:
    """Of a text in composed form: spaces and line ends, no headings, one empty line between paragraphs, stripped."""
    spaced = _newlines(F.translate(normalized, NARROW + NO_BREAK, "  "))
    return strip(F.regexp_replace(F.regexp_replace(spaced, HEADING.replace("(?m)", "(?md)"), ""), "\n{3,}", "\n\n"))


def strip_markup(c: Column) -> Column:
    """A text that begins with `<` with every tag replaced by a space; any other text as it is."""
    return F.when(strip(c).startswith("<"), F.regexp_replace(c, "<[^>]+>", " ")).otherwise(c)


def printable(c: Column, length: int = 120) -> Column:
    """The first characters, with a middle dot for each that isn't printed."""
    return F.regexp_replace(F.substring(c, 1, length), f"[{UNPRINTED}]", "·")


def non_ascii(c: Column) -> Column:
    """The distinct characters beyond ASCII, sorted."""
    return F.array_sort(F.array_distinct(F.split(F.regexp_replace(c, r"[\x{0}-\x{7f}]", ""), "")))


def between(c: Column, begin: str, end: str) -> Column:
    """What stands between the line that has one marker and the next line that has the other; the whole text without them."""
    found = F.regexp_extract(c, rf"(?s)\Q{begin}\E[^\n]*\n(.*?)\n[^\n]*\Q{end}\E", 1)
    return F.when(found != "", found).otherwise(c)


def articles(c: Column) -> Column:
    """The bodies of the `<doc ...>` elements of an extractor's output."""
    return F.regexp_extract_all(c, F.lit(r"(?s)<doc[^>]*>\n(.*?)\n</doc>"), F.lit(1))


def field_path(c: Column, path: str) -> Column:
    """The value under a dotted path of a JSON text, as a string; null where a step is missing, null or no object."""
    return F.get_json_object(c, "$." + path)


def ppl_label(c: Column) -> Column:
    """Name of a perplexity's range; null of null."""
    return F.when(c < 60, "low").when(c < 150, "medium").when(c < 400, "high").when(c.isNotNull(), "very high")


def log_bar(c: Column, scale: int = 8, longest: int = 40) -> Column:
    """Length of a bar on a logarithmic scale; null of null."""
    return F.when(c.isNotNull(), F.least(F.floor(F.log10(F.greatest(c, F.lit(1.0))) * scale), F.lit(longest)).cast("int"))


def stream_content(c: Column) -> Column:
    """The joined content of the events of a server-sent stream, up to the first that says stop.

    Only lines with `data: ` count; the end mark and lines that aren't JSON are skipped.
    """
    events = F.filter(F.split(c, "\n"), lambda x: x.startswith("data: ") & (x != "data: [DONE]"))
    bodies = F.transform(events, lambda x: F.substring(x, 7, 1 << 30))
    stops = F.transform(bodies, lambda x: F.get_json_object(x, "$.stop") == "true")
    first = F.array_position(F.transform(stops, lambda s: F.coalesce(s, F.lit(False))), True)
    kept = F.when(first > 0, F.slice(bodies, 1, first.cast("int"))).otherwise(bodies)
    return F.array_join(F.transform(kept, lambda x: F.coalesce(F.get_json_object(x, "$.content"), F.lit(""))), "")


def article_word(word: Column, gender: Column, initial: Column, kind: str) -> Column:
    """An Italian noun with its article: gender m or f, initial v (vowel) or c; kind is indef, def, del or al."""
    vowel, female = initial == "v", gender == "f"
    if kind == "indef":
        return F.concat(F.when(female & vowel, "un'").when(female, "una ").otherwise("un "), word)
    forms = {"def": ("l'", "la ", "il "), "del": ("dell'", "della ", "del "), "al": ("all'", "alla ", "al ")}[kind]
    return F.concat(F.when(vowel, forms[0]).when(female, forms[1]).otherwise(forms[2]), word)
