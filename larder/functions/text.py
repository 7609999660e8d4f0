"""Text expressions: accent folding, whole-phrase matching, number printing."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"

# Marks put around every word, so that "\bphrase\b" becomes a plain substring.
WORD_START, WORD_END = "\u0001", "\u0002"


def literal(value, kind: str) -> Column:
    """A literal list or map. Written as JSON it is one node until Spark folds it,
    where an expression per entry would make every plan slow to build."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def strings(values: Iterable[str]) -> Column:
    """A literal array of strings."""
    return literal(list(values), "array<string>")


def literal_map(entries: dict) -> Column:
    """A literal map from text; values are all strings, all numbers or all lists of strings."""
    kinds = {str: "string", int: "int", float: "double", list: "array<string>"}
    kind = kinds[type(next(iter(entries.values())))] if entries else "string"
    return literal({str(key): value for key, value in entries.items()}, f"map<string,{kind}>")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding by rule, over the basic plane.

    Characters that fold to one character go to a ``translate`` table (combining
    marks to nothing); those that fold to several go to a map.
    """
    source, target, dropped, expanded = [], [], [], {}
    for code in range(0x80, min(0x10000, sys.maxunicode)):
        if 0xAC00 <= code <= 0xDFFF:  # Hangul syllables, surrogates
            continue
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if folded == char:
            continue
        if not folded:
            dropped.append(char)
        elif len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif code < 0x2200 or 0xFB00 <= code < 0xFB07:
            expanded[char] = folded
    return "".join(source + dropped), "".join(target), expanded


def fold_accents(text: Column) -> Column:
    """Remove accents and compatibility forms; plain ASCII text is left as it is."""
    source, target, expanded = _folding()
    several = "[" + "".join(map(re.escape, expanded)) + "]"
    spelled = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(literal_map(expanded), c), c)), ""
    )
    whole = F.when(F.regexp_like(text, F.lit(several)), spelled).otherwise(text)
    return F.when(
        F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), F.translate(whole, source, target)
    ).otherwise(text)


def mark_words(text: Column) -> Column:
    """Put marks around every word of the text."""
    clean = F.translate(text, WORD_START + WORD_END, "  ")
    return F.regexp_replace(clean, r"(?U)(\w+)", f"{WORD_START}$1{WORD_END}")


def unmark(text: Column) -> Column:
    return F.translate(text, WORD_START + WORD_END, "")


def marked(phrase: str) -> str:
    """The same marks for a phrase known to the driver."""
    return re.sub(r"(\w+)", rf"{WORD_START}\1{WORD_END}", phrase)


def swaps(pairs: Iterable[tuple[str, str]]) -> Column:
    """A literal list of phrase replacements for :func:`swap_phrases`."""
    rows = [{"old": marked(old), "new": marked(new)} for old, new in pairs]
    return literal(rows, "array<struct<old:string,new:string>>")


def swap_phrases(marked_text: Column, replacements: Column) -> Column:
    """Replace whole phrases one after the other, in list order."""
    return F.aggregate(replacements, marked_text, lambda text, r: F.replace(text, r["old"], r["new"]))


def drop_phrases(marked_text: Column, marked_phrases: Column) -> Column:
    """Blank out whole phrases one after the other, in list order."""
    return F.aggregate(marked_phrases, marked_text, lambda text, p: F.replace(text, p, F.lit(" ")))


def longest_first(phrases: Iterable) -> list:
    """Longest first, ties in the given order; items are phrases or (phrase, ...) pairs."""
    return sorted(phrases, key=lambda p: len(p if isinstance(p, str) else p[0]), reverse=True)


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value as the only item of a list: it stands in the plan once and is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
