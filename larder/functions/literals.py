"""Lists and dictionaries written out as Python literals, as JSON, by expressions.

A text is cut into tokens, each token becomes its JSON form by itself and its neighbours' kinds, and a stack
of open brackets, folded over the brackets only, says whether they fit. What is not a literal of texts, numbers,
True, False, None, lists, tuples and dictionaries gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import literal_map, once, tokens

_STRING = r"[uU]?'(?:[^'\\\n]++|\\[\s\S])*'|[uU]?\"(?:[^\"\\\n]++|\\[\s\S])*\""
_NUMBER = r"[+-]?(?:\d[\d_]*(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
_TOKEN = rf"{_STRING}|{_NUMBER}|[A-Za-z_]+|\S"  # white space between tokens is passed over
_PIECE = r"[^\\\"\x00-\x1f]+|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\[\s\S]|[^\\]"
_SIMPLE = {'"': '\\"', "\\n": "\\n", "\\r": "\\r", "\\t": "\\t", "\\b": "\\b", "\\f": "\\f", "\\a": "\\u0007", "\\v": "\\u000b", "\\\n": "", "\\'": "'", '\\"': '\\"', "\\\\": "\\\\"}


def _unit(number: Column) -> Column:
    """A 16-bit unit as a JSON escape."""
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(number)), 4, "0"))


def _code_point(number: Column) -> Column:
    above = number - 0x10000
    pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(above, 10)), _unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
    return F.when(number < 0x10000, _unit(number)).otherwise(pair)


def _piece(piece: Column) -> Column:
    """One escape, sign or run of plain letters of a text, as it is written in JSON."""
    hexed = lambda start: F.conv(F.substring(piece, F.lit(start), F.length(piece)), 16, 10).cast("long")
    special = F.coalesce(
        F.try_element_at(literal_map(_SIMPLE), piece),
        F.when(F.regexp_like(piece, F.lit(r"^\\[xuU][0-9a-fA-F]{2,}$")), _code_point(hexed(3))),
        F.when(F.regexp_like(piece, F.lit(r"^\\[0-7]+$")), _unit(F.conv(F.substring(piece, F.lit(2), F.length(piece)), 8, 10).cast("long"))),
        F.when(F.length(piece) > 1, F.concat(F.lit("\\"), piece)),  # an escape without a meaning stays as it is
        _unit(F.ascii(piece).cast("long")),
    )
    return F.when(piece.startswith("\\") | (piece == '"') | (piece < " "), special).otherwise(piece)


def _text_token(token: Column) -> Column:
    start = F.when(F.left(token, F.lit(1)).isin("u", "U"), 3).otherwise(2)
    body = F.substring(token, start, F.length(token) - start)
    plain = ~F.regexp_like(token, F.lit(r"(?s)[\\\x00-\x1f]|^[uU]?'.*\""))
    return F.when(plain, body).otherwise(F.array_join(F.transform(tokens(body, _PIECE), _piece), ""))


def _number_token(token: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(token, "[_+]", ""), r"^(-?)\.", "$10.")
    # A whole number with zeros before it is none, and JSON has none either.
    return F.regexp_replace(F.regexp_replace(plain, r"\.(?=$|[eE])", ".0"), r"^(-?)0+(?=\d+[.eE])", "$1")


def json_of_literal(text: Column, texts_only: bool = False) -> Column:
    """The JSON form of a written-out Python literal, NULL if the text is none.

    Texts that stand side by side are one; tuples are lists; a comma may end a list. With
    ``texts_only``, numbers, True and False become null, as None does: they are no text.
    Bytes, sets, complex numbers and comments are not read.
    """
    words = dict.fromkeys(["True", "False", "None"], "null") if texts_only else {"True": "true", "False": "false", "None": "null"}
    opening, closing, signs = ["[", "(", "{"], ["]", ")", "}"], [",", ":"]

    def kind(token: Column) -> Column:
        """One letter: the sign itself, t for a text, n for a number, w for a word, ? for what is in no literal."""
        return (
            F.when(token.isin(*opening, *closing, *signs), token).when((F.length(token) > 1) & F.right(token, F.lit(1)).isin("'", '"'), F.lit("t"))
            .when(F.regexp_like(token, F.lit(r"^[+-]?\.?\d")), F.lit("n")).when(token.isin(*words), F.lit("w")).otherwise(F.lit("?"))
        )

    def own(token: Column, kind: Column, following: Column) -> Column:
        return (
            F.when(kind == "t", _text_token(token)).when(kind == "w", F.try_element_at(literal_map(words), token))
            .when(kind == "n", F.lit("null") if texts_only else _number_token(token))
            .when((kind == ",") & following.isin(*closing), F.lit(""))  # a comma that ends a list
            .otherwise(F.translate(token, "()", "[]"))
        )

    def quotes(before: Column, kind: Column) -> Column:
        """A text, its parts side by side, is opened at its first part and closed by the next token."""
        return F.when((before == "t") != (kind == "t"), F.lit('"')).otherwise(F.lit(""))

    def written(found: Column, kinds: Column) -> Column:
        at = lambda i: F.coalesce(F.get(kinds, i), F.lit(""))
        parts = F.transform(found, lambda token, i: F.concat(quotes(at(i - 1), at(i)), own(token, at(i), at(i + 1))))
        return F.concat(F.array_join(parts, ""), F.when(at(F.size(kinds) - 1) == "t", F.lit('"')).otherwise(F.lit("")))

    def fits(kinds: Column) -> Column:
        # What is closed by the wrong bracket leaves a mark that nothing takes off the stack.
        step = lambda stack, sign: (
            F.when(sign.isin(*opening), F.concat(stack, sign))
            .when(F.right(stack, F.lit(1)) == F.translate(sign, "])}", "[({"), F.substring(stack, F.lit(1), F.length(stack) - 1))
            .otherwise(F.concat(stack, F.lit("!"))))
        stack = F.aggregate(F.filter(kinds, lambda k: k.isin(*opening, *closing)), F.lit(""), step)
        # A comma after nothing ends no list.
        lonely = F.regexp_like(F.array_join(kinds, ""), F.lit(r"(?:^|[\[({,]),[\])}]"))
        return ~F.array_contains(kinds, "?") & ~lonely & (stack == "")

    def whole(found: Column) -> Column:
        return once(F.transform(found, kind), lambda kinds: F.when(fits(kinds), written(found, kinds)))

    return F.when(F.regexp_like(text, F.lit(r"^\s*[\[{(]")), once(tokens(text, _TOKEN), whole))
