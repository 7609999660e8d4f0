"""Normalisers for loosely typed product columns.

Each takes a column together with its Spark type and picks the expression from
the type, once, when the plan is built: rows are never inspected in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import tables
from larder.functions.literals import json_of_literal
from larder.functions.text import fold_accents, literal_map, once, strip, tokens

LANGUAGE_PREFIX = "^[a-z]{2}:"
QUOTED_ITEM = "'([^']+)'|\"([^\"]+)\""

# scheme, authority, path, query, fragment of a URL (groups 2, 4, 5, 7, 9)
URL_PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


@dataclass(frozen=True)
class Site:
    """Where product pages and pictures live; set this to your own catalog's hosts."""

    host: str = "ca.catalog.example"
    domain: str = "catalog.example"
    image_base: str = "https://images.catalog.example/images/products"


def empty_list() -> Column:
    return F.array().cast("array<string>")


def list_value(value: Column, kind: T.DataType) -> Column:
    """Any list-like column as ``array<string>`` (never NULL)."""
    unprefixed = lambda item: F.regexp_replace(item.cast("string"), LANGUAGE_PREFIX, "")
    if isinstance(kind, T.ArrayType):
        kept = F.filter(value, lambda item: item.isNotNull())
        return F.coalesce(F.transform(kept, unprefixed), empty_list())
    if isinstance(kind, T.NullType):
        return empty_list()
    if not isinstance(kind, T.StringType):
        return F.when(value.isNull(), empty_list()).otherwise(F.array(value.cast("string")))
    quoted = F.transform(
        tokens(value, QUOTED_ITEM), lambda item: F.substring(item, F.lit(2), F.length(item) - 2)
    )
    parts = F.filter(F.transform(F.split(value, ","), strip), lambda part: part != "")
    bracketed = value.startswith("[") & value.endswith("]") & F.regexp_like(value, F.lit(QUOTED_ITEM))
    return (
        F.when(value.isNull() | (strip(value) == ""), empty_list())
        .when(bracketed, F.transform(quoted, unprefixed))
        .otherwise(parts)
    )


def _first_filled(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(1))


def _entry_text(entry: Column) -> Column:
    """Text of a ``{text, lang, ...}`` map: its ``text``, else its first filled value."""
    values = F.concat(F.array(F.try_element_at(entry, F.lit("text"))), F.map_values(entry))
    return _first_filled(F.transform(values, strip))


def _preferred_text(entries: Column, language, own_text, any_text) -> Column:
    """Own text in the first preferred language that has one, else the first filled text.

    ``entries`` become (language place, position, text); the smallest wins.
    """
    places = literal_map({lang: i for i, lang in enumerate(tables.TEXT_LANGUAGES)})

    def placed(entry: Column, at: Column) -> Column:
        place = F.when(F.coalesce(own_text(entry), F.lit("")) != "", F.try_element_at(places, language(entry)))
        return F.struct(
            F.coalesce(place, F.lit(len(tables.TEXT_LANGUAGES))).alias("place"), at.alias("at"),
            any_text(entry).alias("text"),
        )

    filled = F.filter(F.transform(entries, placed), lambda e: F.coalesce(e["text"], F.lit("")) != "")
    return F.array_min(filled)["text"]


def _written_text(value: Column) -> Column:
    """Text inside a list or dictionary written out as a Python literal, such as ``[{'lang': 'en', 'text': 'x'}]``."""
    as_map = lambda item: F.from_json(item, "map<string,string>")
    get = lambda name: (lambda entry: F.try_element_at(entry, F.lit(name)))

    def text_of(json: Column) -> Column:
        # A plain item of the list counts as an entry without a language.
        entries = F.transform(
            F.filter(F.from_json(json, "array<string>"), lambda item: item.isNotNull()),
            lambda item: F.when(item.startswith("{"), as_map(item)).otherwise(F.create_map(F.lit(""), item)),
        )
        listed = _preferred_text(entries, get("lang"), lambda e: strip(get("text")(e)), _entry_text)
        return F.when(json.startswith("{"), _entry_text(as_map(json))).when(json.startswith("["), listed)

    written = F.when(F.regexp_like(value, F.lit(r"^[\[{]")), json_of_literal(value, texts_only=True))
    return once(written, text_of)


def text_value(value: Column, kind: T.DataType) -> Column:
    """Any text-like column as trimmed text, NULL when there is none."""
    if isinstance(kind, T.StringType):
        stripped = F.nullif(strip(value), F.lit(""))
        return once(stripped, lambda text: F.coalesce(_written_text(text), text))
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        ordered = (["text"] if "text" in names else []) + [n for n in names if n != "text"]
        return F.coalesce(*[text_value(value[n], kind[n].dataType) for n in ordered])
    if isinstance(kind, T.MapType):
        return _entry_text(value.cast("map<string,string>"))
    if isinstance(kind, T.ArrayType):
        entries = F.filter(value, lambda entry: entry.isNotNull())
        text = lambda entry: text_value(entry, kind.elementType)
        own = kind.elementType
        if isinstance(own, T.StructType) and {"lang", "text"} <= set(own.fieldNames()):
            own_text = lambda entry: text_value(entry["text"], own["text"].dataType)
            return _preferred_text(entries, lambda entry: entry["lang"], own_text, text)
        return _first_filled(F.transform(entries, text))
    return F.lit(None).cast("string")


def grade_of(text: Column) -> Column:
    grade = F.lower(text)
    return F.when(~grade.isin(tables.BLANK_GRADES), grade)


def grade_value(value: Column, kind: T.DataType) -> Column:
    return grade_of(text_value(value, kind))


def canonical_nutrient(name: Column) -> Column:
    return F.when(name == "fibre_100g", F.lit("fiber_100g")).otherwise(F.replace(name, F.lit("-"), F.lit("_")))


def nutrient_map(values: Column) -> Column:
    """A nutrient map with canonical names added and non-numeric values dropped."""
    numbers = F.filter(
        F.transform(
            F.map_entries(values),
            lambda e: F.struct(
                e["key"].alias("name"), canonical_nutrient(e["key"]).alias("canonical"),
                e["value"].try_cast("double").alias("amount"),
            ),
        ),
        lambda e: e["amount"].isNotNull(),
    )
    names = F.array_distinct(F.flatten(F.transform(numbers, lambda e: F.array(e["name"], e["canonical"]))))
    last = lambda name: F.element_at(
        F.filter(numbers, lambda e: (e["name"] == name) | (e["canonical"] == name)), -1
    )["amount"]
    return F.map_from_arrays(names, F.transform(names, last))


def nutrient_amount(nutrients: Column, name: Column) -> Column:
    """Look a nutrient up under its canonical name, then under its other spellings."""
    canonical = canonical_nutrient(name)
    other = literal_spelling(canonical)
    return F.coalesce(F.try_element_at(nutrients, canonical), F.try_element_at(nutrients, other))


def literal_spelling(canonical: Column) -> Column:
    choice = canonical
    for name, spellings in tables.NUTRIENT_SPELLINGS.items():
        if len(spellings) > 1:
            choice = F.when(canonical == name, F.lit(spellings[1])).otherwise(choice)
    return choice


def additive_codes(value: Column, kind: T.DataType) -> Column:
    return F.transform(list_value(value, kind), lambda a: F.replace(F.upper(a), F.lit("EN:"), F.lit("")))


def slug(name: Column) -> Column:
    ascii_only = F.regexp_replace(fold_accents(name), r"[^\x00-\x7F]", "")
    words = tokens(F.lower(ascii_only), "[a-z0-9]+")
    return F.array_join(F.slice(words, 1, 16), "-")


def page_url(code: Column, name: Column, site: Site) -> Column:
    """Canonical page of a product; empty without a code."""
    named = F.nullif(slug(name), F.lit(""))
    address = F.concat_ws("/", F.lit(f"https://{site.host}/product"), code, named)
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("")).otherwise(address)


def product_url(raw: Column, code: Column, name: Column, site: Site) -> Column:
    """The raw URL moved to the site's host if it is the site's own, else the canonical page."""
    part = lambda group: F.regexp_extract(raw, URL_PARTS, group)
    own_page = F.when(F.coalesce(code, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("/product/"), code))
    path = F.coalesce(F.nullif(part(5), F.lit("")), own_page)
    tail = lambda sign, group: F.when(part(group) != "", F.concat(F.lit(sign), part(group))).otherwise(F.lit(""))
    moved = F.concat(F.lit(f"https://{site.host}"), path, tail("?", 7), tail("#", 9))
    return F.when(part(4).endswith(site.domain), moved).otherwise(page_url(code, name, site))


def barcode_path(code: Column) -> Column:
    """Folder of a barcode: groups of three digits, the last one of two to four."""
    clean = strip(code)
    grouped = F.regexp_replace(clean, "([0-9]{3})(?=[0-9]{2,})", "$1/")
    return F.when(F.regexp_like(clean, F.lit("^[0-9]{9,}$")), grouped).otherwise(clean)


def _image_entries(images: Column, kind: T.DataType) -> Column:
    """Image lists as array<struct<key, rev, size>>, NULL when there is no list."""
    if isinstance(kind, T.StringType):
        written = "array<struct<key:string,rev:string,sizes:map<string,string>>>"
        kind = T._parse_datatype_string(written)
        return once(F.from_json(json_of_literal(images), written), lambda entries: _image_entries(entries, kind))
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        return F.lit(None).cast("array<struct<key:string,rev:string,size:string>>")
    fields = {f.name: f.dataType for f in kind.elementType.fields}

    def size(entry: Column) -> Column:
        sizes = fields.get("sizes")
        if isinstance(sizes, T.StructType):
            known = next((s for s in tables.IMAGE_SIZES if s in sizes.fieldNames()), "full")
            return F.when(entry["sizes"].isNull(), F.lit("full")).otherwise(F.lit(known))
        if isinstance(sizes, T.MapType):
            choice = F.lit("full")
            for known in reversed(tables.IMAGE_SIZES):
                choice = F.when(F.array_contains(F.map_keys(entry["sizes"]), known), F.lit(known)).otherwise(choice)
            return choice
        return F.lit("full")

    field = lambda entry, name: entry[name].cast("string") if name in fields else F.lit(None).cast("string")
    return F.transform(
        F.filter(images, lambda entry: entry.isNotNull()),
        lambda entry: F.struct(
            field(entry, "key").alias("key"), field(entry, "rev").alias("rev"), size(entry).alias("size")
        ),
    )


def image_url(direct: Column, images: Column, images_kind: T.DataType, code: Column, site: Site) -> Column:
    """The direct picture URL, else one built from the preferred entry of the image list."""
    folder = F.nullif(barcode_path(code), F.lit(""))

    def chosen(entries: Column) -> Column:
        keyed = lambda wanted: F.try_element_at(F.filter(entries, lambda e: e["key"] == wanted), F.lit(1))
        return F.coalesce(*map(keyed, tables.IMAGE_KEYS), F.try_element_at(entries, F.lit(1)))

    def address(entry: Column) -> Column:
        key = F.coalesce(F.nullif(strip(entry["key"]), F.lit("")), F.lit("front"))
        name = F.concat_ws(".", key, entry["rev"], entry["size"], F.lit("jpg"))
        return F.when(entry.isNotNull() & folder.isNotNull(), F.concat_ws("/", F.lit(site.image_base), folder, name))

    built = once(_image_entries(images, images_kind), lambda entries: once(chosen(entries), address))
    return F.coalesce(direct, built, F.lit(""))
