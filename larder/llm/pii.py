"""Personal data: candidate spans, boosted trees over their format and context, calibrated thresholds.

Two sets of generators propose spans. The strict ones have a fixed format and a
check (parts of an address, digit counts, check digits) and always stay. The
loose ones take in what people write to get around such formats: spelled-out
signs in addresses, phone numbers without a plus, digits grouped in odd ways.
Trees are boosted on all documents to tell personal data in such forms from
what else the loose formats catch. The documents' strict spans, rewritten in the
loose forms at their place, are the examples; the counterexamples are numbers
and signs put into neutral places, and candidates that lie in data of another
kind or inside a word. A threshold per kind is then set on examples the trees
have not seen. A loose span stays if it reaches its threshold and overlaps no
strict span.

All of it is built-in expressions: the fitted trees become nested conditions,
so scoring needs no shuffle and no Python. Examples with equal features are
counted inside each task: only different ones, with their counts, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import query, read
from larder.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH = 6, 3
PRECISION = 0.98  # of a kind's spans above its threshold, on the examples that fit no tree
LEAST_SPANS = 20  # spans that must be above a threshold for it to count
CONTEXT = 24  # letters before a span that are looked at

# Strict formats. Looking back keeps a search that fails from starting again at every letter of a long run, and
# possessive quantifiers from going back into it; what is found is the same as without.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?: ?[.,] ?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,5}+\) ?|00)?[0-9](?:[\x20./-]?+[0-9]){6,14}+(?![0-9])",
}
# Words that stand before such data.
HINTS = r"(?i)(mail|contact|phone|tel|call|fax|mobile|card|credit|visa|iban|account|address|host|server|login)"

_SPANS = "array<struct<start:int,end:int,value:string>>"

FEATURES = ("length", "digits", "letters", "separators", "groups", "different", "hint", "word_before", "word_after", "signs", "valid")


def _found(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in letters, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.zip_with(values, F.slice(between, F.lit(1), F.size(values)), lambda v, b: F.struct(v.alias("value"), F.length(b).alias("gap")))
    empty = F.array().cast(_SPANS)
    placed = F.aggregate(
        step, F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
            ))).alias("spans")),
        lambda acc: acc["spans"])
    return F.when(F.size(values) > 0, placed).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a number is right."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    return F.length(digits).between(9, 15)


def strict_spans(text: Column, kind: str) -> Column:
    """The spans of one kind that have the strict format and pass its check."""
    sign = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    found = F.filter(_found(text, STRICT[kind]), lambda s: _valid(kind, s["value"]))
    return found if sign is None else F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(_SPANS))


def _features(kind: str, text: Column, span: Column) -> dict[str, Column]:
    value = span["value"]
    valid = _valid(kind, F.regexp_replace(F.regexp_replace(value, " ", ""), ",", ".") if kind == "ip" else value)
    only = lambda pattern: F.length(F.regexp_replace(value, pattern, "")).cast("double")
    before = F.substring(text, F.greatest(span["start"] + 1 - CONTEXT, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    return {
        "length": F.length(value).cast("double"), "digits": only("[^0-9]"), "letters": only("[^A-Za-z]"), "separators": only(r"[^ .,/()_-]"),
        "groups": F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double"),
        "different": F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        "hint": before.rlike(HINTS).cast("double"), "word_before": before.rlike(r"[0-9A-Za-z]$").cast("double"),
        "word_after": after.rlike(r"^[0-9A-Za-z]").cast("double"), "signs": only(r"[^@\[\]{}(]"),
        "valid": valid.cast("double"),
    }


def _variants(kind: str, value: Column) -> list[Column]:
    """A strict span's value in loose forms."""
    digits = _digits(value)
    if kind == "email":
        at = lambda sign, dot: F.concat(F.substring_index(value, "@", 1), F.lit(sign), F.replace(F.substring_index(value, "@", -1), F.lit("."), F.lit(dot)))
        return [at(" (at) ", " (dot) "), at("[at]", "[dot]"), at(" {at} ", "."), at(" @ ", " . ")]
    if kind == "ip":
        return [F.replace(value, F.lit("."), F.lit(sign)) for sign in (", ", ",", " . ")]
    if kind == "card":
        return [F.regexp_replace(digits, f"([0-9]{{{size}}})(?=[0-9])", f"$1{sign}") for size, sign in ((4, "."), (4, " - "), (2, "/"), (5, "_"))]
    plain = F.replace(value, F.lit("+"), F.lit(""))
    return [plain, F.concat(F.lit("00"), plain), F.concat(F.lit("00"), digits), F.regexp_replace(digits, "([0-9]{3})(?=[0-9]{2})", "$1/")]


def _neutral(text: Column) -> Column:
    """(before, value, after) of a number or sign that is no personal data, put after some word of a text."""
    hashed = F.xxhash64(text)
    digits = F.lpad(F.abs(hashed).cast("string"), 19, "7")
    part = lambda start, size: F.substring(digits, start, size)
    words = F.split(text, r"\s+")
    place = F.pmod(hashed, F.size(words)).cast("int") + 1
    word = F.concat(F.lit("x"), F.regexp_replace(F.element_at(words, place), "[^A-Za-z0-9]", ""))
    forms = [
        F.concat(F.lit("20"), part(1, 2), F.lit("-"), part(3, 2), F.lit("-"), part(5, 2)), part(1, 10), part(1, 16), part(2, 8),
        F.concat(part(1, 1), F.lit("."), part(2, 3), F.lit("."), part(5, 3)), F.concat_ws(", ", *[part(k, 2) for k in (1, 3, 5, 7)]),
        F.concat_ws(",", *[part(k, 3) for k in (1, 4, 7, 10)]), F.concat_ws("/", *[part(k, 4) for k in (1, 5, 9, 13)]), F.concat(word, F.lit(" @ "), word, F.lit(". "), word),
    ]
    before = F.concat(F.array_join(F.slice(words, F.greatest(place - 3, F.lit(1)), F.least(place, F.lit(4))), " "), F.lit(" "))
    value = F.element_at(F.array(*forms), (F.pmod(F.xxhash64(text, F.lit(1)), F.lit(len(forms))) + 1).cast("int"))
    after = F.concat(F.lit(" "), F.coalesce(F.try_element_at(words, place + 1), F.lit("")))
    return F.struct(before.alias("before"), value.alias("value"), after.alias("after"))


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _snippets(kind: str) -> Column:
    """(kind, label, order, natural, before, value, after) of each example of a kind that a row of ``_spans`` gives."""
    text, x = F.col("_text"), F.col("_neutral")
    row = lambda label, natural, order, before, value, after: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(label).alias("label"), order.alias("order"), F.lit(natural).alias("natural"),
        before.alias("before"), value.alias("value"), after.alias("after"))
    before = lambda s: F.substring(text, F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    after = lambda s: F.substring(text, s["end"] + 1, F.lit(CONTEXT))
    order = lambda s: F.xxhash64(text, s["start"])  # noqa: E731  all forms of a span are on one side
    forms = F.flatten(F.transform(kind, lambda s: F.transform(F.array(*_variants(kind, s["value"])), lambda v: row(1.0, False, order(s), before(s), v, after(s)))))
    plain = ~x["before"].rlike(HINTS) & ~x["before"].rlike("[0-9@+]")
    neutral = F.filter(F.array(row(0.0, False, F.xxhash64(text), x["before"], x["value"], x["after"])), lambda _: plain)
    others = F.concat(*[k for k in KINDS if k != kind])
    inside = lambda s: F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)).rlike("[0-9A-Za-z]")
    wrong = F.filter(f"loose_{kind}", lambda s: ~F.exists(kind, lambda t: _meets(t, s)) & (inside(s) | F.exists(others, lambda t: _meets(t, s))))
    return F.concat(forms, neutral, F.transform(wrong, lambda s: row(0.0, True, order(s), before(s), s["value"], after(s))))


def _by_kind(made: Callable[[str], Column]) -> Column:
    """What ``made`` gives for the kind that ``kind`` is the number of."""
    return reduce(lambda found, k: found.when(F.col("kind") == KINDS.index(k), made(k)), KINDS, F)


def _examples(rows: DataFrame) -> DataFrame:
    """One row per example: its kind, whether it is personal data, and its features.

    A text is searched once, for all kinds; then only the snippets around its examples are.
    """
    cut = rows.withColumn("_neutral", _neutral(F.col("_text"))).select(F.explode(F.concat(*map(_snippets, KINDS))).alias("x")).select("x.*")
    placed = F.struct(F.length("before").alias("start"), (F.length("before") + F.length("value")).alias("end"), F.col("value").alias("value"))
    cut = cut.select("kind", "label", "order", "natural", F.concat("before", "value", "after").alias("_text"), placed.alias("place"))
    loose = _by_kind(lambda k: F.filter(_found(F.col("_text"), LOOSE[k]), lambda s: _meets(s, F.col("place"))))
    found = cut.withColumn("span", F.explode(F.when(F.col("natural"), F.array("place")).otherwise(loose)))
    shared = {n: c for n, c in _features(KINDS[0], F.col("_text"), F.col("span")).items() if n != "valid"}
    valid = _by_kind(lambda k: _features(k, F.col("_text"), F.col("span"))["valid"])
    return found.select(F.col("kind").cast("double").alias("kind"), "label", "order", *[c.alias(n) for n, c in shared.items()], valid.alias("valid"))


def _condition(node, names: list[str], columns: dict[str, Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    below = columns[names[split.featureIndex()]] <= float(split.threshold())
    return F.when(below, _condition(node.leftChild(), names, columns)).otherwise(_condition(node.rightChild(), names, columns))


class Scorer:
    """Fitted trees, and per kind the margin from which a loose span stays (None: never)."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float | None]) -> None:
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def margin(self, kind: str | Column, columns: dict[str, Column]) -> Column:
        code = F.lit(float(KINDS.index(kind))) if isinstance(kind, str) else kind
        all_columns = {"kind": code, **columns}
        return reduce(lambda a, b: a + b, [F.lit(w) * _condition(t, ["kind", *FEATURES], all_columns) for t, w in zip(self.trees, self.weights)])

    def stays(self, kind: str) -> Callable[[Column], Column]:
        return lambda span: self.margin(kind, _features(kind, F.col("_text"), span)) >= self.thresholds[kind]


def counted_examples(documents: DataFrame) -> DataFrame:
    """The different examples of all documents and how many there are of each: (side, kind, label, features, ``rows``)."""
    found = _examples(_spans(documents)).withColumn("side", F.pmod("order", F.lit(2)))
    return found.groupBy("side", "kind", "label", *FEATURES).agg(F.count(F.lit(1)).alias("rows"))


def fit(documents: DataFrame) -> Scorer | None:
    """Boost trees on the examples of all documents; None if a class is missing.

    Half of the examples fit the trees, the other half sets the thresholds.
    """
    rows = cut_lineage(counted_examples(documents))
    fitting, rest = rows.filter("side = 0"), rows.filter("side = 1")
    if fitting.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    vectors = VectorAssembler(inputCols=["kind", *FEATURES], outputCol="features").transform(fitting)
    # What differs is few rows, as the formats bound a value's length; in one order, the sums of every run are the same.
    ordered = vectors.coalesce(1).sortWithinPartitions("kind", *FEATURES, "label").select("features", "label", F.col("rows").cast("double").alias("weight"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7, weightCol="weight").fit(ordered)
    scorer = Scorer([t._call_java("rootNode") for t in model.trees], [float(w) for w in model.treeWeights], {})
    margins = rest.select(F.col("kind"), "label", "rows", scorer.margin(F.col("kind"), {n: F.col(n) for n in FEATURES}).alias("margin"))
    levels = margins.groupBy("kind", "margin").agg(F.sum(F.col("label") * F.col("rows")).alias("good"), F.sum("rows").alias("rows")).collect()  # few: sums of leaves
    for code, kind in enumerate(KINDS):
        good = total = 0
        chosen = None
        for r in sorted((r for r in levels if r["kind"] == code), key=lambda r: -r["margin"]):
            good, total = good + r["good"], total + r["rows"]
            if total >= LEAST_SPANS and good >= PRECISION * total:
                chosen = r["margin"]
        scorer.thresholds[kind] = chosen
    return scorer


def _spans(documents: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """All strict spans and loose candidates of ``text``."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(*[F.col(f"`{c}`").alias(k) for k, c in (names or {}).items()], text.alias("_text"))
    rows = rows.select("*", *[strict_spans(F.col("_text"), k).alias(k) for k in KINDS])
    return rows.select("*", *[_found(F.col("_text"), LOOSE[k]).alias(f"loose_{k}") for k in KINDS])


def _named(kind: str, strict: bool) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(strict).alias("strict"))


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def personal_data(documents: DataFrame, scorer: Scorer | None, keep: list[str] | None = None, name: str = "spans") -> DataFrame:
    """The rows of ``documents(text)`` with ``spans`` (or another ``name``): array of (kind, start, end, strict), by kind, then start.

    Places count letters, the end is not part of the span. A missing text is
    empty and has no spans. A column of that name is replaced; repeated rows
    have the same spans; no rows give no rows.
    """
    names = {f"_keep_{i}": c for i, c in enumerate(documents.columns if keep is None else keep) if c != name}
    rows = _spans(documents, names)
    every = F.concat(*KINDS)
    kept = {}
    for kind in KINDS:
        threshold = scorer.thresholds.get(kind) if scorer else None
        own = F.transform(kind, _named(kind, True))
        if threshold is not None:
            free = F.filter(f"loose_{kind}", lambda s: ~F.exists(every, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
            good = F.filter(free, scorer.stays(kind))
            more = F.transform(good, _named(kind, False))
            own = F.array_sort(F.concat(own, more), lambda a, b: a["start"] - b["start"])
        kept[kind] = own
    return rows.select(*[F.col(k).alias(c) for k, c in names.items()], F.concat(*kept.values()).alias(name))


def redact(documents: DataFrame, scorer: Scorer | None, keep: list[str] | None = None) -> DataFrame:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first kind.

    A missing text stays missing. The other columns are as they were.
    """
    columns = documents.columns if keep is None else keep
    found = personal_data(documents, scorer, keep=columns, name="_spans")
    by_place = F.array_sort("_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col("text")
    begun = F.aggregate(
        by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    clean = F.when(F.size("_spans") > 0, begun).otherwise(text)
    return found.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in columns])


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op2_personal_data")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    found = personal_data(documents, fit(documents), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["strict"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listing(base), 256).alias("base_sha256"), _listing(F.col("spans")).alias("spans"))
