"""Building blocks of the checking SQL, in DuckDB's dialect.

The SQL states the same facts as the library in a plain, row-wise way: regular
expressions per phrase, a nested loop for searching, self-joins for
recommending. It shares only the fixed tables and the test data with it.
"""

from __future__ import annotations

from larder import tables as t
from larder.sources import fixtures


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strs(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def case_map(subject: str, entries: dict, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else v}" for k, v in entries.items())
    return f"CASE {subject} {whens} ELSE {otherwise} END"


def nested(text: str, pairs) -> str:
    """One whole-word replacement after the other."""
    for old, new in pairs:
        text = f"regexp_replace({text}, {lit(chr(92) + 'b' + old + chr(92) + 'b')}, {lit(new)}, 'g')"
    return text


def longest(rows):
    return sorted(rows, key=lambda r: len(r if isinstance(r, str) else r[0]), reverse=True)


def joined(items: str) -> str:
    return f"array_to_string({items}, '|')"


def first_seen(items: str) -> str:
    """Different items in the order they were first seen."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- products --------------------------------------------------------------

CATALOG = f"catalog AS ({fixtures.CATALOG_SQL})"

PRESENT = [n for n in t.NUTRIENTS if n not in ("carbohydrates_100g", "salt_100g")]


def comma_list(column: str) -> str:
    return (f"CASE WHEN {column} IS NULL OR trim({column}) = '' THEN CAST([] AS VARCHAR[]) ELSE "
            f"list_filter(list_transform(string_split({column}, ','), lambda x: trim(x)), lambda x: x <> '') END")


GRADE = (f"CASE WHEN lower(trim(nutriscore_grade)) IN {in_list(t.BLANK_GRADES)} THEN NULL "
         "ELSE lower(trim(nutriscore_grade)) END")

PROD = f"""prod AS (
SELECT code, trim(product_name) AS name, trim(brands) AS brands,
  {comma_list('categories')} AS categories, {comma_list('labels')} AS labels,
  trim(ingredients_text) AS ingredients_text, {GRADE} AS nutriscore, nova_group,
  CASE WHEN additives_n = 0 THEN 0 ELSE additives_n END AS additives_count,
  {', '.join(PRESENT)}, CAST(NULL AS DOUBLE) AS carbohydrates_100g, CAST(NULL AS DOUBLE) AS salt_100g,
  unique_scans_n, countries_tags,
  coalesce(product_name, '') || ' ' || coalesce(brands, '') || ' ' || coalesce(categories, '') || ' '
    || coalesce(ingredients_text, '') AS combined_text,
  coalesce(labels, '') AS label_text, coalesce(ingredients_text, '') || ' ' AS ingredient_filter_text,
  coalesce(categories_tags, '') AS category_filter_text, product_name AS name_text, nutriscore_grade AS raw_grade,
  contains(lower(countries_tags), 'en:canada') AND trim(product_name) <> '' AS is_listed,
  CASE lower(nutriscore_grade) WHEN 'a' THEN 5 WHEN 'b' THEN 4 WHEN 'c' THEN 3 WHEN 'd' THEN 2 WHEN 'e' THEN 1
    ELSE 0 END AS grade_points,
  CASE WHEN nova_group IS NULL THEN 0 ELSE 5 - nova_group END AS nova_points,
  least(coalesce(proteins_100g, 0), 25) * 0.6 - least(coalesce(sugars_100g, 0), 30) * 0.35
    - least(coalesce(sodium_100g, 0), 1.5) * 10
    + CASE WHEN energy_kcal_100g IS NULL THEN 0 WHEN energy_kcal_100g <= 250 THEN 2
        WHEN energy_kcal_100g <= 400 THEN 1 ELSE 0 END AS heuristic
FROM catalog)"""


def order_sql(kids: str = "FALSE", strict: str = "FALSE", alias: str = "") -> str:
    a = alias
    return (
        f"{a}grade_points DESC, {a}nova_points DESC, {a}heuristic DESC, "
        f"CASE WHEN {kids} THEN coalesce({a}sugars_100g, 9999) END ASC, "
        f"CASE WHEN {strict} THEN coalesce({a}proteins_100g, 0) END DESC, "
        f"CASE WHEN {strict} THEN coalesce({a}fiber_100g, 0) END DESC, "
        f"CASE WHEN {strict} THEN coalesce({a}sugars_100g, 9999) END ASC, "
        f"CASE WHEN {strict} THEN coalesce({a}sodium_100g, 9999) END ASC, "
        f"coalesce({a}unique_scans_n, 0) DESC, {a}name_text ASC, {a}code ASC"
    )


def ramp_down(value: str, good: float, cutoff: float, most: float) -> str:
    return (f"CASE WHEN {value} IS NULL THEN 0.0 WHEN {value} <= {good} THEN {most} WHEN {value} >= {cutoff} THEN 0.0 "
            f"ELSE {most} * (({cutoff} - {value}) / ({cutoff} - {good})) END")


def ramp_up(value: str, least: float, target: float, most: float) -> str:
    return (f"CASE WHEN {value} IS NULL THEN 0.0 WHEN {value} <= {least} THEN 0.0 WHEN {value} >= {target} THEN {most} "
            f"ELSE {most} * (({value} - {least}) / ({target} - {least})) END")


def _nutrient_quality() -> str:
    points = [
        f"(CASE WHEN {n} IS NULL THEN 0.0 WHEN {n} <= {fine} THEN 5.0 WHEN {n} >= {worst} THEN 0.0 "
        f"ELSE 5.0 * ({worst} - {n}) / ({worst} - {fine}) END)"
        for n, fine, worst in t.PENALISED_LEVELS
    ] + [f"(CASE WHEN {n} IS NULL THEN 0.0 ELSE least(5.0, {n} / {enough} * 5.0) END)" for n, enough in t.REWARDED_LEVELS]
    names = [n for n, *_ in t.PENALISED_LEVELS + t.REWARDED_LEVELS]
    count = " + ".join(f"(CASE WHEN {n} IS NULL THEN 0 ELSE 1 END)" for n in names)
    return f"CASE WHEN ({count}) = 0 THEN 2.5 ELSE CAST({' + '.join(points)} AS DOUBLE) / ({count}) END"


QUALITY = f"""quality AS (
SELECT *, CAST({case_map('nutriscore', t.GRADE_QUALITY, '2.5')} AS DOUBLE) * 0.4
  + CASE WHEN nova_group BETWEEN 1 AND 4 THEN (CAST(5 - nova_group AS DOUBLE) / 4) * 5 * 0.25 ELSE 1.25 END
  + greatest(0, (CAST(10 AS DOUBLE) - additives_count) / 10) * 5 * 0.15 + nutrient_quality * 0.2 AS quality
FROM (SELECT *, {_nutrient_quality()} AS nutrient_quality FROM prod))"""


def _insights() -> str:
    grade_line = "'Nutri-Score ' || upper(nutriscore)"
    risks = [
        f"CASE WHEN nutriscore IN ('c','d','e') THEN {grade_line} END",
        "CASE nova_group WHEN 4 THEN 'Ultra-processed (NOVA 4)' WHEN 3 THEN 'Processed food (NOVA 3)' END",
        *[f"CASE WHEN {n} > {limit} THEN {lit(text)} END" for n, limit, text in t.HIGH_LEVELS],
    ]
    positives = [
        f"CASE WHEN nutriscore IN ('a','b') THEN {grade_line} END",
        "CASE nova_group WHEN 1 THEN 'Minimally processed (NOVA 1)' END",
        *[f"CASE WHEN {n} >= {limit} THEN {lit(text)} END" for n, limit, text in t.GOOD_LEVELS],
    ]
    kept = lambda items: f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    good = "list_filter(labels, lambda l: " + " OR ".join(f"contains(l, {lit(g)})" for g in t.GOOD_LABELS) + ")"
    highs = " + ".join(f"CASE WHEN {n} > {limit} THEN 1 ELSE 0 END" for n, limit, _ in t.HIGH_LEVELS)
    goods = " + ".join(f"CASE WHEN {n} >= {limit} THEN 1 ELSE 0 END" for n, limit, _ in t.GOOD_LEVELS)
    # The catalog has no additive tags; labels here are single words or "gluten free".
    return f"""insight AS (
SELECT *, CASE WHEN health_class = 'Excellent' THEN name || ' has an excellent nutritional profile'
    || CASE WHEN len(positives) > 0 THEN ' with ' || lower(positives[1]) ELSE '' END || '.'
  WHEN health_class = 'Good' THEN name || ' is generally a good nutritional choice'
    || CASE WHEN len(risks) > 0 THEN ' though note: ' || lower(risks[1]) ELSE '' END || '.'
  WHEN health_class = 'Moderate' THEN name || ' has moderate nutritional quality due to '
    || CASE WHEN len(risks) > 0 THEN lower(array_to_string(risks[1:2], ', ')) ELSE 'some nutritional concerns' END || '.'
  ELSE name || ' raises health concerns: '
    || CASE WHEN len(risks) > 0 THEN lower(array_to_string(risks[1:3], ', ')) ELSE 'poor nutritional profile' END || '.'
  END AS summary
FROM (SELECT *, CASE WHEN health_score >= 7 THEN 'Excellent' WHEN health_score >= 5 THEN 'Good'
    WHEN health_score >= 3 THEN 'Moderate' ELSE 'Risky' END AS health_class
  FROM (SELECT *, {kept(risks)} AS risks,
    list_concat({kept(positives)}, list_transform({good}, lambda l: 'Labelled: ' || upper(l[1:1]) || lower(l[2:]))) AS positives,
    5 + coalesce({case_map('nutriscore', t.GRADE_INSIGHT)} - 2, 0)
      - CASE nova_group WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END - ({highs}) + ({goods}) + len({good}) AS health_score
    FROM quality)))"""


INSIGHT = _insights()

# ---- query log -------------------------------------------------------------

PHRASES = "phrases AS (SELECT * FROM (VALUES " + ", ".join(
    f"({-1 - i}, {lit(p)})" for i, p in enumerate(fixtures.PHRASES)) + ") AS v(query_id, text))"

QUERY_LOG = f"""{PHRASES},
query_log AS ({fixtures.QUERY_LOG_SQL} UNION ALL SELECT query_id, text FROM phrases),
texts AS (SELECT DISTINCT text FROM query_log)"""


def normalized_sql(text: str, language: str) -> str:
    start = f"trim(regexp_replace(strip_accents(lower({text})), '\\s+', ' ', 'g'))"
    plain = nested(start, t.TYPOS)
    french = nested(plain, longest(t.FRENCH_PHRASES) + t.FRENCH_NUMERIC_PHRASES)
    chosen = f"CASE WHEN {language} = 'fr' THEN {french} ELSE {plain} END"
    return f"trim(regexp_replace(replace(replace({chosen}, '-', ' '), ' ,', ','), '\\s+', ' ', 'g'))"


LANGUAGE = f"""CASE WHEN strip_accents(lower(text)) <> lower(text) OR len(list_distinct(list_filter(
  regexp_extract_all(strip_accents(lower(text)), '[a-zA-Z]+'), lambda x: list_contains({strs(t.FRENCH_HINTS)}, x)))) >= 2
  THEN 'fr' ELSE 'en' END"""

PREPROCESSED = f"""preprocessed AS MATERIALIZED (SELECT *, {normalized_sql('text', 'language')} AS normalized
FROM (SELECT *, {LANGUAGE} AS language FROM texts))"""


def parse_ctes(source: str = "preprocessed", prefix: str = "") -> str:
    """CTEs that read intents from ``source(text, language, normalized)`` into ``{prefix}parsed``."""
    word = case_map("w", dict(t.NUTRIENT_WORDS))
    excluded = "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(normalized, {lit(p)}) THEN {lit(n)} END" for p, n in t.EXCLUSION_PATTERNS
    ) + "], lambda x: x IS NOT NULL)"

    def blank(text: str, name: str, forms: list[str]) -> str:
        pattern = lit("|".join(rf"\b{f}\b" for f in forms))
        return f"regexp_replace({text}, CASE WHEN list_contains(excluded, {lit(name)}) THEN {pattern} ELSE 'ZZZ' END, ' ', 'g')"

    names = [n for _, n in t.EXCLUSION_PATTERNS]
    category_text = "low"
    for n in names:
        category_text = blank(category_text, n, [n])
    words = "|".join(w for w, _ in longest(t.CATEGORY_WORDS))
    category = case_map(f"regexp_extract({category_text}, {lit(rf'(?s)^.*' + chr(92) + 'b(' + words + ')' + chr(92) + 'b')}, 1)",
                        dict(t.CATEGORY_WORDS))
    tag_names = list(dict.fromkeys(tag for _, tag in t.DIETARY_WORDS))
    tags = "list_filter([" + ", ".join(
        "CASE WHEN regexp_matches(low, "
        + lit(r"\b(?:" + "|".join(w for w, c in t.DIETARY_WORDS if c == tag) + r")\b")
        + f") THEN {lit(tag)} END" for tag in tag_names) + "], lambda x: x IS NOT NULL)"
    preferences = "list_filter([" + ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(low, {lit(w)})" for w, k in t.PREFERENCE_WORDS if k == kind)
        + f" THEN {lit(kind)} END" for kind in ("healthy", "kids")) + "], lambda x: x IS NOT NULL)"
    comparison = "coalesce(" + ", ".join(
        f"nullif(regexp_extract(normalized, {lit(p)}, 1), '')" for p in t.COMPARISON_PATTERNS) + ")"

    def family(row) -> str:
        pattern, operator, amount, nutrient = row
        amounts, nutrients = (f"regexp_extract_all(normalized, {lit(pattern)}, {g})" for g in (amount, nutrient))
        return (f"list_transform(list_zip({amounts}, list_transform({nutrients}, lambda w: {word})), "
                f"lambda m: {{'n': m[2], 'o': '{operator}', 'v': CAST(m[1] AS DOUBLE) / unit_divisor}})")

    directed = "list_concat(" + ", ".join(family(r) for r in t.DIRECTED_BOUND_PATTERNS) + ")"
    bare_groups = [f"regexp_extract_all(normalized, {lit(t.BARE_BOUND_PATTERN)}, {g})" for g in (1, 2, 3)]
    bare = (f"list_filter(list_transform(list_zip({bare_groups[0]}, {bare_groups[1]}, list_transform({bare_groups[2]}, "
            f"lambda w: {word})), lambda m: {{'n': m[3], 'o': CASE WHEN m[3] IN {in_list(t.MORE_IS_ASKED)} THEN '>=' "
            f"ELSE '<=' END, 'v': CAST(m[1] AS DOUBLE) / CASE WHEN m[2] = 'mg' THEN 1000.0 ELSE 1.0 END}}), "
            "lambda c: NOT list_contains(list_transform(directed, lambda d: d.n), c.n))")
    kcal = (f"list_transform(regexp_extract_all(normalized, {lit(t.BARE_CALORIE_PATTERN)}, 1), "
            "lambda a: {'n': 'energy_kcal_100g', 'o': '<=', 'v': CAST(a AS DOUBLE)})")
    zero = (f"CASE WHEN regexp_matches(normalized, {lit(t.ZERO_SUGAR_PATTERN)}) "
            "THEN [{'n': 'sugars_100g', 'o': '<=', 'v': CAST(0.5 AS DOUBLE)}] ELSE [] END")
    bound_of = {(d, n): (o, v) for d, n, o, v in t.QUALITY_BOUNDS}
    rows = [(f"{d} {w}", n, *bound_of[d, n]) for d in ("high", "low", "less") for w, n in t.NUTRIENT_WORDS if (d, n) in bound_of]
    quality = "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(low, {lit(chr(92) + 'b' + p + chr(92) + 'b')}) "
        f"THEN {{'n': {lit(n)}, 'o': '{o}', 'v': CAST({v} AS DOUBLE)}} END" for p, n, o, v in rows
    ) + "], lambda c: c IS NOT NULL AND NOT list_contains(list_transform(numeric_bounds, lambda d: d.n), c.n))"
    diet = ("CASE WHEN contains(low, 'low sodium diet') OR contains(low, 'low salt diet') "
            "THEN [{'n': 'sodium_100g', 'o': '<=', 'v': CAST(0.12 AS DOUBLE)}] ELSE [] END")
    categories = dict.fromkeys(c for _, c in t.CATEGORY_WORDS)
    own = case_map("category", {
        c: r"\b(?:" + "|".join(longest(w for w, k in t.CATEGORY_WORDS if k == c)) + r")\b" for c in categories}, "'ZZZ'")
    cleaned = f"regexp_replace(low, {own}, ' ', 'g')"
    for table in (t.DIETARY_WORDS, t.PREFERENCE_WORDS, t.NUTRIENT_WORDS):
        cleaned = nested(cleaned, [(w, " ") for w, _ in longest(table)])
    for n in names:
        cleaned = blank(cleaned, n, [n])
        cleaned = blank(cleaned, n, n.split())
    stop = strs(t.STOP_WORDS + t.UNIT_TOKENS)
    terms = (f"list_concat(list_filter(regexp_extract_all({cleaned}, '[a-z]+'), "
             f"lambda x: len(x) > 1 AND NOT list_contains({stop}, x)), "
             "regexp_extract_all(lower(coalesce(comparison, '')), '[a-z]+'))")
    p = prefix
    return f"""{p}p1 AS (SELECT *, replace(lower(normalized), '-', ' ') AS low, {excluded} AS excluded,
  trim({comparison}) AS comparison,
  CASE WHEN regexp_extract(normalized, {lit(t.UNIT_PATTERN)}, 1) = 'mg' THEN 1000.0 ELSE 1.0 END AS unit_divisor FROM {source}),
{p}p2 AS MATERIALIZED (SELECT *, {category} AS category, {tags} AS raw_tags, {preferences} AS preferences, {directed} AS directed FROM {p}p1),
{p}p3 AS MATERIALIZED (SELECT *, list_concat(directed, {bare}, {kcal}, {zero}) AS numeric_bounds,
  CASE WHEN list_contains(raw_tags, 'vegan') THEN list_filter(raw_tags, lambda x: x <> 'vegetarian') ELSE raw_tags END AS tags,
  {terms} AS all_terms FROM {p}p2),
{p}p4 AS (SELECT *, list_concat(numeric_bounds, {quality}, {diet}) AS all_bounds FROM {p}p3),
{p}parsed AS MATERIALIZED (SELECT *, {first_seen('all_terms')} AS terms, {strictest_sql('all_bounds')} AS cons FROM {p}p4)"""


def strictest_sql(bounds: str) -> str:
    keys = f"list_transform({bounds}, lambda x: x.n || x.o)"
    same = f"list_transform(list_filter({bounds}, lambda x: x.n = k.n AND x.o = k.o), lambda x: x.v)"
    return (f"list_transform(list_filter({bounds}, lambda c, i: list_position({keys}, c.n || c.o) = i), "
            f"lambda k: {{'n': k.n, 'o': k.o, 'v': CASE WHEN k.o LIKE '<%' THEN list_min({same}) ELSE list_max({same}) END}})")


PARSED = f"{QUERY_LOG},\n{PREPROCESSED},\n{parse_ctes()}"


def bounds_text(bounds: str) -> str:
    return joined(f"list_transform({bounds}, lambda c: c.n || c.o || printf('%g', c.v))")
