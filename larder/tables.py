"""Word lists, thresholds and limits the results depend on.

Everything here is a FIXED VALUE: changing an entry changes results. The
tables are plain text or literals in their natural order, because order is
part of the meaning (first match, first seen, longest first with ties kept).
"""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return text.split()


def _pairs(text: str) -> list[tuple[str, str]]:
    """Lines of ``left = right`` as a list of pairs, in file order."""
    rows = (line.partition("=") for line in text.strip().splitlines() if line.strip())
    return [(left.strip(), right.strip()) for left, _, right in rows]


# --------------------------------------------------------------------------
# columns
# --------------------------------------------------------------------------

NUTRIENTS = _words("""
proteins_100g sugars_100g energy_kcal_100g fat_100g saturated_fat_100g
carbohydrates_100g sodium_100g salt_100g fiber_100g
""")

# Other column spellings of a nutrient, tried in this order.
NUTRIENT_SPELLINGS = {name: [name] for name in NUTRIENTS} | {
    "energy_kcal_100g": ["energy_kcal_100g", "energy-kcal_100g"],
    "saturated_fat_100g": ["saturated_fat_100g", "saturated-fat_100g"],
    "fiber_100g": ["fiber_100g", "fibre_100g"],
}

# Entry names of a nutrient inside a list-of-struct column.
NUTRIENT_ENTRY_NAMES = {
    "proteins_100g": ["proteins", "protein"],
    "sugars_100g": ["sugars", "sugar"],
    "energy_kcal_100g": ["energy-kcal", "energy_kcal", "energy"],
    "fat_100g": ["fat", "fats"],
    "saturated_fat_100g": ["saturated-fat", "saturated_fat", "saturated fat"],
    "carbohydrates_100g": ["carbohydrates", "carbohydrate", "carbs"],
    "sodium_100g": ["sodium"],
    "salt_100g": ["salt"],
    "fiber_100g": ["fiber", "fibre"],
}

# Candidate columns per logical field when searching; the first that exists wins.
SEARCH_FIELDS = {
    "code": ["code", "id"],
    "product_name": ["product_name", "product_name_en", "product_name_fr"],
    "brands": ["brands"],
    "categories": ["categories", "categories_tags"],
    "categories_tags": ["categories_tags", "categories"],
    "labels": ["labels", "labels_tags"],
    "ingredients_text": ["ingredients_text"],
    "ingredients_tags": ["ingredients_tags"],
    "nutriscore_grade": ["nutriscore_grade", "nutrition_grade_fr"],
    "nova_group": ["nova_group"],
    "ecoscore_grade": ["ecoscore_grade"],
    "image_url": ["image_url", "image_front_url"],
    "images": ["images"],
    "url": ["url"],
    "additives_tags": ["additives_tags"],
    "additives_n": ["additives_n"],
    "unique_scans_n": ["unique_scans_n"],
    "countries_tags": ["countries_tags", "country_tags"],
}

# The same when curating a raw dump.
CURATION_FIELDS = SEARCH_FIELDS | {
    "code": ["code", "_id"],
    "product_name": ["product_name", "product_name_en", "product_name_fr", "generic_name"],
    "labels_tags": ["labels_tags", "labels"],
    "url": ["url", "link"],
    "additives_n": ["additives_n", "new_additives_n"],
    "unique_scans_n": ["unique_scans_n", "scans_n"],
    "countries_tags": ["countries_tags", "main_countries_tags"],
}

# Output columns of curation, in order.
LEAN_COLUMNS = _words("""
code product_name brands categories categories_tags labels labels_tags
ingredients_text ingredients_tags nutriscore_grade nova_group ecoscore_grade
image_url images url additives_tags additives_n unique_scans_n countries_tags
""") + NUTRIENTS

# Columns of the search projection, in order (nutrients follow).
SEARCH_COLUMNS = _words("""
code product_name brands categories labels ingredients_text ingredients_tags
nutriscore_grade nova_group ecoscore_grade image_url images url additives_tags
additives_n unique_scans_n
""")

COUNTRY_TAG = "en:canada"
COUNTRY_WORD = "canada"
CURATED_ROWS = 50_000

BLANK_GRADES = ["", "unknown", "none", "null", "nan", "not applicable", "not-applicable"]
TEXT_LANGUAGES = ["en", "main", "fr"]
IMAGE_KEYS = ["front_en", "front", "front_fr", "front_es"]
IMAGE_SIZES = ["400", "200", "100"]

# --------------------------------------------------------------------------
# labels
# --------------------------------------------------------------------------

# A label text satisfies a dietary tag when it contains one of these.
LABEL_PATTERNS = {
    "vegan": [
        "vegan", "plant-based", "plant based", "vegetalien", "vegetalienne", "vegetaliens",
        "vegetaliennes", "végétalien", "végétalienne", "végétaliens", "végétaliennes", "vegane",
    ],
    "vegetarian": ["vegetarian", "vegetarien", "vegetarienne", "vegetariens"],
    "gluten-free": ["gluten-free", "gluten free", "sans gluten"],
    "organic": ["organic", "bio", "biologique"],
    "dairy-free": [
        "dairy-free", "dairy free", "lactose-free", "lactose free", "sans produits laitiers", "sans lait",
    ],
    "lactose-free": ["lactose-free", "lactose free", "sans lactose"],
    "halal": ["halal"],
    "kosher": ["kosher"],
}

# Accent-free synonyms used when a normalised product is asked for a label.
LABEL_SYNONYMS = {
    "vegan": [
        "vegan", "plant based", "plant-based", "vegetalien", "vegetalienne", "vegetaliens",
        "vegetaliennes", "vegane",
    ],
    "vegetarian": ["vegetarian", "vegetarien", "vegetarienne", "vegetariens"],
    "gluten-free": ["gluten-free", "gluten free", "sans gluten"],
    "organic": ["organic", "bio", "biologique"],
    "dairy-free": ["dairy-free", "dairy free", "sans produits laitiers", "sans lait"],
    "lactose-free": ["lactose-free", "lactose free", "sans lactose"],
    "halal": ["halal"],
    "kosher": ["kosher"],
}

# --------------------------------------------------------------------------
# Language detection and French phrases
# --------------------------------------------------------------------------

FRENCH_HINTS = _words("""
sans avec moins sous
sucre graisse gras proteine proteines fibres sodium sel
faible faibles riche riches pauvre pauvres
vegetalien vegetarien vegetaliens vegetaliennes vegane veganes
collation collations cereale cereales biscuits pates boisson boissons
huile palme chocolat biologique ajoute ajoutee ajoutes
enfants montrez donnez donner encas sain sains saine saines
regime adapte adaptes meilleur meilleure meilleurs meilleures
yaourt yogourt vegetarienne vegetariennes
""")

TYPOS = _pairs("""
choclates = chocolates
cerals = cereals
""")

FRENCH_PHRASES = _pairs("""
montrez-moi = show me
montrez moi = show me
montre-moi = show me
montre moi = show me
donnez-moi = show me
donnez moi = show me
donner = show
meilleur = best
meilleure = best
meilleurs = best
meilleures = best
cereales = cereals
cereale = cereal
muesli = muesli
chocolat = chocolate
collation = snack
collations = snacks
en-cas = snacks
encas = snacks
biscuit = cookie
biscuits = cookies
yaourt = yogurt
yogourt = yogurt
proteines = protein
proteine = protein
fibres = fibre
fibre = fibre
calorie = calories
sain = healthy
saine = healthy
sains = healthy
saines = healthy
plus sain = healthy
plus saine = healthy
plus sains = healthy
plus saines = healthy
huile de palme = palm oil
sans huile de palme = no palm oil
sans sucre = zero sugar
sans sucre ajoute = zero added sugar
sans sucre ajoutee = zero added sugar
sans sucres ajoutes = zero added sugar
sans sucre ajoutes = zero added sugar
faibles en gras = low fat
faible en gras = low fat
faibles en graisse = low fat
faible en graisse = low fat
moins de gras = low fat
moins gras = low fat
sous = under
faibles en sucre = low sugar
faible en sucre = low sugar
pauvre en sucre = low sugar
faible en sodium = low sodium
faibles en sodium = low sodium
pauvre en sodium = low sodium
pauvres en sodium = low sodium
faible en sel = low salt
faibles en sel = low salt
regime pauvre en sodium = low sodium diet
adapte a un regime pauvre en sodium = low sodium diet
adaptes a un regime pauvre en sodium = low sodium diet
adaptes a une alimentation pauvre en sodium = low sodium diet
adapte a une alimentation pauvre en sodium = low sodium diet
riches en proteines = high protein
riche en proteines = high protein
riches en proteine = high protein
riche en proteine = high protein
riches en fibres = high fibre
riche en fibres = high fibre
riches en fibre = high fibre
riche en fibre = high fibre
vegetalien = vegan
vegetalienne = vegan
vegetaliens = vegan
vegetaliennes = vegan
vegane = vegan
veganes = vegan
vegetarien = vegetarian
vegetarienne = vegetarian
vegetariens = vegetarian
vegetariennes = vegetarian
biologique = organic
biologiques = organic
pour enfants = for kids
pour enfant = for kids
avec = with
boisson = drink
boissons = drinks
pates = pasta
pate = pasta
riz = rice
legume = vegetable
legumes = vegetables
fruit = fruit
fruits = fruits
""")

# Applied after the phrases above, in this order.
FRENCH_NUMERIC_PHRASES = _pairs("""
moins de = under
au moins = at least
plus de = over
""")

# --------------------------------------------------------------------------
# Parser vocabulary
# --------------------------------------------------------------------------

NUTRIENT_WORDS = _pairs("""
protein = proteins_100g
proteins = proteins_100g
calorie = energy_kcal_100g
calories = energy_kcal_100g
kcal = energy_kcal_100g
energy = energy_kcal_100g
fat = fat_100g
fats = fat_100g
saturated fat = saturated_fat_100g
saturated fats = saturated_fat_100g
saturated = saturated_fat_100g
sugar = sugars_100g
sugars = sugars_100g
carb = carbohydrates_100g
carbs = carbohydrates_100g
carbohydrate = carbohydrates_100g
carbohydrates = carbohydrates_100g
sodium = sodium_100g
salt = salt_100g
fiber = fiber_100g
fibre = fiber_100g
""")

DIETARY_WORDS = _pairs("""
vegan = vegan
plant based = vegan
plant-based = vegan
vegetalien = vegan
vegetalienne = vegan
vegetaliens = vegan
vegetaliennes = vegan
vegane = vegan
veganes = vegan
vegetarian = vegetarian
vegetarien = vegetarian
vegetarienne = vegetarian
vegetariens = vegetarian
vegetariennes = vegetarian
gluten free = gluten-free
gluten-free = gluten-free
sans gluten = gluten-free
organic = organic
bio = organic
biologique = organic
dairy free = dairy-free
dairy-free = dairy-free
sans produits laitiers = dairy-free
sans lait = dairy-free
lactose free = lactose-free
lactose-free = lactose-free
sans lactose = lactose-free
halal = halal
kosher = kosher
""")

CATEGORY_WORDS = _pairs("""
snack = snacks
snacks = snacks
healthy snack = snacks
cereal = cereals
cereals = cereals
cerals = cereals
muesli = cereals
breakfast cereal = cereals
granola = cereals
bar = snack-bars
bars = snack-bars
beverage = beverages
beverages = beverages
drink = beverages
drinks = beverages
juice = juices
yogurt = dairy
yoghurt = dairy
yaourt = dairy
yogourt = dairy
dairy = dairy
milk = dairy
cheese = dairy
bread = breads
breads = breads
chocolate = chocolates
chocolates = chocolates
choclates = chocolates
choco = chocolates
candies = candies
sweet = candies
cookie = cookies
cookies = cookies
biscuit = cookies
biscuits = cookies
boisson = beverages
boissons = beverages
pate = pastas
pates = pastas
chip = chips
chips = chips
crisps = chips
cracker = crackers
crackers = crackers
pasta = pastas
noodle = pastas
noodles = pastas
rice = rices
sauce = sauces
dressing = sauces
spread = spreads
ready meal = prepared-meals
ready meals = prepared-meals
prepared meal = prepared-meals
prepared meals = prepared-meals
plat prepare = prepared-meals
plats prepares = prepared-meals
jam = spreads
peanut butter = spreads
butter = spreads
olive oils = olive-oils
olive oil = olive-oils
oil = oils
meat = meats
fish = fishes
seafood = fishes
vegetable = vegetables
fruit = fruits
""")

# descriptor, nutrient, operator, bound per 100 g
QUALITY_BOUNDS = [
    ("high", "proteins_100g", ">=", 10.0),
    ("high", "fiber_100g", ">=", 6.0),
    ("high", "energy_kcal_100g", ">=", 800.0),
    ("high", "fat_100g", ">=", 17.5),
    ("high", "sugars_100g", ">=", 22.5),
    ("high", "sodium_100g", ">=", 0.6),
    ("low", "proteins_100g", "<=", 3.0),
    ("low", "fiber_100g", "<=", 2.0),
    ("low", "energy_kcal_100g", "<=", 400.0),
    ("low", "fat_100g", "<=", 3.0),
    ("low", "sugars_100g", "<=", 5.0),
    ("low", "sodium_100g", "<=", 0.1),
    ("low", "saturated_fat_100g", "<=", 1.5),
    ("less", "proteins_100g", "<=", 3.0),
    ("less", "fiber_100g", "<=", 2.0),
    ("less", "energy_kcal_100g", "<=", 400.0),
    ("less", "fat_100g", "<=", 3.0),
    ("less", "sugars_100g", "<=", 5.0),
    ("less", "sodium_100g", "<=", 0.1),
    ("less", "saturated_fat_100g", "<=", 1.5),
]
LOW_SODIUM_DIETS = ["low sodium diet", "low salt diet"]
LOW_SODIUM_DIET_BOUND = 0.12
ZERO_SUGAR_BOUND = 0.5

PREFERENCE_WORDS = _pairs("""
healthy = healthy
healthiest = healthy
nutritious = healthy
clean = healthy
better for you = healthy
for kids = kids
kid friendly = kids
kid-friendly = kids
kids = kids
children = kids
""")

EXCLUSION_PATTERNS = _pairs(r"""
(?:no|without|free\s+from)\s+palm\s+oil = palm oil
(?:no|without|free\s+from)\s+soy = soy
(?:no|without|free\s+from)\s+dairy = dairy
(?:no|without|free\s+from)\s+gluten = gluten
(?:0|zero|no|none|without|free\s+from)\s+added\s+sugar = added sugar
""")
ZERO_SUGAR_PATTERN = r"(?:0|zero|no|none)\s+sugar"

COMPARISON_PATTERNS = [
    r"(?:healthier\s+)?alternative\s+to\s+(.+?)(?:\s*$|[,.])",
    r"instead\s+of\s+(.+?)(?:\s*$|[,.])",
    r"replace\s+(.+?)(?:\s+with\s+|\s*$|[,.])",
]

_NUTRIENT_ALTERNATION = "|".join(sorted((w for w, _ in NUTRIENT_WORDS), key=len, reverse=True))
_NUMBER = r"(\d+(?:\.\d+)?)"
_UNIT = r"\s*(?:g|mg|kcal|cal)?\s*"

# pattern, operator, group of the amount, group of the nutrient word
DIRECTED_BOUND_PATTERNS = [
    (rf"(under|less than|below|at most|max(?:imum)?|<=?)\s*{_NUMBER}{_UNIT}((?:of|de)\s+)?({_NUTRIENT_ALTERNATION})",
     "<=", 2, 4),
    (rf"({_NUTRIENT_ALTERNATION})\s*(?:(?:of|de)\s+)?{_NUMBER}{_UNIT}(or less|or under|max(?:imum)?|and under|<=?)",
     "<=", 2, 1),
    (rf"(over|more than|above|at least|min(?:imum)?|>=?)\s*{_NUMBER}{_UNIT}((?:of|de)\s+)?({_NUTRIENT_ALTERNATION})",
     ">=", 2, 4),
    (rf"({_NUTRIENT_ALTERNATION})\s*(?:(?:of|de)\s+)?{_NUMBER}{_UNIT}(or more|or over|min(?:imum)?|and over|>=?)",
     ">=", 2, 1),
]
BARE_BOUND_PATTERN = rf"{_NUMBER}\s*(kcal|cal(?:ories)?|g|mg)\s+(?:(?:of|de)\s+)?({_NUTRIENT_ALTERNATION})"
BARE_CALORIE_PATTERN = rf"{_NUMBER}\s*(kcal|cal(?:ories)?)"
UNIT_PATTERN = r"\b(mg|g|kcal|cal(?:ories)?)\b"

MORE_IS_ASKED = ["proteins_100g", "fiber_100g"]

UNIT_TOKENS = _words("g mg kcal cal")

STOP_WORDS = _words("""
show me find best top foods food product products suitable that are also for diet
a an the with and or to of under over below above less than more at least most
maximum minimum per 100g 100ml healthy healthiest kids kid children
high low rich light lite zero no without free plus extra ultra super lower higher
reduced added good source excellent
i im am in on it its is be been was were do does did have has had will would can
could should may might my get got give want need like go going looking searching
search suggest suggested recommend recommended tell know help which please just
really very quite some any all not from out up
meilleur meilleure meilleurs meilleures
montrez montre moi des du de la le les un une et ou avec
adapte adaptee adaptees adaptes regime pauvre alimentaire
""")

CATEGORY_TAGS = dict(_pairs("""
chips = en:chips
chip = en:chips
crisps = en:chips
crisps and chips = en:chips
protein bars = en:protein-bars
protein bar = en:protein-bars
bars = en:snack-bars
bar = en:snack-bars
snack bars = en:snack-bars
snack bar = en:snack-bars
cereal = en:breakfast-cereals
cereals = en:breakfast-cereals
kids cereal = en:breakfast-cereals
energy drinks = en:energy-drinks
energy drink = en:energy-drinks
snacks = en:salty-snacks
snack = en:salty-snacks
crackers = en:crackers
cookies = en:cookies
cookie = en:cookies
prepared-meals = en:prepared-meals
ready meals = en:prepared-meals
ready meal = en:prepared-meals
soups = en:soups
soup = en:soups
"""))

# Short nutrient names of summaries and filters.
NUTRIENT_NAMES = dict(_pairs("""
proteins_100g = protein
energy_kcal_100g = calories
sugars_100g = sugar
sodium_100g = sodium
fat_100g = fat
saturated_fat_100g = saturated_fat
fiber_100g = fiber
carbohydrates_100g = carbohydrates
salt_100g = salt
"""))

# --------------------------------------------------------------------------
# Health profile and quality score
# --------------------------------------------------------------------------

GRADES = ["a", "b", "c", "d", "e"]
GRADE_INSIGHT = {"a": 4, "b": 3, "c": 2, "d": 1, "e": 0}
GRADE_QUALITY = {"a": 5.0, "b": 4.0, "c": 3.0, "d": 2.0, "e": 1.0}
GRADE_BONUS = {"a": 15.0, "b": 10.0, "c": 5.0, "d": 2.0, "e": 0.0}
NOVA_PENALTY = {3: 1, 4: 2}
NOVA_RISK = {4: "Ultra-processed (NOVA 4)", 3: "Processed food (NOVA 3)"}
NOVA_POSITIVE = {1: "Minimally processed (NOVA 1)"}

HIGH_LEVELS = [
    ("sodium_100g", 0.6, "High sodium"),
    ("salt_100g", 1.5, "High salt"),
    ("sugars_100g", 22.5, "High sugar"),
    ("fat_100g", 17.5, "High fat"),
    ("saturated_fat_100g", 5.0, "High saturated fat"),
    ("energy_kcal_100g", 400.0, "High calorie density"),
]
GOOD_LEVELS = [
    ("proteins_100g", 10.0, "High protein"),
    ("fiber_100g", 6.0, "High fibre"),
]
RISKY_ADDITIVES = _words("""
E102 E110 E122 E124 E129 E211 E212 E213 E320 E321 E621 E950 E951 E952 E954 E955 E471 E472
""")
GOOD_LABELS = ["organic", "no-additives", "no-preservatives"]
CLASS_FLOORS = [(7, "Excellent"), (5, "Good"), (3, "Moderate")]
LOWEST_CLASS = "Risky"
CLASS_BONUS = {"Excellent": 10.0, "Good": 7.0, "Moderate": 3.0}

# nutrient, level still worth full points, level worth none
PENALISED_LEVELS = [
    ("sodium_100g", 0.6, 1.5),
    ("sugars_100g", 22.5, 45.0),
    ("fat_100g", 17.5, 35.0),
    ("saturated_fat_100g", 5.0, 10.0),
]
REWARDED_LEVELS = [("proteins_100g", 10.0), ("fiber_100g", 6.0)]

# nutrient, good level, cut-off, most points
HEALTHY_LOW_RAMPS = [
    ("sodium_100g", 0.12, 0.6, 3.0),
    ("sugars_100g", 5.0, 22.5, 2.5),
    ("energy_kcal_100g", 250.0, 450.0, 1.5),
]
HEALTHY_HIGH_RAMPS = [
    ("proteins_100g", 5.0, 15.0, 2.5),
    ("fiber_100g", 3.0, 8.0, 2.0),
]
KIDS_SUGAR_RAMP = (3.0, 15.0, 8.0)
SWEET_CATEGORIES = ["candies", "chocolates", "cookies"]

# Nutrients compared between two products and their names in the text. The
# order of each list is alphabetical.
LESS_IS_BETTER = [
    ("energy_kcal_100g", "energy kcal"),
    ("fat_100g", "fat"),
    ("salt_100g", "salt"),
    ("saturated_fat_100g", "saturated fat"),
    ("sodium_100g", "sodium"),
    ("sugars_100g", "sugars"),
]
MORE_IS_BETTER = [("fiber_100g", "fiber"), ("proteins_100g", "proteins")]

# --------------------------------------------------------------------------
# limits
# --------------------------------------------------------------------------

CANDIDATE_ROWS = 50
CATEGORY_POOL_ROWS = 250
RECOMMENDED_ROWS = 5
RESULT_ROWS = 10
POOL_FACTOR = 5
KEYWORDS_USED = 3
KEYWORD_MIN_LENGTH = 3
RELAX_PASSES = 2
MIN_GAIN = 1.05
PRESERVED_NOTE = "semantic constraints preserved (no keyword/tag/category removal)"
