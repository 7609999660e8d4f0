"""The operators on small tables with the cases that usually break, held against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from larder.llm import common, divergence, jaccard, pieces, pii, pitman_yor, repeats, shards, site_quality, tiling, toxicity
from larder.llm.common import FOLDS, ORACLES, QUERIES, sieved
from larder.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, ids string, spans string, kept string"
_random = np.random.default_rng(5)


def prose(words):
    return " ".join(_random.choice(["the", "of", "and", "river", "stone", "Été", "house", "under", "light", "seven", "winter", "a"], words))


LONG = prose(4_000)
BASE = prose(120)
TEXTS = [
    None, "", " \n\t ", "one", "two words", BASE, BASE, BASE + " tail", BASE.replace("river", "lake", 1), LONG, LONG + " end", prose(60) + "\n" + prose(30),
    ("the of " * 40).strip(), "x" * 30_000, "a@b.c _x@d.e mail a.b@c", "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 000255.1.1.1", "4111 1111 1111 1111 and 4111111111111112",
    "+49 (30) 123-456 789 and +1 2", "a@a" + ".a" * 5_000, "  x  y  z <|endoftext|> ▁ é😀\r\n;\r", "**#$ %% " * 30, prose(45) + " " + BASE[:200],
    "you are an idiot. not an idiot!", "same line\nsame line\n\nother",
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], "s" if i % 4 else None, "clash", "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, BASE, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def unnamed(documents):
    return documents.filter("doc_id is not null")


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(text):
    return WORD.findall(text or "")


def test_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} <= set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_rules(documents, nothing):
    got = by_id(divergence.quality_rules(documents))
    for i, text in enumerate(TEXTS):
        w, lines, places = words(text), [x for x in (text or "").split("\n") if words(x)], {}
        for k in range(len(w) - 7):
            places.setdefault(tuple(w[k : k + 8]), []).append(k)
        twice = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice))
        row = got[i]
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])
    assert divergence.quality_rules(nothing).count() == 0
    assert divergence.passing(documents).columns == documents.columns


def test_distance_is_that_of_the_definition():
    shares = np.array([0.5, 0.25, 0.25])
    p, m = np.array([1.0, 0, 0]), np.array([0.75, 0.125, 0.125])
    want = math.sqrt((math.log2(1 / 0.75) + 0.5 * math.log2(0.5 / 0.75) + 2 * 0.25 * math.log2(0.25 / 0.125)) / 2)
    assert math.isclose(divergence._distance(np.array([[4, 0, 0]]), shares)[0], want)
    assert (p + shares == 2 * m).all()


def shingles(text):
    w = words((text or "").translate(ASCII))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.fixture(scope="module")
def copies(spark):
    """Near copies around one text, at every size where light and heavy sets meet."""
    texts, rng = [], np.random.default_rng(11)
    for size in [5, 6, 8, 9, 10, 12, 14, 20, 30, 60]:
        first = [f"w{size}x{k}" for k in range(size)]
        for _ in range(9):
            other = list(first)
            for _ in range(int(rng.integers(0, 1 + size // 12))):
                other[int(rng.integers(0, len(other)))] = f"v{rng.integers(0, 99)}"
            texts.append(" ".join(other[int(rng.integers(0, 2)) :] + [f"t{k}" for k in range(int(rng.integers(0, 2)))]))
    texts = [t for t in texts for _ in range(int(rng.integers(1, 3)))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("rounds", [0, 3])
def test_jaccard_classes(copies, unnamed, nothing, rounds, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    for table in (copies, unnamed) if rounds else (copies,):
        sets = {r["doc_id"]: shingles(r["text"]) for r in table.collect()}
        got, want = by_id(jaccard.jaccard_classes(table)), brute_components(sets)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard.jaccard_classes(nothing).count() == 0


@pytest.fixture(scope="module")
def crowd(spark):
    """Many copies of one text that changed places of their own, some of them passed on with a few more changes; lists are long."""
    rng, texts = np.random.default_rng(5), []
    first = [f"w{k}" for k in range(150)]
    for _ in range(50):
        other = list(first)
        for at in rng.choice(150, 5, replace=False):
            other[at] = f"v{rng.integers(0, 9999)}"
        texts.append(" ".join(other))
        if rng.integers(0, 3) == 0:
            other[int(rng.integers(0, 150))] = "again"
            texts.append(" ".join(other))
    texts += [" ".join([*first[:20], *(f"u{i}x{k}" for k in range(40))]) for i in range(50)]  # a passage that many share
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("short", [0, 40])
def test_jaccard_long_lists(crowd, short, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    asked, rare = [], jaccard._rare_pairs
    monkeypatch.setattr(jaccard, "_rare_pairs", lambda left, *more: asked.append(left.count()) or rare(left, *more))
    sets = {r["doc_id"]: shingles(r["text"]) for r in crowd.collect()}
    got, want = by_id(jaccard.jaccard_classes(crowd)), brute_components(sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert asked[0] > 0 and 1 < len(set(want.values())) < len(want)


def test_sieve_keeps_what_is_wanted(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "x") for k in range(3000)] + [(None, "y")], "doc_id long, text string")
    wanted = spark.createDataFrame([(k,) for k in range(0, 3000, 7)], "doc_id long")
    assert {r["doc_id"] for r in sieved(rows, wanted, "doc_id").collect()} >= set(range(0, 3000, 7))
    assert sieved(rows, wanted, "doc_id").count() < 600
    assert sieved(rows, wanted.limit(0), "doc_id").count() == 0
    monkeypatch.setattr(common, "SIEVE", 64)  # full: everything goes through
    assert sieved(rows, wanted, "doc_id").count() == 3000


def test_one_of_each(documents):
    kept = [r["doc_id"] for r in jaccard.one_of_each(documents).collect()]
    assert {0, 1, 5, 9}.issubset(kept) and not {6, 7, 10} & set(kept) and None in kept


def test_boundary_weighs_both_ways():
    assert jaccard.boundary({2: 100}) >= 2 and jaccard.boundary({30: 100}) < 25 and jaccard.boundary({}) == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (101, 102), (102, 102)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_tiles_are_the_longest_first():
    item, document = np.arange(10, dtype=np.uint64), np.array([90, 5, 6, 7, 8, 9, 91, 0, 1, 2, 3, 4, 0, 1, 2, 3], np.uint64)
    assert tiling.tile(item, document, 4) == [(0, 7, 5), (5, 1, 5)]
    assert tiling.tile(item, document[:4], 4) == [] and tiling.tile(item[:0], document, 4) == []


@pytest.mark.parametrize("block_bytes", [800, 4_000_000])
def test_decontamination(spark, documents, nothing, block_bytes):
    cut = BASE.split()
    items = [(1, BASE), (2, " ".join(cut[60:] + cut[:60]).upper().replace("É", "é")), (3, "one two three four five six seven eight"), (4, None), (5, ""), (None, "idiot not an")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(tiling.decontaminate(documents, benchmark, block_bytes=block_bytes))
    for i in (5, 6, 7, 8):
        assert {1, 2} <= {x["item_id"] for x in got[i]["items"]} and got[i]["contaminated"]
    assert not got[0]["contaminated"] and got[0]["coverage"] == 0 and not got[11]["contaminated"] and not got[13]["contaminated"]
    assert tiling.decontaminate(nothing, benchmark).count() == 0
    assert not tiling.decontaminate(documents, benchmark.limit(0)).filter("contaminated").count()
    assert tiling.uncontaminated(documents, benchmark).columns == documents.columns


def test_seed_pruning_of_periodic_items():
    rng = np.random.default_rng(4)
    phrase = "a b c d e f g h"
    texts = [" ".join([phrase] * 3), " ".join(["x y"] * 9), "one two three four " + " ".join([phrase] * 2), *[" ".join(rng.choice(list("abc"), 14)) for _ in range(60)]]
    block = tiling.Block(list(enumerate(texts)), tiling.MIN_TILE, tiling.COVERAGE)
    items = [w for _, w in block.items]
    for number, item in enumerate(items):
        for document in (item, item[: len(item) // 2 + 1], np.concatenate([item[7:], item[:7]])):
            found = {n for _, n in block.candidates(document, np.zeros(len(document), np.int64))}
            want = {n for n, w in enumerate(items) if 2 * sum(x[2] for x in tiling.tile(w, document)) >= len(w)}
            assert want <= found, (number, want - found)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def private(kind, value):
    digits = re.sub("[^0-9]", "", value)
    luhn = sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(digits))))
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]


def test_personal_data(documents, nothing):
    got = by_id(pii.personal_data(documents, None))
    for i, text in enumerate(TEXTS):
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if private(k, m.group())]
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"]] == want, i
    clean = by_id(pii.redact(documents, None))
    assert clean[0]["text"] is None and clean[14]["text"] == "[email] [email] mail a.b@c" and clean[5]["text"] == BASE
    assert pii.fit(nothing) is None


def test_trees_add_loose_spans(spark):
    rows = [(k, f"call +49 30 {1000000 + k * 7} now" if k % 2 else f"number {k} 12") for k in range(400)]
    table = spark.createDataFrame([*rows, (900, "call 0049 30 1234567 now")], "doc_id long, text string")
    scorer = pii.fit(table)
    found = by_id(pii.personal_data(table, scorer))
    assert all(any(s["strict"] for s in found[k]["spans"]) == bool(k % 2) for k, _ in rows)
    for r in found.values():  # loose spans never overlap strict ones
        strict = [s for s in r["spans"] if s["strict"]]
        assert all(a["end"] <= b["start"] or b["end"] <= a["start"] for a in strict for b in r["spans"] if not b["strict"])


def test_trees_find_rewritten_forms(spark):
    rng = np.random.default_rng(8)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    rows = [(k, f"{prose(6)} mail bob{k}@host{k % 7}.example.org now {prose(5)} phone +49 30 {number(7)} {prose(4)}" if k % 2 else prose(20)) for k in range(600)]
    asked = {900: ("mail amy (at) place (dot) com now", "email"), 901: ("please mail amy[at]place[dot]org", "email"),
             902: ("and phone 49 30 1234567 the house", "phone"), 903: ("the river 20240517 house", None)}
    table = spark.createDataFrame([*rows, *[(i, text) for i, (text, _) in asked.items()]], "doc_id long, text string")
    scorer = pii.fit(table)
    found = by_id(pii.personal_data(table, scorer))
    clean = by_id(pii.redact(table, scorer))
    for i, (text, kind) in asked.items():
        assert [(s["kind"], s["strict"]) for s in found[i]["spans"]] == ([(kind, False)] if kind else []), i
        assert (f"[{kind}]" in clean[i]["text"]) if kind else clean[i]["text"] == text


def test_pieces_round_trip(documents, nothing):
    path = pieces.default_vocabulary()
    known = pieces.vocabulary(path)
    back = pieces.decode(pieces.encode(documents, path), path).collect()
    for r in back:
        assert r["decoded"] == (r["text"] or "")
        if len(r["text"] or "") < 3_000:
            assert r["ids"] == (full_search(" " + r["text"], known) if r["text"] else [])
    assert pieces.encode(nothing, path).count() == 0


def full_search(text, known):
    """The same search over the whole text, without a window."""
    text = text.replace("▁", "\udfff").replace(" ", "▁")
    best = [(0, -1, ())]
    for end in range(1, len(text) + 1):
        ways = [(best[s][0] + known.cost[text[s:end]][0], s, (known.cost[text[s:end]][1],)) for s in range(max(0, end - known.longest), end) if text[s:end] in known.cost]
        raw = text[end - 1].replace("\udfff", "▁").encode()
        best.append(min(ways, key=lambda w: (w[0], w[1])) if ways else (best[-1][0] + pieces.BYTE_COST * len(raw), end - 1, tuple(known.byte_id[b] for b in raw)))
    steps, end = [], len(text)
    while end > 0:
        steps.append(best[end][2])
        end = best[end][1]
    return [i for s in reversed(steps) for i in s]


def test_window_stays_small():
    known = pieces.vocabulary(pieces.default_vocabulary())
    search = pieces.StreamingViterbi(known)
    search.feed("▁" + "winterhouse" * 3_000)
    assert search.window < 10 * known.longest


def test_shards(spark, documents, nothing, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(shards.default_tokenizer())
    folder = f"file://{tmp_path}/ids"
    manifest = shards.write_shards(documents, shards.default_tokenizer(), folder)
    got = shards.read_shards(manifest, folder).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, shards.END_ID] for i, t in [(None, BASE), *enumerate(TEXTS)]}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        raw = np.array(ids[r["doc_id"]], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]), zlib.crc32(raw))
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, *range(len(TEXTS))]
    keys = spark.createDataFrame([(5,), (9,), (12_345,)], "doc_id long")
    assert {r["doc_id"]: r["ids"] for r in shards.lookup(manifest, folder, keys).collect()} == {5: ids[5], 9: ids[9], 12_345: None}
    assert shards.read_shards(shards.write_shards(nothing, shards.default_tokenizer(), folder + "0"), folder + "0").count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 2**63, 5_000).astype(np.uint64)
    keys = np.unique(keys)
    assert sorted(shards.PerfectHash.of(keys).numbers(keys)) == list(range(len(keys)))


def held(i, part):
    return i is not None and zlib.crc32(str(i).encode()) % FOLDS == part


def test_pitman_yor(documents, nothing):
    from pyspark.sql import functions as F

    training = documents.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0)) != 1)
    model = pitman_yor.train(training, model_words=8)
    tokens = {i: [*words((t or "").translate(ASCII)), None] for i, t in [(None, BASE), *enumerate(TEXTS)]}
    counts = Counter(w for i, ws in tokens.items() if not held(i, 1) for w in ws)
    total, different = sum(counts.values()), len(counts)
    for sent in (3, 1_000):
        for i, r in by_id(pitman_yor.score(documents, model, sent)).items():
            base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (different + 1))) for w in tokens[i])
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert np.allclose((10.0 ** model.table).sum(1), 1)  # each context shares out one
    assert pitman_yor.score(nothing, model).count() == 0
    assert pitman_yor.train(nothing).tokens == 0


def test_pitman_yor_every_word_is_a_context(spark):
    texts = [f"a{k} b{k}" for k in range(40) for _ in range(3)] + ["the"] * 500
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"a7 b{k}") for k in range(40)] + [(51, "a7 a9"), (61, "a7 new")], "doc_id long, text string")
    model = pitman_yor.train(table, model_words=1)
    for sent, pairs in ((3, 0), (1_000, 1_000)):
        got = {i: r["score"] for i, r in by_id(pitman_yor.score(asked, model, sent, pairs)).items()}
        assert all(got[7] > got[k] + 1 for k in [*range(7), *range(8, 40), 51, 61]), got  # only this pair was seen


def test_pitman_yor_contexts_share_out_one(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(["x y x z", "x y y", "z x y w", "w v"] * 5)], "doc_id long, text string")
    model = pitman_yor.train(table, model_words=2)
    words = {r["word"]: r for r in model.words.collect()}
    gains = {r["pair"]: r["gain"] for r in model.pairs.collect()}
    known = [int(w) for w in model.known.view(np.int64)]
    strength = pitman_yor.STRENGTH + pitman_yor.DISCOUNT * model.other_tables
    share = lambda r: (max(r["n"] - pitman_yor.DISCOUNT * r["tables"], 0) + strength / (model.different + 1)) / (pitman_yor.STRENGTH + model.other_total)
    for context in [0, *words]:
        kind = 3 if context == 0 else known.index(context) if context in known else 2
        back = model.back_of_beginning if context == 0 else words[context]["back"]
        total = seen = 0
        for dish in [0, *words]:
            below = 10 ** model.table[kind, 3 if dish == 0 else known.index(dish) if dish in known else 2]
            if dish and dish not in known:
                below *= share(words[dish])
                seen += share(words[dish])
            pair = pitman_yor._pair_keys(*np.array([[context], [dish]], np.int64).view(np.uint64)).view(np.int64)[0]
            total += 10 ** (back + gains.get(pair, 0.0)) * below
        unseen = 10 ** (back + model.table[kind, 2]) * (1 - seen)
        assert math.isclose(total + unseen, 1, rel_tol=1e-6)


def test_seats():
    counts = np.array([1, 1, 5, 400])
    tables = np.mean([pitman_yor.seat(counts, np.full(4, 2.0), np.random.default_rng(k)) for k in range(200)], axis=0)
    assert (tables[:2] == 1).all() and 1 < tables[2] < 5 and tables[2] < tables[3] < 400


def test_site_quality(spark, nothing):
    from pyspark.sql import functions as F

    rows = [(k, prose(60) if k % 3 else "**#$ %% " * 20, "good" if k % 3 else "bad") for k in range(120)] + [(500, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, host string")
    labels = spark.createDataFrame([(k, int(bool(k % 3))) for k in range(120)], "doc_id long, quality int")
    weights = site_quality.fit(table, labels)
    got = by_id(site_quality.site_quality(table, weights, F.col("host"), F.lit(None), ["doc_id", "text"]))
    assert all(got[k]["kept"] == bool(k % 3) for k in range(120)) and len(got) == 121
    assert site_quality.fit(table, labels.limit(0)) is None
    assert site_quality.site_quality(table.limit(0), None, F.col("host"), F.col("host"), ["doc_id"]).count() == 0
    host, path = site_quality.site_of(F.col("u"))
    urls = spark.createDataFrame([("HTTPS://A.b/c/d?x",), ("x",), (None,)], "u string").select(host, path).collect()
    assert [tuple(r) for r in urls] == [("a.b", "c"), ("", ""), ("", "")]


def test_grammar():
    machine = toxicity.grammar()
    score = lambda *symbols: toxicity.clause_score(machine, list(symbols), [float(s in ("insult", "threat")) for s in symbols])
    assert score("insult") == 1 and score("target", "insult") == 1.25 and math.isclose(score("negation", "insult"), 0.3)
    assert score("report", "insult") == 0.5 and score("threat") == 0.25 and score("target", "threat") == 1.25
    assert score("negation", "other", "other", "other", "insult") == 1


def test_report_goes_on_after_a_comma_or_colon(spark):
    texts = {"you idiot": 1.25, "he said: you idiot": 0.625, 'She wrote, "you idiot"': 0.625, "he said. you idiot": 1.25, "he said: no; you idiot": 1.25,
             "the house, you idiot": 1.25, "he said:, you idiot": 1.25, "he said you idiot": 0.625, "he said\nyou idiot": 1.25, "he said: you idiot, you idiot": 1.25}
    table = spark.createDataFrame([*enumerate(texts), (99, "she said"), (100, ", you idiot")], "doc_id long, text string")
    got = by_id(toxicity.features(table.coalesce(1), [(int(toxicity._hashes(["idiot"])[0]), 1.0)], ["doc_id"]))
    assert [got[k]["_f0"] for k in range(len(texts))] == list(texts.values()) and got[100]["_f0"] == 1.25


def test_toxicity(spark, documents, nothing):
    rows = [(k, prose(30) + (". you idiot " if k % 4 == 0 else ". ") + prose(10)) for k in range(400)] + [(900, None), (901, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(table, labels))
    assert all(got[k]["predicted"] == int(k % 4 == 0) and got[k]["held_out"] == held(k, 0) for k in range(400))
    assert 0 <= got[900]["score"] == got[901]["score"] < 0.5
    assert {r["score"] for r in toxicity.toxicity(documents, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("hot", [3, 100_000])
def test_repeats(documents, nothing, hot, monkeypatch):
    monkeypatch.setattr(repeats.repeat_spans, "__defaults__", (repeats.LENGTH, repeats.RUN, hot))
    got, seen = by_id(repeats.without_repeats(documents)), set()
    for i, text in enumerate(TEXTS):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k + 1 : k + 101] = True
            seen.add(data[k : k + 100])
        kept = bytes(b for b, g in zip(data, gone[1:]) if not g)
        want = (len(data), len(data) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, i
    assert got[None]["n_removed"] == 0
    assert repeats.without_repeats(nothing).count() == 0


def test_places_of_frequent_anchors_stay_out_of_the_shuffle_by_anchor(spark, documents, monkeypatch):
    plans, stored = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        repeats.repeat_spans(documents, hot_places=3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found, met = plans[1], plans[3]
    assert "LeftAnti" in found.split("Exchange hashpartitioning(anchor")[1]  # before the rows are dealt by anchor
    assert "MapInArrow" in met and "Exchange hashpartitioning" not in met


def test_pipeline_keeps_columns_and_takes_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns and 0 < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
