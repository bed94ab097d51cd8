"""The text operators against SQL, brute force, exact round trips and held-out accuracy, and on awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

from strataloom.llm import (  # noqa: E402
    components, decontaminate, exact_dedup, langid, license_scan, lm_score, ngram_join, pii, queries, secrets, sentencepiece_codec, toxicity,
)
from strataloom.llm.hashing import mix, word_hashes  # noqa: E402
from strataloom.plans.workspace import Workspace  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, id string"


@pytest.fixture(scope="module")
def docs(sf):
    return {r[0]: r for r in connect(sf).sql("SELECT doc_id, text, lang FROM documents").fetchall()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeats of rows and ids, and columns whose names clash."""
    long = "word " * 60_000 + "the end"
    rows = [
        (1, "Alpha beta gamma delta", "en"), (1, "Alpha beta gamma delta", "en"), (1, "another text of the same id", "en"), (2, None, "de"), (3, "", None), (None, "alpha BETA gamma delta", "en"),
        (None, None, None), (4, " \n\t ", "fr"), (5, long, "en"), (6, long.upper(), "en"), (7, "x", "en"), (8, "é Straße 你好 ▁ 　", "de"), (9, "12 34", "en"),
    ]
    return spark.createDataFrame([(i, t, g, "s", None, "r", "d", "i") for i, t, g in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    compare(spark, sf, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- 1 ---


def test_dedup_collisions_compare_full_bytes(spark, awkward):
    weak = lambda t: F.encode(F.substring(F.sha2(t, 256), 1, 1), "UTF-8")
    for digest in (exact_dedup.sha256, weak):
        got = exact_dedup.exact_dedup(awkward, digest=digest).collect()
        assert len(got) == awkward.count()
        assert sum(r["kept"] for r in got) == 8
        by_id = collections.defaultdict(list)
        for r in got:
            by_id[r["id"]].append((r["stays_id"], r["n"], r["kept"]))
        assert sorted(by_id[1]) == [(1, 1, True), (1, 3, False), (1, 3, True)]
        assert by_id[5] == [(6, 2, False)] and by_id[6] == [(6, 2, True)]
        assert sorted(by_id[None], key=str) == [(1, 3, False), (3, 3, False)]


def test_dedup_state_lasts(spark, tmp_path):
    folder = f"file://{tmp_path}"
    runs = [[(1, "a"), (2, "b"), (3, "c")], [(4, "A"), (0, "B"), (5, "d")], [(9, "a"), (6, None)]]
    want = [[(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True)], [(0, 2, 2, False), (4, 4, 2, True), (5, 5, 1, True)], [(6, 6, 1, True), (9, 9, 3, True)]]
    weak = lambda t: F.encode(F.substring(F.sha2(t, 256), 1, 1), "UTF-8")
    for name, digest in (("full", exact_dedup.sha256), ("weak", weak)):
        for k, rows in enumerate(runs):
            spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/{name}-{k}")
            docs = spark.read.parquet(f"{folder}/{name}-{k}")
            got = exact_dedup.exact_dedup(docs, digest=digest, folder=f"{folder}/{name}-seen").collect()
            assert sorted((r["id"], r["stays_id"], r["n"], r["kept"]) for r in got) == want[k]
            assert all(f"{name}-{k}" in r["locator"]["file"] for r in got)


def test_dedup_in_many_batches(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/docs")
    got = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/docs"), files_per_batch=1).collect()
    want = {i: (max(j for j, t in rows if t == text), sum(t == text for _, t in rows)) for i, text in rows}
    assert {r["id"]: (r["stays_id"], r["n"]) for r in got} == want and sum(r["kept"] for r in got) == 7 and len(got) == 60


def test_keep_unique(spark, awkward):
    got = exact_dedup.keep_unique(awkward)
    assert got.columns == awkward.columns and got.count() == 8


# --- 2 ---


def test_wu_manber_finds_all():
    rng = random.Random(3)
    for width in (1, 2, 3, 5):
        for _ in range(60):
            items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.choice([2, 5, 9]))).encode()) for k in range(4)]
            text = [rng.choice("abcd").encode() for _ in range(60)]
            spans, owners = decontaminate.Matchers(items, width).search(text)
            hit, want = set(), set()
            for item, words in items:
                w = words.split()
                n = min(width, len(w))
                for k in range(len(w) - n + 1):
                    at = [i for i in range(len(text) - n + 1) if text[i : i + n] == w[k : k + n]]
                    hit |= {j for i in at for j in range(i, i + n)}
                    want |= {item} if at else set()
            assert {j for a, b in spans for j in range(a, b)} == hit and owners == want


def test_long_items_are_cut_without_loss(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short one")], "item_id long, text string")
    rows = [(i, " ".join(["x", *words[200 * i + 90 : 200 * i + 90 + 13 + i], "y"])) for i in range(14)] + [(99, "nothing"), (98, "a short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, items, group_words=100).collect())
    assert got == [(i, 13 + i, ["1"]) for i in range(14)] + [(98, 2, ["2"]), (99, 0, [])]
    for size in (100, 10**6):
        assert [r["doc_id"] for r in decontaminate.keep_clean(docs, items, group_words=size).collect()] == [99]


def test_decontaminate_groups_agree(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.decontaminate(d, b)
    many = decontaminate.decontaminate(d, b, group_words=700)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.select(one.columns).collect()))


def test_decontaminate_awkward(spark, awkward):
    items = spark.createDataFrame([(1, "alpha beta GAMMA delta"), (None, "another text of"), (2, None), (3, "")], "item_id long, text string")
    got = decontaminate.decontaminate(awkward, items).collect()
    assert len(got) == awkward.count()
    assert sorted((r["id"] or 0, r["n_hit"], len(r["items"])) for r in got if r["n_hit"]) == [(0, 4, 1), (1, 3, 0), (1, 4, 1), (1, 4, 1)]
    empty = decontaminate.decontaminate(awkward, items.limit(0))
    assert empty.where("n_hit > 0").count() == 0 and decontaminate.decontaminate(awkward.limit(0), items).count() == 0


# --- 3 ---


def test_toxicity_held_out(spark, sf):
    labels = dict(connect(sf.replace("0.01", "0.1")).sql("SELECT doc_id, toxic FROM labels").fetchall())
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, sf.replace("0.01", "0.1")).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and all(0 <= r["score"] <= 1 for r in got.values())
    right = sum(got[i]["predicted"] == labels[i] for i in held)
    clean = [i for i in held if not labels[i]]
    assert right / len(held) > 0.97 and sum(got[i]["predicted"] for i in clean) / len(clean) < 0.02


def test_toxicity_locates_sentences(spark, awkward):
    bags = [(k % 2, [[b"some", b"words", bytes(str(k), "ascii")], [b"you", b"idiot" if k % 2 else b"friend"]]) for k in range(200)]
    model = toxicity.fit(bags)
    p, found = model.of("Ça va. You IDIOT! Some words".encode())
    assert p > 0.5 and len(found) == 1 and model.of(b"some words")[0] < 0.5
    text = "Ça va. You IDIOT! Some words"
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    span = got["offending"][0]
    assert text[span["start"] : span["end"]].strip() == "You IDIOT"
    assert toxicity.score(awkward, model).count() == awkward.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(spark, awkward, none).where("score > 0").count() == 0


def test_toxicity_model_is_the_same_from_any_layout(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    rows = [(i, f"word {i % 9}. you {'idiot' if i % 3 == 0 else 'friend'} {i % 5}") for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    a = toxicity.train(docs, labels, F.lit(True))
    b = toxicity.train(docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(3), F.lit(True))
    assert a.weights == b.weights and a.bias == b.bias and b"idiot" in a.weights


# --- 4 ---


def brute_components(texts, width, num):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,num,knobs", [(3, 90, {}), (3, 90, {"LONG": 3, "MARKED_LENGTH": 2}), (5, 80, {"LONG": 2, "PAIRS_PER_ENTRY": 0}), (2, 60, {"LONG": 2})])
def test_jaccard_join_brute_force(spark, monkeypatch, width, num, knobs):
    for k, v in knobs.items():
        monkeypatch.setattr(ngram_join, k, v)
    rng = random.Random(num + len(knobs))
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 12, 40, 70]))] for _ in range(40)]
    texts = []
    for i in range(240):
        words = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[rng.randrange(len(words))] = rng.choice("qrstu")
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.jaccard_join(df, width=width, num=num).collect()}
    assert got == brute_components(texts, width, num)


def test_jaccard_join_awkward(spark, awkward):
    got = collections.Counter((r["id"], r["n_shingles"], r["component"]) for r in ngram_join.jaccard_join(awkward, width=3, num=90).collect())
    assert got[(1, 2, 1)] == 2 and got[(None, 2, 1)] == 1 and got[(2, 0, 2)] == 1 and got[(6, 3, 5)] == 1 and got[(None, 0, None)] == 1
    assert sum(got.values()) == awkward.count() and ngram_join.jaccard_join(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_components_chain(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "ONE_TASK", limit)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "u long, v long")
    got = dict(map(tuple, components.components(Workspace(spark, "test"), edges, "c").collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# --- 5 ---


def test_license_base_brute_force(spark, sf, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r["doc_id"]: r for r in license_scan.op5_license_scan(spark, sf).collect()}
    for i, text, _ in docs.values():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({k: k + 32 for k in range(65, 91)}))
        starts, labels = [], set()
        for p, label in phrases.items():
            p = p.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = got[i]
        want = (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_notice_with_changes(spark, awkward):
    notice = license_scan.TEMPLATES[6].text
    changed = notice.replace("without restriction", "with no restriction").replace("merge, publish", "merge, and also publish")
    got = license_scan.scan(spark.createDataFrame([(1, "Intro words. " + changed), (2, "nothing here")], "doc_id long, text string")).collect()
    found = {r["id"]: [s["label"] for s in r["spans"]] for r in got}
    assert "mit" in found[1] and found[2] == []
    assert license_scan.scan(awkward).count() == awkward.count() and license_scan.scan(awkward.limit(0)).count() == 0


def test_every_notice_is_found_under_its_own_label(spark):
    rng = random.Random(9)
    filler = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet the a of license software".split()) for _ in range(60))
    notices = [t for t in license_scan.TEMPLATES if not t.base]
    rows = [(k, f"{filler()} {t.text}. {filler()}") for k, t in enumerate(notices)] + [(100 + k, filler()) for k in range(20)]
    rows += [(200 + k, " ".join(w for i, w in enumerate(t.text.split()) if i % 17 != 11)) for k, t in enumerate(notices) if len(t.text.split()) > 25]
    got = {r["id"]: [s for s in r["spans"] if not s["base"]] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(notices):
        n = len(license_scan.words(t.text.encode()))
        assert [(s["label"], s["start"], s["end"], s["share"]) for s in got[k]] == [(t.label, 60, 60 + n, 1.0)]
        assert 200 + k not in got or {s["label"] for s in got[200 + k]} == {t.label}
    assert not any(got[100 + k] for k in range(20))


# --- 6 ---


def test_language_held_out(spark, sf, docs, awkward):
    got = {r["doc_id"]: r for r in langid.op6_language_id(spark, sf).collect()}
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == docs[i][2] for i in held) / len(held) > 0.97
    model = langid.fit([("en", 0, "the", 50), ("de", 0, "der", 50), ("en", 3, "the", 9), ("de", 3, "sch", 9)])
    assert model.predict("the the") [0] == "en" and model.predict("schule")[0] == "de" and model.predict("²² 12") == ("und", 0.0)
    by = langid.identify(awkward, model)
    assert by.count() == awkward.count() and by.where("id IN (2, 3, 4, 9) AND lang_pred <> 'und'").count() == 0


def test_language_reads_words_whole(spark):
    model = langid.fit([("de", 3, "sch", 9), ("en", 3, "the", 9)])
    assert model.predict("x" * 60 + "the" * 9)[0] == "en" and model.predict("x" * 60 + "sch" * 9)[0] == "de"
    rows = [(i, "x" * 60 + tail + chr(97 + i), lang) for i in range(9) for tail, lang in (("the", "en"), ("sch", "de"))]
    fitted = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert {"the", "sch", "xthe"} <= set(fitted.grams) and "xx$" not in fitted.grams


# --- 7 ---


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.read_pieces()


def test_pieces_equal_the_public_encoder_without_dropout(pieces, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    codec = sentencepiece_codec.Codec(pieces)
    rng = random.Random(5)
    texts = [t for _, t, _ in list(docs.values())[:60]] + ["".join(rng.choice(" abThe.,!?²\n\tßé你🙂 <s>0x") for _ in range(30)) for _ in range(2000)]
    assert all(codec.encode(t.encode()) == model.encode(t) for t in texts)


def brute_merges(codec, pieces, symbols, draw):
    """The best candidate that isn't skipped is merged, the first of equals, until none is left; each is looked for anew."""
    rank = {p: (-score, i) for i, (p, score, _, normal) in enumerate(pieces) if normal}
    name = [p for p, *_ in pieces]
    runs = [(k, k + 1, x) for k, x in enumerate(symbols)]
    while True:
        found = []
        for (a, m, x), (_, e, y) in zip(runs, runs[1:]):
            if pieces[x][3] and pieces[y][3] and name[x] + name[y] in rank:
                h = (draw + a * sentencepiece_codec._START + m * sentencepiece_codec._MID + e * sentencepiece_codec._END) % 2**64
                if not sentencepiece_codec._scramble(np.array([h], np.uint64))[0] < codec.threshold:
                    found.append((rank[name[x] + name[y]][0], a, e))
        if not found:
            return [x for *_, x in runs]
        _, a, e = min(found)
        whole = "".join(name[x] for s, t, x in runs if a <= s < e)
        runs = sorted([r for r in runs if not a <= r[0] < e] + [(a, e, rank[whole][1])])


def test_dropout_equals_brute_force(pieces, docs, monkeypatch):
    codec = sentencepiece_codec.Codec(pieces, 0.2, 7)
    texts = [t.encode() for _, t, _ in list(docs.values())[:5]] + ["▁ a▁▁ \x00 🙂 " .encode() + b"abcdefghij" * 9]
    wanted = []
    for key, text in enumerate(texts):
        parts = codec.chunks.findall(b" " + text)
        base = mix(np.array([key], np.uint64) * np.uint64(sentencepiece_codec._START) + np.uint64(7))
        draws = mix(base + np.arange(len(parts), dtype=np.uint64)).tolist()
        wanted.append([x for p, d in zip(parts, draws) for x in brute_merges(codec, pieces, codec.first_symbols(p), d)])
    assert [codec.encode(t, i) for i, t in enumerate(texts)] == wanted
    for name, value in (("WIDE", 3), ("SLICE", 50), ("LONG_TEXT", 20)):  # other ways to the same result
        monkeypatch.setattr(sentencepiece_codec, name, value)
        assert [sentencepiece_codec.Codec(pieces, 0.2, 7, 5).encode(t, i) for i, t in enumerate(texts)] == wanted


def test_dropout_is_lossless_and_seeded(spark, pieces, docs, awkward, monkeypatch):
    texts = [t.encode() for _, t, _ in list(docs.values())[:80]] + ["▁ a▁▁ \x00 🙂".encode()]
    make = lambda seed: sentencepiece_codec.Codec(pieces, 0.2, seed)
    a, b, c = make(1), make(1), make(2)
    once = [a.encode(t, i) for i, t in enumerate(texts)]
    assert once == [b.encode(t, i) for i, t in enumerate(texts)] != [c.encode(t, i) for i, t in enumerate(texts)]
    assert all(a.decode(e) == t for e, t in zip(once, texts))
    together = [p for p, _ in a.encode_all(texts, range(len(texts)))]
    assert np.concatenate(together).tolist() == [x for e in once for x in e]
    want = sorted(r[0] for r in awkward.select(F.coalesce("text", F.lit(""))).collect())
    first = None
    for size in (2_000_000, 3):
        monkeypatch.setattr(sentencepiece_codec, "HANDED_ON", size)
        encoded = sentencepiece_codec.encode(awkward)
        assert encoded.where("NOT lossless OR n_pieces <> size(pieces)").count() == 0 and encoded.count() == awkward.count()
        rows = sorted(map(str, encoded.collect()))
        first = first or rows
        assert rows == first and sorted(r["text"] for r in sentencepiece_codec.decode(encoded).collect()) == want


def test_dropout_differs_by_document_and_place(pieces):
    codec = sentencepiece_codec.Codec(pieces, sentencepiece_codec.DROPOUT, sentencepiece_codec.SEED)
    by_document = collections.Counter(tuple(codec.encode(b"undoubtedly", k)) for k in range(2000))
    by_place = codec.encode(b"undoubtedly " * 2000, 1)
    assert len(by_document) > 20 and len(set(zip(*[by_place[k:] for k in range(6)]))) > 20
    # as often without a skip as all of its candidates pass
    asked = int(codec.spans[codec.types[b" undoubtedly"]][5])
    best = tuple(sentencepiece_codec.Codec(pieces).encode(b"undoubtedly"))
    assert asked > 5 and by_document[best] / 2000 >= 0.9**asked - 0.04
    rate = lambda p: len(sentencepiece_codec.Codec(pieces, p, 3).encode(b"undoubtedly " * 500, 1))
    assert rate(0) < rate(0.1) < rate(0.5) < rate(1.0) == len("undoubtedly ") * 500 + 1


def test_missing_model(spark, awkward):
    with pytest.raises(OSError):
        sentencepiece_codec.encode(awkward, model_path="/nonexistent.model")


# --- 8 ---


def test_permutation_moves_everything():
    for size in (2, 3, 10, 97, 1000):
        p = [pii.permute(i, size, b"k") for i in range(size)]
        assert sorted(p) == list(range(size)) and all(a != b for a, b in enumerate(p))


def test_surrogates_keep_type_and_identity(spark, sf, awkward):
    text = "Mrs. Maria Weber (maria.weber@mail.example.com, +1 (900) 555-2077) paid 4111 1111 1111 1111 from 10.0.0.1; Weber and Mr. Weber agreed. SSN 123-45-6789."
    new, spans = pii.rewrite(text)
    found = {(k, text[a:b]): s for a, b, k, s in spans}
    assert all(orig not in new for (_, orig) in found)
    assert found[("given", "Maria")].lower() in pii.FEMALE and new.count(found[("surname", "Weber")]) == 3
    card = re.sub(" ", "", found[("card", "4111 1111 1111 1111")])
    assert pii.luhn(card[:-1]) == int(card[-1]) and card[0] == "4"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", found[("phone", "+1 (900) 555-2077")])
    assert pii.rewrite(text) == (new, spans) and pii.rewrite(text, "other key")[0] != new
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert pii.collisions(pii.pseudonymize(docs)).count() == 0
    got = pii.checked(awkward)
    assert got.where("text IS NULL").count() == 2 and got.where("text = ''").count() == 1 and got.count() == awkward.count()


def test_surrogates_are_distinct_and_corefer_over_formats():
    rng = random.Random(8)
    number = [f"{rng.randrange(200, 999)}{rng.randrange(200, 999)}{rng.randrange(10**4):04d}" for _ in range(400)]
    formats = [lambda d: f"({d[:3]}) {d[3:6]}-{d[6:]}", lambda d: f"{d[:3]}-{d[3:6]}-{d[6:]}", lambda d: f"+1 {d[:3]} {d[3:6]} {d[6:]}", lambda d: f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"]
    of = {}
    for d in set(number):
        new = {pii.canonical("phone", pii.rewrite(f"call {f(d)}!")[1][0][3]) for f in formats}
        assert len(new) == 1 and d not in new
        of[d] = new.pop()
    assert len(set(of.values())) == len(of)
    for a, b in (("10.0.0.1", "010.0.0.1"), ("2001:db8::1", "2001:0db8:0000:0000:0000:0000:0000:0001"), ("Mary@Mail.example.org", "mary@mail.EXAMPLE.org")):
        (*_, kind, x), (*_, _, y) = pii.rewrite(f"x {a} y")[1][0], pii.rewrite(f"x {b} y")[1][0]
        assert pii.canonical(kind, x) == pii.canonical(kind, y) != pii.canonical(kind, a)
    local = "a" * 83
    new, spans = pii.rewrite(f"to {local}@mail.example.com")
    assert spans[0][:2] == (3, 3 + 83 + 17) and "aaaaaaaa" not in new
    for text in ("DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"):
        (a, b, kind, new), = pii.rewrite(f"IBAN {text}.")[1]
        packed = new.replace(" ", "")
        assert kind == "iban" and new != text and pii._mod97(packed[4:] + packed[:4]) == 1 and [c == " " for c in new] == [c == " " for c in text]
    for text, names in (("Dr 王伟 spoke", ["王伟"]), ("MARIA Weber, maria weber", ["MARIA", "Weber", "maria", "weber"]), ("José Garcia", ["José", "Garcia"]), ("My name is Wei Zhang", ["Wei", "Zhang"])):
        new, spans = pii.rewrite(text)
        assert [text[a:b] for a, b, *_ in spans] == names and all(n not in new for n in names)
        assert [n.isupper() for n in names] == [s.isupper() for *_, s in spans]
    assert pii.rewrite("mark the spot and carol singing at 12:30:45")[1] == []


def test_collisions_are_seen_and_mended(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"mail a{i}@mail.example.com and Mary Smith") for i in range(30)], "doc_id long, text string")
    result = pii.pseudonymize(docs)
    assert pii.collisions(result).count() == 0
    one = F.transform("entities", lambda e: e.withField("stand_in", F.lit(1).cast("long")))
    assert pii.collisions(result.withColumn("entities", one)).where("what = 'stand_in'").count() > 0
    bad = iter([result.withColumn("entities", one), result])
    monkeypatch.setattr(pii, "pseudonymize", lambda *args: next(bad))
    assert pii.checked(docs).count() == 30 and next(bad, None) is None


# --- 9 ---


def test_base_score_brute_force(spark, sf, docs, awkward):
    got = {r["doc_id"]: r for r in lm_score.op9_lm_score(spark, sf).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t, _ in docs.values()}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_score.score(awkward, F.lit(True)).count() == awkward.count()
    assert lm_score.score(awkward, F.lit(False)).where("n_known > 0").count() == 0


def test_exchange_finds_classes():
    rng = random.Random(2)
    n = np.zeros((7, 7))
    for _ in range(4000):  # words 0-2 follow words 3-5 and the other way round
        n[rng.choice([0, 1, 2]), rng.choice([3, 4, 5])] += 1
        n[rng.choice([3, 4, 5]), rng.choice([0, 1, 2])] += 1
    of = lm_score.exchange(n, 6, 2, 10)
    assert len(set(of[:3])) == len(set(of[3:6])) == 1 and of[0] != of[3]


@pytest.mark.parametrize("frequent", [1 << 20, 5000])
def test_words_beyond_the_seeds_have_classes_by_context(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rng = random.Random(4)
    seeds, others = ([[f"{x}{kind}{i}" for i in range(n)] for x in "ab"] for kind, n in (("seed", 600), ("other", 400)))
    sides = [[w for w in x for _ in range(40)] + [w for w in y for _ in range(8)] for x, y in zip(seeds, others)]
    for words in sides:
        rng.shuffle(words)
    mixed = [w for pair in zip(*sides) for w in pair]  # words of a and b take turns
    rows = [(i, " ".join(mixed[50 * i : 50 * i + 50])) for i in range(len(mixed) // 50)]
    turns = [w for pair in zip(*others) for w in pair]
    rows += [(-1, " ".join(turns)), (-2, " ".join(others[0] + others[1]))]
    got = {r["id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("id") >= 0).collect()}
    assert math.isclose(got[-1]["base_score"], got[-2]["base_score"])
    assert got[-1]["score"] > got[-2]["score"] + 0.5 * len(turns)


# --- 10 ---


def test_secrets_brute_force(spark, sf, docs, awkward):
    got = {r["doc_id"]: r for r in secrets.op10_secret_scan(spark, sf).collect()}
    assign = re.compile(secrets.ASSIGN)
    for i, text, _ in docs.values():
        s = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert secrets.scan(awkward).count() == awkward.count()


def test_markov_models_tell_keys_from_identifiers(spark):
    texts = ["é key q7Zk2VbX9LmT4wRy8NpC1sHd done", "call get_user_name_from_session_cache now", "thereoftheandthinganotherstation", "x\U0001f642 token= 'abcdef1' and token: abc"]
    got = {r["id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[0]["added"]] == [(6, 30)]
    assert not got[1]["added"] and not got[2]["added"]
    assert [(s["start"], s["end"], s["value"]) for s in got[3]["base"]] == [(3, 18, "abcdef1")]


# --- the pipeline ---


def test_pipeline_stages(spark, sf, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    cut = pipeline.dedup(spark, table, sf)
    assert cut.columns == table.columns
    best = {}
    for i, t, _ in docs.values():
        key = t.translate({k: k + 32 for k in range(65, 91)})
        best[key] = max(i, best.get(key, i))
    assert {r["doc_id"] for r in cut.select("doc_id").collect()} == set(best.values())
    near = pipeline.near_duplicates(spark, cut, sf)
    want = brute_components([(i, docs[i][1]) for i in best.values()], 5, 80)
    assert {r["doc_id"] for r in near.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}
    dirty = {r["doc_id"] for r in decontaminate.op2_decontaminate(spark, sf).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in pipeline.decontaminate(spark, table, sf).select("doc_id").collect()} == set(docs) - dirty
    toxic = {r["doc_id"] for r in toxicity.op3_toxicity(spark, sf).collect() if r["predicted"]}
    assert {r["doc_id"] for r in pipeline.toxicity(spark, table, sf).select("doc_id").collect()} == set(docs) - toxic
    last = pipeline.run(spark, sf)
    assert last.where("NOT lossless").count() == 0 and 0 < last.count() < len(docs)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Awkward rows in files, with columns named like those that the stages use themselves, and what each stage should keep."""
    pytest.importorskip("corpus_pipeline")
    folder = str(tmp_path_factory.mktemp("clashing"))
    toxic, leak = "you vile idiot. " * 3, " ".join(f"leak{k}" for k in range(20))
    near = [f"near{k}" for k in range(60)]
    rows = [
        (None, toxic), (None, "a fine text"), (1, toxic), (1, "another fine text"), (2, None), (3, ""), (4, "Copy of this"), (5, "copy of THIS"), (5, "copy of this"),
        (6, leak), (6, "no leak at all"), (7, " ".join(near)), (None, " ".join([*near, "end"])), (7, " ".join(["start", *near])), (8, "long " * 50_000 + "end"), (9, " \t\n"),
    ]
    names = ["row", "_row", "locator", "_metadata", "id", "digest", "node", "key", "__id", "component", "score", "at", "n", "text_a", "Row2", "shingle"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(i, t, None, "s", None, *(f"{k}-{n}" for n in names)) for k, (i, t) in enumerate(rows)], schema)
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labelled = [(1000 + k, f"you {'idiot' if k % 2 else 'friend'} number {k}") for k in range(120)]
    train = spark.createDataFrame([(i, t, None, "s", None, *names) for i, t in labelled], schema)
    train.write.mode("append").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in labelled] + [(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, df.unionByName(train), rows


def test_stages_decide_by_row(spark, clashing):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder, df, rows = clashing
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def kept(stage, table):
        got = stage(spark, table, folder)
        assert got.columns == table.columns and got.schema.simpleString() == table.schema.simpleString()
        return sorted(int(r["key"].split("-")[0]) for r in got.where("doc_id IS NULL OR doc_id < 1000").collect())

    every = set(range(len(rows)))
    for table in (docs, df):  # in files and not
        assert kept(pipeline.toxicity, table) == sorted(every - {0, 2})
        unique = set(kept(pipeline.dedup, table))
        assert unique - {7, 8} == {1, 2, 3, 5, 9, 10, 11, 12, 13, 14, 15} and len(unique) == 12
        assert kept(pipeline.decontaminate, table) == sorted(every - {9})
        near = set(kept(pipeline.near_duplicates, table))
        assert near - {11, 13} == every - {0, 7, 8, 11, 12, 13} and len(near) == len(every) - 5
    last = pipeline.run(spark, folder)
    assert last.where("NOT lossless").count() == 0 and last.where("doc_id IS NULL").count() == 1


def test_stages_on_empty_tables(spark, tmp_path, clashing):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder, df, _ = clashing
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, df.limit(0), str(tmp_path))
        assert got.columns == df.columns and got.count() == 0
        rest = stage(spark, df.where("doc_id < 1000"), str(tmp_path))  # no labels, no benchmark
        assert rest.columns == df.columns and rest.count() > 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_word_hashes_cut_anywhere():
    text = b"ab  c\nd " * 200_000
    h, s, e = word_hashes(text)
    assert len(h) == 600_000 and len(set(h.tolist())) == 3 and [text[a:b] for a, b in zip(s[-3:], e[-3:])] == [b"ab", b"c", b"d"]


def test_empty_tables(spark, awkward):
    none, labels = awkward.limit(0), spark.createDataFrame([], "doc_id long, toxic int")
    for got in (
        exact_dedup.exact_dedup(none), exact_dedup.keep_unique(none), toxicity.toxicity(spark, none, labels), lm_score.score(none, F.lit(True)),
        langid.identify(none, langid.train(none, F.lit(True))), sentencepiece_codec.encode(none), pii.pseudonymize(none), secrets.scan(none),
    ):
        assert got.count() == 0


def test_many_spans_in_one_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([5, 24, 30]))) for _ in range(9000)]
    text = " ".join(words)
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert [(s["start"], s["end"]) for s in got["base"]] == want and not got["added"]


def brute_stretch(run, table):
    k = len(secrets.ALPHABET)
    steps = [table[secrets.ALPHABET.index(a) * k + secrets.ALPHABET.index(b)] for a, b in zip(run, run[1:])]
    return max((sum(steps[i:j]) for i in range(len(steps)) for j in range(i + 1, len(steps) + 1)), default=0.0)


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(7)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    texts = [f"see /usr/share/doc/{key(16)} and get_user_name_from_session_cache {key(13)} or 12345678901234 token={key(9)} {key(40)}" for _ in range(40)]
    table = [round(x, 6) for x in secrets.train(secrets.samples(spark))]
    got = {r["id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, text in enumerate(texts):
        rest = text
        for s in got[i]["base"]:
            rest = rest[: s["start"]] + " " * (s["end"] - s["start"]) + rest[s["end"] :]
        runs = [(m.start(), m[0], brute_stretch(m[0], table)) for m in re.finditer(secrets.RUN, rest)]
        added = {(s["start"], s["end"]): s["value"] for s in got[i]["added"]}
        assert all(text[a:b] == v for (a, b), v in added.items())
        for at, run, best in runs:
            mine = [(a, b) for a, b in added if at <= a and b <= at + len(run)]
            assert len(mine) <= 1
            if mine:
                (a, b), = mine
                assert math.isclose(brute_stretch(text[a:b], table), best, abs_tol=1e-4) and best >= max(secrets.LEAST_RATIO, secrets.LEAST_MEAN * (b - a - 1)) - 1e-4
                found += 1
            else:
                assert best < secrets.LEAST_RATIO or run.islower() or best < secrets.LEAST_MEAN * len(run) or len(run) < 14
    assert found >= 100
