"""Language filters: bits against sets of n-grams, corrections against known fills, and accuracy on rows held out."""

import random
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language_id as li

SCHEMA = "doc_id bigint, text string, lang string, score double, lang_pred string, held_out string, row string"
STEMS = {"en": "the of and house river under", "fr": "le et maison très être où", "de": "der und haus fluß über ähnlich", "ru": "это река дом под над", "zz": "qx zq xxq"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang].split()) + rng.choice(["", "", ".", ","]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, "p", "h", "r") for i, t, lang in rows], SCHEMA).repartition(3)


def plain_ngrams(text, sizes=li.SIZES):
    """n-grams within words, with word ends marked, one character at a time."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else "\0" for c in text.lower())
    found = Counter()
    for word in kept.split("\0"):
        if word:
            marked = f"\0{word}\0"
            found.update(marked[k : k + n] for n in sizes for k in range(len(marked) - n + 1))
    return found


def own_ngrams(text):
    return Counter(np.concatenate([*li.ngrams(text), np.zeros(0, np.uint64)]).tolist())


def test_ngrams_equal_their_definition():
    rng = random.Random(2)
    alphabet = "ab é́ß中 !\n\U0001f600İ"
    gram_of = {}
    for k in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        plain, own = plain_ngrams(text), own_ngrams(text)
        assert sorted(plain.values()) == sorted(own.values()), (k, text)
        if len(plain) == 1:
            gram_of.setdefault(next(iter(plain)), set()).update(own)
    assert all(len(v) == 1 for v in gram_of.values())
    assert own_ngrams("The") == own_ngrams("the") == own_ngrams(" the!") != own_ngrams("then")


def test_pieces_of_a_long_text_give_the_same_ngrams():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9))) for _ in range(60_000)) + " " + "x" * (li.PIECE + 5000)
    assert len(text) > 4 * li.PIECE and sorted(plain_ngrams(text).values()) == sorted(own_ngrams(text).values())


def test_filters_hold_the_ngrams_of_enough_texts_in_their_own_bits(spark):
    """Rows of the table are the OR of what a plain count over texts keeps."""
    rng = random.Random(1)
    rows = [(k, sentence(rng, lang := rng.choice(list(STEMS)), 6), lang) for k in range(200)]
    filters = li.fit(table(spark, rows), F.lit(True), min_share=0.2, bits=14)
    sizes = Counter(lang for _, _, lang in rows)
    assert filters.names == sorted(sizes, key=lambda k: (-sizes[k], k))
    holds = defaultdict(Counter)
    for _, text, lang in rows:
        holds[lang].update(set(own_ngrams(text)))
    expected = np.zeros_like(filters.table)
    for k, name in enumerate(filters.names):
        grams = np.array([g for g, n in holds[name].items() if n >= 0.2 * sizes[name]], np.uint64)
        for places in li.rows_of(grams, 14):
            expected[places.astype(int), k // 8] |= 1 << (k % 8)
        assert ((filters.languages(grams)[:, k // 8] >> (k % 8)) & 1).all()  # no false negatives
    assert (filters.table == expected).all()


def test_more_languages_than_bits_of_a_byte(spark):
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    rows = [(k, " ".join(words[(k % 21) * 5 : (k % 21) * 5 + 5]), f"l{k % 21:02d}") for k in range(210)]
    filters = li.fit(table(spark, rows), F.lit(True), min_share=0.5)
    assert filters.table.shape[1] == 3 and len(filters.names) == 21
    assert all(filters.identify(text)[0] == lang for _, text, lang in rows)


def test_hits_are_corrected_for_false_positives():
    """With filters nine tenths full, random n-grams of no language count next to nothing, and known ones in full."""
    rng = np.random.default_rng(3)
    filters = li.Filters(["a", "b"], (rng.random((1 << 14, 1)) < 0.9).astype(np.uint8) | 2)
    assert abs(filters.false[0] - 0.9**3) < 0.02
    grams = li.mix(np.arange(200_000, dtype=np.uint64))
    hits = int((filters.languages(grams)[:, 0] & 1).sum())
    real = (hits - len(grams) * filters.false[0]) / (1 - filters.false[0])
    assert hits > 0.7 * len(grams) and abs(real) < 0.02 * len(grams)


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, lang := rng.choice(["en", "fr"]), 8), lang) for k in range(120)]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, " 12 !? ́\n", "en"), (1003, "the house", None), (None, "le et la maison", "fr"), (1004, "中文", None), (1005, "the " * 200_000, "en"), *rows[:1], *rows[:1]]
    got = li.identify(table(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000]["score"] == 0.0
    assert by_id[1003]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "fr" and by_id[1005]["lang_pred"] == "en"
    learnt = Counter(lang for i, t, lang in rows + odd if lang and t is not None and (i is None or crc32(str(i).encode()) % 5 > 0))
    most = min(("en", "fr"), key=lambda name: (-learnt[name], name))
    assert (by_id[1004]["lang_pred"], by_id[1004]["score"]) == (most, 0.0)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert li.identify(table(spark, []).where("false")).collect() == []
    assert {r["lang_pred"] for r in li.identify(table(spark, [(1, "the house", None)])).collect()} == {"und"}
    kept = li.with_language(table(spark, odd), li.Filters([], np.zeros((4, 1), np.uint8)), lang_col="found")
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "held_out", "row", "found", "score"]


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(5)
    rows = [(k, sentence(rng, lang := rng.choice(["en", "fr", "de"]), 8), lang) for k in range(150)]
    wrong = [(k, t, "de" if crc32(str(k).encode()) % 5 == 0 else lang) for k, t, lang in rows]
    first, second = (sorted(map(tuple, li.identify(table(spark, x)).collect())) for x in (rows, wrong))
    assert first == second


def test_held_out_accuracy_of_the_registered_query(spark):
    from docloom.llm.queries import op12_language_id

    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = op12_language_id(spark, folder).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and len(held) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
