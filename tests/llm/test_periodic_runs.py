"""Periodic runs against their definition."""

import hashlib
import random
import re
import time
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import periodic_runs as pr

SCHEMA = "doc_id bigint, text string, lang string, runs string, id string, start int, collapsed string"


def by_definition(words, min_length=24, min_exponent=3):
    """For every period all longest stretches; those whose smallest period it is stay."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(min_length, min_exponent * q):
                found.setdefault((at, end + q), q)  # periods ascend, so the smallest is first
            at = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def digest_row(doc_id, text, plant=True):
    """The row that the contract asks for, in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def numbers(words):
    """A number for each distinct word."""
    return np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1].astype(np.uint64) if len(words) else np.zeros(0, np.uint64)


@settings(max_examples=400, deadline=None)
@given(st.randoms(use_true_random=False))
def test_runs_equal_their_definition(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        p = rng.choice([1, 2, 3, 5, 8, 9, 20, 40])
        unit = [rng.choice("abc" if rng.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz") for _ in range(p)]
        words += (unit * rng.randrange(1, 30))[: rng.randrange(1, 160)]
        words += [rng.choice("abcd") for _ in range(rng.randrange(6))]
    assert pr.find_runs(numbers(words)) == by_definition(words)
    for least, exponent in ((4, 2), (10, 3), (6, 4), (1, 2), (50, 5)):
        assert pr.find_runs(numbers(words), least, exponent) == by_definition(words, least, exponent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=90))
def test_runs_over_two_words(words):
    assert pr.find_runs(numbers(words), 5, 2) == by_definition(words, 5, 2)
    assert pr.find_runs(numbers(words), 24, 3) == by_definition(words)


def test_least_overlap_is_the_minimum_over_all_periods():
    for least in range(1, 60):
        for exponent in range(2, 7):
            assert pr.least_overlap(least, exponent) == min(max(least, exponent * q) - q for q in range(1, 200))
    assert pr.least_overlap(24, 3) == 16


def test_the_mask_covers_every_run():
    rng = random.Random(3)
    for _ in range(60):
        unit = [rng.choice("abcdef") for _ in range(rng.randrange(1, 30))]
        words = [f"x{k}" for k in range(30)] + unit * 4 + [rng.choice("abc") for _ in range(40)]
        mask = pr.Stretches(numbers(words)).repeated(16)
        for s, length, _ in by_definition(words):
            assert mask[s : s + length].all()
        assert not mask[:14].any()


def test_colliding_hashes_cost_nothing_but_time(monkeypatch):
    """With hashes that can't tell words apart, runs are still those of the words."""
    monkeypatch.setattr(pr, "mix", lambda h: h & np.uint64(1))
    rng = random.Random(4)
    for _ in range(40):
        words = [rng.choice("abcd") for _ in range(rng.randrange(20))] + [rng.choice("abcdef") for _ in range(rng.randrange(1, 12))] * rng.randrange(3, 9)
        assert pr.find_runs(numbers(words), 8, 3) == by_definition(words, 8, 3)


def test_documents_equal_the_contract(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(150):
        line = " ".join(rng.choice(["w", "é", "W", "x1", "中"]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60)))
        texts.append(rng.choice([line, f"{line}\n{line}\t{line}  {line}", " ".join(["a"] * rng.randrange(60)), f"head {line} {line} {line} {line} tail"]))
    rows = [*enumerate(texts), *enumerate([None, "", " \n\t", "one", "a " * 24, "b " * 23, "\x0b\x0c\r a\xa0b c", "a" * 30000], 1000), (7, texts[7]), (7, texts[7]), (None, "a b " * 20), (None, None)]
    df = spark.createDataFrame([(i, t, "l", "r", "i", 1, "c") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in pr.run_digests(df).collect()), key=str)
    assert got == sorted((digest_row(i, t) for i, t in rows), key=str)
    assert pr.run_digests(df.where("false")).collect() == []


def test_registered_query_over_a_whole_table(spark):
    """All rows of the smallest folder whose texts are short enough for the definition."""
    from docloom.llm.queries import op11_periodic_runs

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in op11_periodic_runs(spark, folder).collect()}
    assert got.keys() == docs.keys()
    short = [i for i, t in docs.items() if len((t or "").split()) <= 700]
    assert len(short) > 100
    for i in short:
        assert got[i] == digest_row(i, docs[i])


def test_operator_returns_runs_and_text(spark):
    df = spark.createDataFrame([(1, "say " + "again and " * 15 + "end")], "doc_id bigint, text string")
    row = pr.collapse_runs(df).first()
    assert row["collapsed"] == "say again and end" and [tuple(r) for r in row["runs"]] == [(1, 30, 2)] and row["n_words"] == 32


@pytest.mark.parametrize("text", ["a " * 400_000, " ".join(str(k % 1000) for k in range(300_000)), " ".join(str(k * k % 7919) for k in range(300_000))])
def test_long_texts_take_time_in_proportion(text):
    began = time.perf_counter()
    _, _, x = pr.Words()(text.encode())
    runs = pr.find_runs(x)
    assert len(runs) == 1 and runs[0][:2] == (0, len(x))
    assert time.perf_counter() - began < 60
