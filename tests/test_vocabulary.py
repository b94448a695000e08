from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fhirlake.operators import vocabulary


def brute(texts, rules, fits, default):
    out = []
    for n, text in texts:
        hits = [(p, label) for key, label, p in rules if text is not None and key is not None and label is not None and fits(text, key)]
        out.append((n, min(hits)[1] if hits else default))
    return out


def mine(spark, how, texts, rules, key, default="other"):
    df = spark.createDataFrame(texts, "n int, t string").repartition(3)
    table = spark.createDataFrame(rules, f"{key} string, label string, priority int")
    return sorted(tuple(r) for r in how(df, "t", table, "found", default).select("n", "found").collect())


KINDS = [
    (vocabulary.by_code, "code", lambda t, k: t == k),
    (vocabulary.by_suffix, "suffix", lambda t, k: t.lower().endswith(k.lower())),
    (vocabulary.by_substring, "word", lambda t, k: k.lower() in t.lower()),
]


@pytest.mark.parametrize(("how", "key", "fits"), KINDS)
@pytest.mark.parametrize("broadcast", [True, False])
def test_thousands_of_overlapping_rules(spark, monkeypatch, how, key, fits, broadcast):
    if not broadcast:
        monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", -1)
    rng = random.Random(8)
    word = lambda low, high: "".join(rng.choices("abAB ", k=rng.randint(low, high)))
    rules = [(word(3, 9), f"label {rng.randint(0, 30)}", rng.randint(0, 5)) for _ in range(2500)]
    rules += [("a", "one letter", 4), ("Bb", "two", 2), ("b b", "three", 1), (None, "no key", 0), ("ab", None, 0)]
    texts = [(n, rng.choice(rules)[0] if n % 3 else word(0, 12)) for n in range(900)] + [(900, None), (901, ""), (902, "x"), (903, "é" * 5)]
    texts += [(1000 + n, "the very same text aB") for n in range(300)]
    assert mine(spark, how, texts, rules, key) == brute(texts, rules, fits, "other")


@pytest.mark.parametrize(("how", "key", "fits"), KINDS)
def test_few_rules(spark, how, key, fits):
    texts = [(0, None), (1, ""), (2, "abc"), (3, "ABC"), (4, "(x)*[y]")]
    for rules in ([], [("", "any", 9)], [("", "any", 9), ("bc", "end", 1)], [("(x)*[y]", "marks", 1), ("zzzz", "never", 0)]):
        assert mine(spark, how, texts, rules, key, None) == brute(texts, rules, fits, None)
    assert mine(spark, how, [], [("a", "b", 1)], key) == []


def test_no_python_and_checked_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc")], "n int, t string")
    rules = spark.createDataFrame([("b", "x", 1)], "word string, label string, priority int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = vocabulary.by_substring(df, "t", rules, "found")._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", 10)
        large = vocabulary.by_substring(df, "t", rules, "found")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" in small and "Broadcast" not in large and "Python" not in small + large


def test_first_of(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "z", "x"), (3, "z", None)], "n int, code string, kind string")
    codes = spark.createDataFrame([("a", "by code", 1)], "code string, label string, priority int")
    kinds = spark.createDataFrame([("x", "by kind", 1)], "code string, label string, priority int")
    found = vocabulary.first_of(
        df, "found", lambda d, n: vocabulary.by_code(d, "code", codes, n), lambda d, n: vocabulary.by_code(d, "kind", kinds, n), default="none"
    )
    assert found.columns == [*df.columns, "found"]
    assert sorted(tuple(r) for r in found.select("n", "found").collect()) == [(1, "by code"), (2, "by kind"), (3, "none")]
    assert found.filter(F.col("found") == "none").count() == 1


def test_words_meet_few_texts_without_them(spark, monkeypatch):
    """Numbered words share all their short parts with each other, so short parts would pair nearly everything."""
    written = {}

    def keep(df, purpose):
        written[purpose] = through_table(df, purpose)
        return written[purpose]

    through_table = vocabulary.through_table
    monkeypatch.setattr(vocabulary, "through_table", keep)
    numbers = range(10_000, 13_000)
    df = spark.createDataFrame([(n, f"a Drug {n} mg") for n in numbers], "n int, t string")
    rules = spark.createDataFrame([(f"dRUG {n}", f"label {n}", 1) for n in numbers], "word string, label string, priority int")
    assert vocabulary.by_substring(df, "t", rules, "found").filter("found = concat('label ', n)").count() == 3000
    assert written["vocabulary-grams"].join(written["vocabulary-posted"], "gram").count() < 10 * 3000


def test_words_of_every_length(spark):
    rng = random.Random(3)
    rules = [("".join(rng.choices("abc", k=n)), f"label {n}", n % 4) for n in range(1, 60) for _ in range(3)]
    texts = [(n, "".join(rng.choices("abc", k=n % 5)) + rng.choice(rules)[0].upper() + "b") for n in range(300)]
    how, key, fits = KINDS[2]
    assert mine(spark, how, texts, rules, key) == brute(texts, rules, fits, "other")
