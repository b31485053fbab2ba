"""Suffix automata, the parse, and accuracy on held-out documents."""

import random
import zlib

from pyspark.sql import functions as F

from quillstone.llm import language as L


def greedy(text, word):
    at, phrases, unknown = 0, 0, 0
    while at < len(word):
        n = 0
        while at + n < len(word) and word[at : at + n + 1] in text:
            n += 1
        phrases, unknown, at = phrases + (n > 0), unknown + (n == 0), at + max(n, 1)
    return phrases, unknown


def test_parse_is_the_greedy_longest_match():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 80)))
        auto = L.SuffixAutomaton(text)
        for _ in range(20):
            word = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 25)))
            assert auto.parse(word) == greedy(text, word)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = L.op5(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    texts = {"aa": " house mouse tree ", "bb": " maison souris arbre "}
    docs = spark.createDataFrame([(1, "house", "x", 1), (1, "house", "x", 1), (None, None, None, None), (3, "", "y", 2), (4, "12 34 ½ ..", None, 3), (5, "souris " * 50_000, None, 3), (6, "жжж", None, 1)], "doc_id long, text string, lang_pred string, score int")
    got = {(r["doc_id"], r["lang_pred"]) for r in L.predict(docs, texts).collect()}
    assert got == {(1, "aa"), (None, "und"), (3, "und"), (4, "und"), (5, "bb"), (6, "aa")}
    assert {"lang_pred_", "score_"} <= set(L.predict(docs, texts).columns)
    assert L.predict(docs.limit(0), texts).count() == 0
    assert {r["lang_pred"] for r in L.predict(docs, {}).collect()} == {"und"}


def test_learning_leaves_out_what_it_may_not_use(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (2, "gamma", None), (3, None, "x"), (4, "delta", "y")], "doc_id long, text string, lang string")
    assert L.learn(docs, F.col("doc_id") != 4) == {"x": " alpha beta "}
    assert L.learn(docs.limit(0), F.lit(True)) == {}


def test_full_word_table_starts_again(monkeypatch):
    monkeypatch.setattr(L, "WORDS_KEPT", 3)
    model = L.Model({"aa": " one two three four ", "bb": " uno dos tres "})
    for _ in range(3):
        assert model.predict("one two three four five")[0] == "aa" and model.predict("uno dos tres")[0] == "bb"


def test_every_label_is_learned_and_long_texts_teach(spark):
    rng = random.Random(21)
    rows = []
    for n in range(70):
        letters = [chr(0x4E00 + 40 * n + i) for i in range(40)]
        text = " ".join("".join(rng.choices(letters, k=4)) for _ in range(5500 if n == 0 else 12))
        rows += [(2 * n, text, f"l{n:02}"), (2 * n + 1, text[:200], f"l{n:02}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = L.learn(docs, F.col("doc_id") % 2 == 0)  # of the first language only a long text
    assert len(learned) == 70
    got = L.predict(docs.where("doc_id % 2 = 1"), learned).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
