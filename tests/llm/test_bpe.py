"""The automaton against the tokenizers library, and round trips."""

import hashlib
import random

import pytest

from quillstone.llm import bpe


@pytest.fixture(scope="module")
def auto():
    return bpe.Automaton(bpe.public_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path())


def ids(auto, text):
    import numpy as np

    return np.frombuffer(auto.encode(text), dtype="<i4").tolist()


def test_same_ids_as_the_library(auto, library):
    rng = random.Random(5)
    alphabet = "etaoinshr dlucmfwyp    \n\t'sdl0123456789.,!?#é漢字😀\x85\x1c½_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(500)]
    texts += ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "  <|endoftext|>  x", "a" * 5000, "#" * 41, " " * 3000 + "x", "the" * 2000, "it's we'll I'd", ""]
    texts += ["a".join(chr(c) for c in range(s, s + 700) if not 0xD800 <= c < 0xE000) for s in range(0, 0x30000, 7000)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(auto, t) == want, t[:60]
        assert auto.decode(want) == library.decode(want, skip_special_tokens=False) == t


def test_automaton_accepts_only_encodings(auto):
    """Every split of a word into tokens that the automaton accepts is the encoding itself."""
    for word in (b"theother", b"aaaa", b" hello", b"#####", b"inging"):
        found = []

        def walk(at, path, word=word, found=found):
            if at == len(word):
                found.append(path)
            for end in range(at + 1, len(word) + 1):
                t = auto.ids.get(word[at:end])
                if t is not None and auto.stands[t] and (not path or auto.arc(path[-1], t)):
                    walk(end, [*path, t])

        walk(0, [])
        assert found == [auto.encode_word(word)]


def test_small_tables_change_nothing(auto, monkeypatch):
    text = "the quick brown fox jumps over thirteen lazy dogs, again and again " * 5
    want = ids(auto, text)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 2)
    monkeypatch.setattr(bpe, "ARCS_KEPT", 2)
    assert ids(bpe.Automaton(bpe.public_path()), text) == want


def test_invalid_bytes_decode_to_replacements(auto):
    half = auto.ids[b"\xc3"]
    assert auto.decode([half]) == "�" and auto.decode([]) == ""


def test_query(spark, small, library):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = bpe.op8(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, None), (3, "", "y", 2), (4, "z" * 100_000, None, 3)], "doc_id long, text string, ids string, decoded int")
    got = bpe.decode(bpe.encode(docs, bpe.public_path()), bpe.public_path())
    assert {"ids_", "decoded_", "ids", "decoded"} <= set(got.columns)
    assert sorted((r["text"] or "") for r in got.collect()) == sorted(r["decoded"] for r in got.collect())
    assert bpe.encode(docs.limit(0), bpe.public_path()).count() == 0
