"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that byte-pair encoding produces. It starts as one state
with a loop for every byte and takes the merges one after another, each by the same gadget: for ``u v -> w``, what
follows ``u`` becomes a copy of its state without an arc for ``v``, and ``w`` gets an arc from wherever ``u`` has
one to a copy of where ``v`` led. After ``u`` the state depends on ``u`` alone, so there is a state for each token and a gadget
writes down three things: what ``u`` lost and when, whose state ``w`` copied, and whose arcs ``w`` took over. An arc stands if
nothing on those chains had been lost by then; arcs asked for are entered in a transition table.

A pre-split word is encoded by following its arcs from the start state to its last byte; there is one such path. Decoding
emits the labels of the arcs.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, table

#: The split before the merges, as byte-level tokenizers define it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's word table and of its transition table; a full table is emptied. Longer words are not kept.
WORDS_KEPT, ARCS_KEPT, LONGEST_KEPT = 250_000, 250_000, 48


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Words(dict):
    """Encoded words, made when asked for."""

    def __init__(self, auto: Automaton) -> None:
        super().__init__()
        self.auto = auto

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.auto.packed.__getitem__, self.auto.encode_word(word.encode())))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


class Automaton:
    """The automaton of a vocabulary file, and encoding and decoding by it."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.labels: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for word, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.labels[i] = word.encode()
        self.ids = {self.labels[i]: i for i in vocab.values()}
        self.longest = max(map(len, self.ids))
        self._build([m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]], vocab)
        self.packed = [np.int32(i).astype("<i4").tobytes() for i in range(len(self.labels))]
        self.splitter = regex.compile(SPLIT)
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.arcs: dict[int, bool] = {}
        self.words = _Words(self)

    def _build(self, merges: list[list[str]], vocab: dict[str, int]) -> None:
        n = len(self.labels)
        #: (token, token) to the merge from which on the state after the first has no arc for the second
        self.lost: dict[int, int] = {}
        #: of a token: the one whose state its own was copied from, the one whose arcs it took over, the merge that made it,
        #: and up to when arcs for that token must have stood: equal halves go to the left first, so "u" has lost "u u" too
        self.copied, self.took, self.born, self.until = [-1] * n, [-1] * n, [-1] * n, [-1] * n
        for time, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if self.born[w] >= 0:
                raise ValueError(f"two merges make {left + right!r}")
            self.lost[u * n + v] = time
            self.copied[w], self.took[w], self.born[w], self.until[w] = v, u, time, time + (u == v)
        #: whether the start state has an arc for a token: it is a byte, or a merge makes it
        self.stands = [self.born[i] >= 0 or len(self.labels[i]) == 1 for i in range(n)]

    def arc(self, after: int, token: int) -> bool:
        """Whether the state after a token has an arc for ``token``; entered in the transition table."""
        n, lost, copied, born = len(self.labels), self.lost, self.copied, self.born
        found, y, y_until = True, token, n
        # the arc stands if none of what it was taken over from had been lost when that was done, neither by the
        # state itself nor by those it was copied from when they were copied
        while y >= 0 and found:
            z, z_until = after, n
            while z >= 0:
                time = lost.get(z * n + y)
                if time is not None and time < y_until and time < z_until:
                    found = False
                    break
                z_until, z = born[z], copied[z]
            y_until, y = self.until[y], self.took[y]
        if len(self.arcs) >= ARCS_KEPT:
            self.arcs.clear()
        self.arcs[after * n + token] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of a pre-split word.

        The automaton is followed with the longest token that it has an arc for. Every prefix has one encoding, so a place
        in the word is always reached in the same state, and one that leads nowhere is left for good.
        """
        ids, arcs, stands, n, longest, tokens = self.ids, self.arcs, self.stands, len(word), self.longest, len(self.labels)
        path: list[int] = []
        ends: list[int] = []
        start, end, last, dead = 0, min(n, longest), 0, set()
        while start < n:
            while end > start:
                t = ids.get(word[start:end])
                if t is not None and stands[t] and end not in dead:
                    found = arcs.get(last * tokens + t) if start else True
                    if found is None:
                        found = self.arc(last, t)
                    if found:
                        break
                end -= 1
            if end > start:
                path.append(t)
                ends.append(end)
                start, end, last = end, min(n, end + longest), t
            elif path:
                dead.add(start)
                path.pop()
                end = ends.pop() - 1
                start = ends[-1] if ends else 0
                last = path[-1] if path else 0
            else:
                raise ValueError("a byte is not in the vocabulary")
        return path

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit little-endian integers."""
        if self.cutter is None:
            return self._encode(text)
        parts = []
        for i, part in enumerate(self.cutter.split(text)):
            parts.append(np.int32(self.special[part]).tobytes() if i % 2 else self._encode(part))
        return b"".join(parts)

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.splitter.findall(text)))

    def decode(self, ids: list[int]) -> str:
        """The text that the labels of ``ids`` spell; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a file, built once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Automaton(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the token ids of ``text`` as an array of ints.

    A null or empty text has no ids. Special tokens in a text get their own ids. Rows are independent, whatever their
    number or order; words are kept in a table of fixed size, so very long texts and words need no more memory than
    themselves. ``path`` is a vocabulary file that every worker can read. A column already named ``out`` gets an underscore.
    """

    def work(texts: pa.Array) -> list[pa.Array]:
        auto = automaton(path)
        parts = [auto.encode(t) if t else b"" for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"), pa.int32()))]

    return arrow_columns(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], work)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the text of the token ids; null ids give the empty text, unknown ids an error."""

    def work(lists: pa.Array) -> list[pa.Array]:
        auto = automaton(path)
        return [pa.array([auto.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in lists], pa.string())]

    return arrow_columns(docs, ids, [T.StructField(out, T.StringType())], work)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its ids, by the same workers in one pass over the texts; see there for odd rows."""

    def work(texts: pa.Array) -> list[pa.Array]:
        auto = automaton(path)
        parts = [np.frombuffer(auto.encode(t), dtype="<i4") if t else np.zeros(0, dtype="<i4") for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, parts)])
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype="<i4")
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array([auto.decode(p.tolist()) for p in parts], pa.string())]

    return arrow_columns(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())], work)


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_path()
    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
