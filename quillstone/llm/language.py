"""Language identification by cross-parsing entropy.

Each language is a suffix automaton of labelled words. A text is parsed, word by word, into the fewest phrases that occur in
the language: from where the last phrase ended, the automaton follows the word as far as it can. A phrase costs the
bits that point into the language's text, a letter that the language never has costs more; the language with
the fewest bits for each letter wins. Words are parsed with a space on both sides, so starts and ends of words count.

A word's costs depend on nothing but the word and are kept in a table of fixed size; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, sample_by_group, table

#: The bounded sample that languages are learned from: labelled documents for each language, the letters taken from one
#: document (a window at a hashed place of a longer one), the letters of different words for each language, and those of all languages,
#: which share them evenly if they are many.
SAMPLE_DOCS, SAMPLE_WINDOW, SAMPLE_LETTERS, ALL_LETTERS = 300, 20_000, 40_000, 2_560_000
#: Bits for a letter that a language doesn't have.
UNKNOWN_BITS = 24.0
WORDS_KEPT, LONGEST_KEPT = 250_000, 48
UNDETERMINED = "und"
#: Runs of letters, and of numbers that are no digits; what holds no letter is left out when its cost is worked out.
_WORD = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """All substrings of a text, as a deterministic automaton."""

    def __init__(self, text: str) -> None:
        link, length, edges = [-1], [0], [{}]
        last = 0
        for c in text:
            at = len(length)
            length.append(length[last] + 1)
            link.append(0)
            edges.append({})
            p, last = last, at
            while p >= 0 and c not in edges[p]:
                edges[p][c] = at
                p = link[p]
            if p < 0:
                continue
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[at] = q
                continue
            copy = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            edges.append(dict(edges[q]))
            while p >= 0 and edges[p].get(c) == q:
                edges[p][c] = copy
                p = link[p]
            link[q] = link[at] = copy
        # a state is from now on the table of its letters, which leads to the next state's table itself
        for out in edges:
            for c, t in out.items():
                out[c] = edges[t]
        self.root = edges[0]

    def parse(self, word: str) -> tuple[int, int]:
        """Phrases of the greedy parse of ``word``, and how many letters of it the text doesn't have."""
        root, state, phrases, unknown = self.root, None, 0, 0
        for c in word:
            if state is not None:
                state = state.get(c)
                if state is not None:
                    continue
            state = root.get(c)  # a new phrase starts with this letter
            if state is None:
                unknown += 1
            else:
                phrases += 1
        return phrases, unknown


class Model(dict):
    """Languages and their automata; as a dict, the rows in ``costs`` of the words met so far."""

    def __init__(self, texts: dict[str, str]) -> None:
        super().__init__()
        self.languages = sorted(texts)
        self.automata = [SuffixAutomaton(texts[x]) for x in self.languages]
        self.bits = [math.log2(max(2, len(texts[x]))) for x in self.languages]
        self.restart()

    def restart(self) -> None:
        """Forgets all words. Row 0 is for what holds no letter."""
        self.clear()
        self.costs = np.zeros((4096, len(self.languages)))
        self.rows = 1

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            return 0
        at = self.rows
        if at >= len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        spaced = f" {word} "
        self.costs[at] = [p * b + u * UNKNOWN_BITS for (p, u), b in zip([a.parse(spaced) for a in self.automata], self.bits, strict=True)]
        self.rows += 1
        if len(word) <= LONGEST_KEPT:
            self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        n = np.count_nonzero(at)
        if not n or not self.languages:
            return UNDETERMINED, 0.0
        bits = self.costs[at].sum(axis=0) / n
        if self.rows > WORDS_KEPT:  # the table holds this text's words on top
            self.restart()
        best = int(bits.argmin())
        return self.languages[best], float(1.0 / np.exp2(np.minimum(bits[best] - bits, 0.0)).sum())


_LOADED: dict[str, Model] = {}


def _model(texts: dict[str, str]) -> Model:
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(texts)
    return _LOADED[key]


def learn(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, str]:
    """The text of each language: different words of a bounded sample of the labelled rows that ``where`` allows.

    Every label that occurs is learned. The sample goes by hashed key, so it doesn't depend on the order of rows; of a very long text it takes a
    window. Rows without text or language are left out; an empty table teaches nothing.
    """
    allowed = F.coalesce(where & F.col(lang).isNotNull() & F.col(text).isNotNull(), F.lit(False))
    languages = docs.where(allowed).select(lang).distinct().count()
    most = min(SAMPLE_LETTERS, ALL_LETTERS // max(1, languages))
    start = 1 + F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(31)), F.greatest(F.lit(1), F.length(text) - SAMPLE_WINDOW + 1)).cast("int")
    rows = sample_by_group(docs, lang, key, SAMPLE_DOCS, allowed).select(lang, F.substring(F.col(text), start, F.lit(SAMPLE_WINDOW)).alias(text)).orderBy(lang, F.xxhash64(text), text)
    words: dict[str, dict[str, None]] = {}
    letters: dict[str, int] = {}
    for x, t in rows.toLocalIterator():
        own = words.setdefault(x, {})
        for w in _WORD.findall(t.lower()):
            if w not in own and letters.get(x, 0) + len(w) <= most:
                own[w] = None
                letters[x] = letters.get(x, 0) + len(w) + 1
    return {x: f" {' '.join(own)} " for x, own in words.items()}


def predict(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learned. Ties go to the
    first language by code point. Rows are independent of one another and of their order; an empty table stays
    empty; columns that bear the results' names get an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most ALL_LETTERS letters

    def work(column: pa.Array) -> list[pa.Array]:
        model = _model(shared.value)
        found = [model.predict(t) for t in column.to_pylist()]
        return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    return arrow_columns(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work)


def remainder(key: str, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    texts = learn(docs, ~held)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), texts).drop("text")
