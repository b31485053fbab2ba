"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's score comes from features of the line and of the lines before and after it; a
transition matrix links the labels of neighbours. Training sets all lines of a labelled document to its label and climbs
the conditional likelihood; forward-backward gives each line its probability of being good, and a document's score
is the mean of those, weighted by the lines' lengths and brought to the scale of the labels by one logistic step.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, sample_by_group, table
from .language import remainder

#: The bounded sample of labelled documents that the model is fitted on, for each label, and their greatest length.
SAMPLE_DOCS, SAMPLE_LONGEST = 1500, 20_000
#: Steps and rate of the climb, and the weight of the squared parameters.
STEPS, RATE, PENALTY = 250, 0.08, 1e-3
#: Documents that score less are rejected.
THRESHOLD = 0.3
#: Characters that are looked at together.
CHUNK = 500_000

_OTHER, _SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _PLAIN, _BREAK = range(8)


def _classes() -> np.ndarray:
    """The class of each character of the basic plane; characters beyond count as other."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c == "\n":
            out[i] = _BREAK
        elif c.isspace():
            out[i] = _SPACE
        elif c.isupper():
            out[i] = _UPPER
        elif c.isalpha():
            out[i] = _LOWER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c in ".!?":
            out[i] = _STOP
        elif c in ",;:'\"()-’“”«»–—¿¡":
            out[i] = _PLAIN
    return out


_TABLE = _classes()
OWN = ("one", "length", "upper", "letters", "digits", "stops", "symbols", "spaces", "variety", "repeats", "word length", "ends well", "starts well", "seen before", "empty")
#: Features that a line takes over from each neighbour; and whether there is one.
SHARED = [OWN.index(x) for x in ("length", "upper", "stops", "symbols", "variety", "repeats", "word length", "ends well")]
WIDTH = len(OWN) + 2 * (len(SHARED) + 1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line features, line lengths, lines of each text); a text has one line at least."""
    if not texts:
        return np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0, dtype=np.int64)
    lines: list[str] = []
    per = np.zeros(len(texts), dtype=np.int64)
    seen_before: list[bool] = []
    for i, t in enumerate(texts):
        own = t.split("\n")
        per[i] = len(own)
        seen: set[str] = set()
        for x in own:
            seen_before.append(x in seen)
            seen.add(x)
        lines += own
    n = len(lines)
    length = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _TABLE[np.minimum(code, 0xFFFF)]
    kind[code > 0xFFFF] = _OTHER
    counts = np.zeros((n, 8))
    if len(code):
        counts = np.bincount(np.repeat(np.arange(n) * 8, length) + kind, minlength=n * 8).reshape(n, 8).astype(float)
    words = np.zeros((n, 3))
    for i, x in enumerate(lines):
        w = x.split()
        if w:
            words[i] = len(w), len(set(w)), sum(map(operator.eq, w, w[1:]))
    size = np.maximum(length, 1)
    w = np.maximum(words[:, 0], 1)
    letters = counts[:, _LOWER] + counts[:, _UPPER]
    ends = np.fromiter((x.rstrip()[-1:] in ".!?…" and x.strip() != "" for x in lines), dtype=float, count=n)
    starts = np.fromiter((x.lstrip()[:1].isupper() for x in lines), dtype=float, count=n)
    own = np.column_stack([
        np.ones(n), np.log1p(length) / 6, counts[:, _UPPER] / np.maximum(letters, 1), letters / size, counts[:, _DIGIT] / size, 4 * counts[:, _STOP] / np.maximum(words[:, 0], 1) / 4,
        4 * counts[:, _OTHER] / size, counts[:, _SPACE] / size, words[:, 1] / w, words[:, 2] / w, np.minimum(letters / w / 10, 3), ends, starts, np.array(seen_before, dtype=float), length == 0,
    ])
    first = np.cumsum(per) - per
    before, after = np.zeros((n, len(SHARED) + 1)), np.zeros((n, len(SHARED) + 1))
    before[1:, :-1], before[:, -1] = own[:-1][:, SHARED], 1
    after[:-1, :-1], after[:, -1] = own[1:][:, SHARED], 1
    before[first] = 0
    after[first + per - 1] = 0
    return np.hstack([own, before, after]), length, per


def marginals(emit: np.ndarray, link: np.ndarray, per: np.ndarray, want_pairs: bool = False):
    """Each line's probability of being good, for chains of ``per`` lines laid end to end.

    emit: score of good over bad; link: 2 x 2 scores of (label, next label). With ``want_pairs`` also the summed
    probabilities of neighbouring labels and the log of the partition function of each chain.
    """
    n = len(emit)
    score = np.column_stack([np.zeros(n), emit])
    order = np.argsort(-per, kind="stable")
    first = (np.cumsum(per) - per)[order]
    sizes = per[order]
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains with more than t lines
    ahead[first] = score[first]
    for t in range(1, longest):
        at = first[: active[t]] + t
        x = ahead[at - 1]
        ahead[at] = np.logaddexp(x[:, :1] + link[0], x[:, 1:] + link[1]) + score[at]
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        x = score[at + 1] + back[at + 1]
        back[at] = np.logaddexp(link[:, 0] + x[:, :1], link[:, 1] + x[:, 1:])
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    if not want_pairs:
        return good
    ends = np.cumsum(per) - 1
    whole = np.repeat(np.logaddexp(ahead[ends, 0], ahead[ends, 1]), per)
    inner = np.ones(n, dtype=bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(ahead[at][:, :, None] + link[None] + (score[at + 1] + back[at + 1])[:, None, :] - whole[at][:, None, None])
    return good, pairs


def weighted(good: np.ndarray, length: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The mean over each chain's lines, weighted by length + 1."""
    start = np.cumsum(per) - per
    w = length + 1.0
    return np.add.reduceat(good * w, start) / np.add.reduceat(w, start)


@dataclass
class Model:
    weights: np.ndarray
    link: np.ndarray
    scale: tuple[float, float]

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of texts, in chunks of bounded size."""
        out, chunk, held = [], [], 0
        for t in [*texts, None]:
            if t is None or held + len(t) > CHUNK:
                if chunk:
                    x, length, per = features(chunk)
                    raw = weighted(marginals(x @ self.weights, self.link, per), length, per)
                    out.append(1 / (1 + np.exp(-(self.scale[0] * (raw - 0.5) + self.scale[1]))))
                chunk, held = [], 0
            if t is not None:
                chunk.append(t)
                held += len(t)
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of labelled texts; without texts of both labels it scores every text the same."""
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), (0.0, 4.0 if labels and labels[0] else 0.0))
    x, length, per = features(texts)
    line = np.repeat(y, per)
    # both labels weigh the same, and a document's lines together as much as one line
    by = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    each = np.repeat(by / np.sqrt(per), per)
    ends = np.cumsum(per) - 1
    inner = np.ones(len(line), dtype=bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (line[at].astype(int), line[at + 1].astype(int)), each[at])
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, STEPS + 1):
        w, link = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        good, pairs = marginals(x @ w, link, per, want_pairs=True)
        g = np.concatenate([x.T @ (each * (line - good)), (seen - (pairs * each[at][:, None, None]).sum(axis=0)).ravel()]) / len(y) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, link = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    raw = weighted(marginals(x @ w, link, per), length, per) - 0.5
    a, b = 4.0, 0.0
    for _ in range(100):  # Newton's method for the logistic step, with the sample's own label shares
        p = 1 / (1 + np.exp(-(a * raw + b)))
        d = p * (1 - p) + 1e-9
        g = np.array([((y - p) * raw).sum() - 1e-2 * a, (y - p).sum()])
        h = np.array([[(d * raw * raw).sum() + 1e-2, (d * raw).sum()], [(d * raw).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
    return Model(w, link, (a, b))


def learn(docs: DataFrame, labels: DataFrame, where: Callable[[str], Column], text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """A model of a bounded sample of the labelled documents that ``where`` (a condition on a column of keys) allows.

    Labels other than 0 and 1, and documents without text, are left out. The sample goes by hashed key.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("__label"))
    marks = sample_by_group(marks, "__label", "__key", SAMPLE_DOCS, F.coalesce(where("__key"), F.lit(False)))
    # at most 2 * SAMPLE_DOCS keys
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= SAMPLE_LONGEST)).join(F.broadcast(marks), F.col(key) == F.col("__key")).select(text, "__label")
    rows = sorted((t, int(y)) for t, y in rows.toLocalIterator())
    return fit([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score reaches ``THRESHOLD``), from the text alone.

    Null texts score as empty ones, an empty text as one empty line. Rows are independent; repeated rows score the same; very long
    texts take memory in proportion to their own length. Columns that bear the results' names get an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH + 6 numbers

    def work(column: pa.Array) -> list[pa.Array]:
        found = shared.value.score([t or "" for t in column.to_pylist()])
        return [pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32), pa.int32())]

    return arrow_columns(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], work)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), lambda name: remainder(name, 5) != 0)
    return score(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model).drop("text")
