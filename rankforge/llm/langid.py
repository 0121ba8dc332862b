"""Language ID by hierarchical discrimination.

A linear classifier picks the language family first; inside the family, one-versus-one
linear support vector machines tell the closely related languages apart. Features are
hashed letter n-grams (1 to 3) of the whole text. Training takes a bounded sample of
labelled documents; prediction reads every document, whole, on the executors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.textops import mix64
from rankforge.session import measured

UNDETERMINED = "und"
DIMENSIONS = 1024  # per n-gram order, hashed
#: The training sample: expected documents of each language, and documents in all at most.
PER_LANGUAGE, IN_ALL = 500, 4_000
_RUN = 1 << 18  # bytes of text whose features are made at a time

#: Family of a language by its ISO 639-1 code; any other is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["ar", "he", "mt"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


@dataclass
class Model:
    """Pairs of classes with the weights that separate them: families, then languages."""

    members: dict[str, list[str]]
    family_pairs: list[tuple[str, str]]
    language_pairs: list[tuple[str, str]]
    weights: np.ndarray  # one row per pair, families first; the last column is the bias


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point its lower-case letter, 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length from hashed letter n-grams; and which texts hold a letter."""
    out = np.zeros((len(texts), 3 * DIMENSIONS), dtype=np.float32)
    table = _letters()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    letters = table[points]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    gap = letters == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # one gap ends a word
    keep |= first & gap
    letters, row = letters[keep].astype(np.uint64), row[keep]
    has = np.zeros(len(texts), dtype=bool)
    has[row[letters > 0]] = True
    key = np.zeros(len(letters), dtype=np.uint64)
    for order in range(3):
        n = len(letters) - order
        if n <= 0:
            break
        key = key[:n] * np.uint64(0x9E3779B97F4A7C15) + letters[order:] + np.uint64(1)
        inside = row[:n] == row[order:] if order else letters > 0
        spot = mix64(key[inside]) % np.uint64(DIMENSIONS)
        cell = row[:n][inside] * DIMENSIONS + spot.astype(np.int64)
        counts = np.bincount(cell, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[:, order * DIMENSIONS : (order + 1) * DIMENSIONS] = np.sqrt(counts / (3.0 * total))
    return out, has


def _runs(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows as (first, behind the last, texts); only one run's texts are held at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, size = at + 1, sizes[at]
        while end < len(sizes) and size + sizes[end] <= _RUN and end - at < 256:
            size += sizes[end]
            end += 1
        yield at, end, [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, texts in _runs(batch.column("text")):
            x, has = _features(texts)
            rows = [x[i].astype("<f2").tobytes() if has[i] else None for i in range(end - at)]
            lang, digest, rank = (batch.column(c).slice(at, end - at) for c in ("lang", "digest", "rank"))
            yield pa.RecordBatch.from_arrays([lang, digest, rank, pa.array(rows, type=pa.binary())], ["lang", "digest", "rank", "x"])


def _separate(x: np.ndarray, y: np.ndarray, rounds: int = 60, cost: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge), by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    step = 1.0 / (1.0 + 4.0 * cost)
    for k in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (x @ v))
        slope = v - 2.0 * cost * (x.T @ (share * y * slack))
        following = v - step * slope
        v = following + k / (k + 3.0) * (following - w)
        w = following
    return w


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model | None:
    """A model from rows (doc_id, text, lang); null languages and texts without letters are left out.

    The sample is the rows whose hash of doc_id and text falls below per_language over
    the language's rows, at most ``in_all`` by the hash times these rows, which takes the same part from every
    language of more than per_language; whole texts are read. None if
    nothing is left to learn from.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("text", "lang", F.xxhash64("doc_id", "text").alias("digest"))
    counts = measured(rows.groupBy("lang").agg(F.count("*").alias("n")))  # so that no text is shuffled
    chance = F.shiftrightunsigned("digest", 11) / F.lit(float(1 << 53))
    ranked = rows.join(counts, "lang").select("text", "lang", "digest", (chance * F.col("n")).alias("rank"))
    drawn = ranked.filter(F.col("rank") < per_language)
    made = drawn.mapInArrow(_sample_features, "lang string, digest bigint, rank double, x binary").filter(F.col("x").isNotNull())
    got = made.orderBy("rank", "digest", "lang").limit(in_all).drop("rank").toArrow()
    if not len(got):
        return None
    langs = np.array(got.column("lang").to_pylist())
    x = np.stack([np.frombuffer(b, dtype="<f2") for b in got.column("x").to_pylist()]).astype(np.float32)
    order = np.lexsort((got.column("digest").to_numpy(), langs))
    langs, x = langs[order], x[order]
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        members.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
    family = np.array([_FAMILY_OF.get(lang, lang) for lang in langs])
    family_pairs = list(combinations(sorted(members), 2))
    language_pairs = [p for f in sorted(members) for p in combinations(members[f], 2)]
    weights = [np.zeros(x.shape[1] + 1, dtype=np.float32)][:0]
    for classes, pairs in ((family, family_pairs), (langs, language_pairs)):
        for a, b in pairs:
            here = (classes == a) | (classes == b)
            weights.append(_separate(x[here], np.where(classes[here] == a, 1.0, -1.0).astype(np.float32)))
    matrix = np.stack(weights) if weights else np.zeros((0, x.shape[1] + 1), dtype=np.float32)
    return Model(members, family_pairs, language_pairs, matrix)


def _choose(names: list[str], pairs: list[tuple[str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one: most duels won, ties by the sum of margins; and a score per choice.

    The score is the weakest duel of the winner, as a logistic of its margin.
    """
    n = len(margins)
    if len(names) == 1:
        return np.zeros(n, dtype=int), np.ones(n)
    at = {name: i for i, name in enumerate(names)}
    won, total = np.zeros((n, len(names))), np.zeros((n, len(names)))
    least = np.full((n, len(names)), np.inf)
    for k, (a, b) in enumerate(pairs):
        m = margins[:, k]
        for name, sign in ((a, 1.0), (b, -1.0)):
            won[:, at[name]] += sign * m > 0
            total[:, at[name]] += np.tanh(sign * m)
            least[:, at[name]] = np.minimum(least[:, at[name]], sign * m)
    pick = np.argmax(won + total / (4.0 * len(names)), axis=1)
    return pick, 1.0 / (1.0 + np.exp(-4.0 * least[np.arange(n), pick]))


def classify(texts: list[str], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score (0 to 1) of whole texts; ``und`` and 0 without a letter or a model."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None or not texts:
        return langs, scores
    x, has = _features(texts)
    margins = x @ model.weights[:, :-1].T + model.weights[:, -1]
    families = sorted(model.members)
    split = len(model.family_pairs)
    family, sure = _choose(families, model.family_pairs, margins[:, :split])
    for f, name in enumerate(families):
        rows = np.flatnonzero((family == f) & has)
        pairs = [(k, p) for k, p in enumerate(model.language_pairs) if p[0] in model.members[name]]
        inner = margins[rows][:, [split + k for k, _ in pairs]]
        pick, sure_inner = _choose(model.members[name], [p for _, p in pairs], inner)
        for i, r in enumerate(rows):
            langs[r], scores[r] = model.members[name][pick[i]], float(sure[r] * sure_inner[i])
    return langs, scores


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, texts in _runs(batch.column("text")):
            langs, scores = classify(texts, model)
            own = batch.column("row").slice(at, end - at)
            yield pa.RecordBatch.from_arrays([own, pa.array(langs), pa.array(scores)], ["row", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, lang_pred and score (double, 0 to 1) for every whole text.

    A null text and one without letters are ``und`` with score 0. Only text is looked at.
    """
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    shape = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(partial(_predict, model=model), shape).select("row.*", "lang_pred", "score")
