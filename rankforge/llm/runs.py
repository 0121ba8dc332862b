"""Periodic runs of words by seed-and-extend on diagonals.

A run of smallest period q and at least max(12, 2 q) words repeats at least six words at
distance q, and at least q of them. Six-word grams are therefore indexed for periods
below 12, and grams of k = 12, 24, 48, ... words for periods from k to 2 k: a run always
holds two occurrences of one gram at distance q. Pairs of occurrences inside a document
are seeds on the diagonal of their lag; a table per lag of the furthest word covered drops
seeds inside a stretch that was extended already.

Nothing is capped. A gram whose own period is at most k / 2 lies inside a shorter run that
is known by then; other grams cannot stand closer than k / 2, so each has at most three
partners with a lag below 2 k. What lies wholly inside shorter runs is a run again only
where two of them with one period touch, and those lags follow from the two runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.textops import list_array, mix64, text_runs, word_hashes

SHORTEST, SEED = 12, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Ids of the keys that occur more than once; -1 for the others."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    many = counts > 1
    ids = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
    return ids[which]


class _Grams:
    """Exact ids of word grams at the lengths 1, 2, 4, 6, 12, 24, ... (-1: occurs once).

    Grams never agree across documents, and two positions have equal grams if and only if
    their ids agree and are not -1.
    """

    def __init__(self, words: np.ndarray, docs: np.ndarray):
        self.n = len(words)
        self.ids: dict[int, np.ndarray] = {}
        own = mix64(docs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ words
        self.ids[1] = np.append(_repeated(own), np.int32(-1))
        for length, first, second in ((2, 1, 1), (4, 2, 2), (6, 4, 2)):
            self._join(length, first, second)
        self.top = SEED

    def _join(self, length: int, first: int, second: int) -> bool:
        a, b = self.ids[first], self.ids[second]
        made = np.full(self.n + 1, -1, dtype=np.int32)
        at = np.flatnonzero(a[: max(self.n + 1 - length, 0)] >= 0)
        at = at[b[at + first] >= 0]
        made[at] = _repeated(a[at].astype(np.int64) << 32 | b[at + first])
        self.ids[length] = made
        return bool(len(at)) and made.max() >= 0

    def double(self) -> bool:
        """Index grams of twice the length; False if none occurs twice."""
        found = self._join(2 * self.top, self.top, self.top)
        if not found:
            del self.ids[2 * self.top]
            return False
        self.top *= 2
        return True

    def close(self) -> None:
        """Index longer grams until none repeats: what ``ahead`` and ``behind`` need."""
        while self.double():
            pass

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on agree with those from y on."""
        done = np.zeros(len(x), dtype=np.int64)
        for length in sorted(self.ids, reverse=True):
            ids = self.ids[length]
            a, b = ids[np.minimum(x + done, self.n)], ids[np.minimum(y + done, self.n)]
            done += length * ((a >= 0) & (a == b))
        return done

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x agree with those before y."""
        done = np.zeros(len(x), dtype=np.int64)
        for length in sorted(self.ids, reverse=True):
            ids = self.ids[length]
            left = x - done - length
            a, b = ids[np.maximum(left, 0)], ids[np.maximum(y - done - length, 0)]
            done += length * ((left >= 0) & (a >= 0) & (a == b))
        return done


@lru_cache(maxsize=4096)
def _primes(q: int) -> tuple[int, ...]:
    found, f = [], 2
    while f * f <= q:
        if q % f == 0:
            found.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return tuple(found + [q] if q > 1 else found)


def _short_seeds(grams: _Grams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal six-word grams less than 12 words apart, as (position, lag)."""
    ids = grams.ids[SEED]
    at = np.flatnonzero(ids >= 0)
    found, lags = [], []
    for lag in range(1, 2 * SEED):
        hits = at[ids[np.minimum(at + lag, grams.n)] == ids[at]]
        found.append(hits)
        lags.append(np.full(len(hits), lag))
    return np.concatenate(found), np.concatenate(lags)


def _long_seeds(grams: _Grams, k: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal k-word grams at lags from k to 2 k, without grams of period k / 2 or less."""
    ids = grams.ids[k][: grams.n]
    inside = runs[(runs[:, 1] >= k) & (2 * runs[:, 2] <= k)]
    depth = np.zeros(grams.n + 1, dtype=np.int32)
    np.add.at(depth, inside[:, 0], 1)
    np.add.at(depth, inside[:, 0] + inside[:, 1] - k + 1, -1)
    at = np.flatnonzero((ids >= 0) & (np.cumsum(depth)[:-1] == 0))
    at = at[np.argsort(ids[at], kind="stable")]
    found, lags = [], []
    for ahead in (1, 2, 3):
        lag = at[ahead:] - at[:-ahead]
        hit = (ids[at[ahead:]] == ids[at[:-ahead]]) & (lag >= k) & (lag < 2 * k)
        found.append(at[:-ahead][hit])
        lags.append(lag[hit])
    return np.concatenate(found), np.concatenate(lags)


def _touching_seeds(grams: _Grams, k: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds at lags from k to 2 k between two touching runs of one period p <= k / 2.

    The lag is fixed modulo p by where the last p words of the left run first stand in the
    right one, and the parts that agree must be at least as long as the lag.
    """
    short = runs[2 * runs[:, 2] <= k]
    short = short[np.lexsort((short[:, 0], short[:, 2]))]
    one, two = short[:-1], short[1:]
    meet = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 0] + one[:, 1])
    # a lag of k needs k words on either side
    meet &= (one[:, 1] >= k) & (two[:, 1] >= k)
    one, two = one[meet], two[meet]
    period = one[:, 2]
    pair = np.repeat(np.arange(len(one)), period)
    shift = np.arange(len(pair)) - np.repeat(np.cumsum(period) - period, period)
    tail, place = (one[:, 0] + one[:, 1] - period)[pair], two[pair, 0] + shift
    fits = grams.ahead(tail, place) >= period[pair] if len(pair) else np.zeros(0, dtype=bool)
    pair, offset = pair[fits], (place - tail)[fits]
    p = period[pair]
    first = k + (offset - k) % p
    many = np.maximum(0, -(-(2 * k - first) // p))
    which = np.repeat(np.arange(len(pair)), many)
    lag = first[which] + p[which] * (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many))
    left, right = one[pair[which]], two[pair[which]]
    begin = np.maximum(left[:, 0], right[:, 0] - lag)
    end = np.minimum(left[:, 0] + left[:, 1], right[:, 0] + right[:, 1] - lag)
    use = end - begin >= lag
    return begin[use], lag[use]


def _extend(grams: _Grams, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of the stretches that the seeds lie in."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    # a seed right behind another one of its lag lies in the same stretch
    head = np.ones(len(at), dtype=bool)
    head[1:] = (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + 1)
    at, lag = at[head], lag[head]
    ends = at + grams.ahead(at, at + lag)
    # the table per lag: how far its diagonal is covered by the stretches before
    row = np.cumsum(np.append(0, lag[1:] != lag[:-1])) * (grams.n + 1) if len(lag) else lag
    covered = np.maximum.accumulate(row + ends)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = row[1:] + at[1:] >= covered[:-1]
    at, lag, ends = at[fresh], lag[fresh], ends[fresh]
    start = at - grams.behind(at, at + lag)
    same = ends - start
    good = (same >= lag) & (same + lag >= SHORTEST)
    start, lag, length = start[good], lag[good], (same + lag)[good]
    # the lag is the smallest period unless a quotient by a prime is one, too
    factors = [_primes(int(q)) for q in lag]
    each = np.repeat(np.arange(len(lag)), [len(f) for f in factors])
    part = lag[each] // np.array([f for fs in factors for f in fs], dtype=np.int64)
    smaller = grams.ahead(start[each], start[each] + part) >= length[each] - part
    primitive = np.ones(len(lag), dtype=bool)
    primitive[each[smaller]] = False
    return np.stack([start, length, lag], axis=1)[primitive]


def find_runs(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """All runs as rows (start, length, period), by start, then period.

    ``words`` holds 64-bit word hashes of documents one after the other and ``docs`` the
    number of each word's document; starts count from the first word of all.
    """
    grams = _Grams(words, docs)
    grams.close()
    runs = _extend(grams, *_short_seeds(grams))
    k = SHORTEST
    while k <= grams.top:
        seeds = zip(_long_seeds(grams, k, runs), _touching_seeds(grams, k, runs), strict=True)
        runs = np.concatenate([runs, _extend(grams, *map(np.concatenate, seeds))])
        k *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after its last one."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One string per row: its words joined by single spaces."""
    sizes = ends - starts
    gaps = np.ones(len(sizes), dtype=np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    gaps[last] = 0
    wide = sizes + gaps
    stop = np.cumsum(wide)
    made = np.full(int(wide.sum()), 0x20, dtype=np.uint8)
    target = np.repeat(stop - wide, sizes) + (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    made[target] = data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    edges = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
    raw = made.tobytes()
    return pa.array([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)], type=pa.string())


def _runs_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_runs(batch.column("text")):
            words, counts = word_hashes(data, offsets, lower=False)
            rows = np.repeat(np.arange(end - first), counts)
            runs = find_runs(words, rows)
            base = np.concatenate([[0], np.cumsum(counts)])
            owner = rows[runs[:, 0]] if len(runs) else np.zeros(0, dtype=np.int64)
            dropped = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
            np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(dropped)[:-1] == 0
            starts, ends = _word_spans(data, offsets)
            fields = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - base[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                ["start", "length", "period"],
            )
            sizes = np.bincount(owner, minlength=end - first)
            lists = pa.ListArray.from_arrays(list_array(np.zeros(len(runs)), sizes).offsets, fields)
            text = _joined(data, starts[kept], ends[kept], np.bincount(rows[kept], minlength=end - first))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(first, end - first), pa.array(counts), lists, text],
                ["row", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` has the words without those that a run holds after its first period,
    joined by one space. Words are runs of bytes outside U+0020 and U+0009 to U+000D, and
    are told apart by 64-bit hashes. A null or empty text has no runs and an empty
    ``collapsed``; repeated rows and null or repeated ids are rows like others; an empty
    table gives an empty one; columns outside ``keep`` are ignored. A text is one row of
    one task, whose memory follows the longest text (about 100 bytes a word).
    """
    row = docs.select(docs[text].alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    shape = f"row {row.schema['row'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string"
    return row.mapInArrow(_runs_of_texts, shape).select("row.*", "n_words", "runs", "collapsed")


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of equals the first by start, then period; null if none."""
    ranked = F.transform(
        runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b"))
    )
    best = F.array_max(ranked)
    return F.struct((-best["a"]).alias("start"), best["length"].alias("length"), (-best["b"]).alias("period"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, the text with a periodic tail where the id's CRC-32 ends in 0.

    With h the CRC-32 of the decimal id, g = h div 10 and n words: if h mod 10 = 0, word
    i >= a = g mod n becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null id
    plants nothing. Words and bounds are columns of their own, so that the lambda over the
    positions looks them up instead of splitting the text again.
    """
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    words = F.filter(F.split(docs["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), docs["text"].alias("text"),
        F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"),
    ).withColumn("_n", F.size("_words").cast("bigint"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.expr("(_n - _a) div (3 + _g % 8)"))
    moved = F.transform(
        "_words",
        lambda w, i: F.when(i < F.col("_a"), w).otherwise(
            F.element_at("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1).cast("int"))
        ),
    )
    text = F.when(F.col("_a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))
