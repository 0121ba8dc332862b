"""Periodic runs against a plain scan of every lag, and the query against its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rankforge.llm import queries
from rankforge.llm.runs import find_runs, periodic_runs, planted_periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """Every maximal stretch of every lag, kept if no divisor of the lag is a period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                smaller = (d for d in range(1, q) if q % d == 0)
                if not any(all(w[t] == w[t + d] for t in range(i, i + length - d)) for d in smaller):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def strange(rng):
    """Sequences rich in nested, touching and overlapping runs."""
    k, n = rng.choice([1, 2, 2, 2, 3, 4]), rng.randint(0, 150)
    letters = lambda m: [rng.randrange(k) for _ in range(m)]
    kind = rng.randrange(6)
    if kind == 0:
        return letters(n)
    if kind == 1:
        return fibonacci(n)
    if kind == 2:
        return [bin(i).count("1") % 2 for i in range(n)]
    if kind == 3:  # two runs of one root that touch
        root = letters(rng.randint(1, 4))
        w = root * rng.randint(2, 40)
        w = w + w[: rng.randint(0, len(root))] + w[rng.randint(0, len(root)) :]
        return w + w[: rng.randint(0, len(w))]
    w = letters(rng.randint(1, 60))
    for _ in range(rng.randint(1, 6)):
        a = rng.randint(0, len(w))
        b = rng.randint(a, len(w))
        w = (w[:b] + w[a:b] * rng.randint(1, 6) + w[b:])[:300]
    return w


def test_all_runs_of_strange_sequences():
    rng = random.Random(7)
    codes = np.random.default_rng(5).integers(0, 2**63, 64).astype(np.uint64)
    names = {}
    for _ in range(30):
        group = [strange(rng) for _ in range(40)]
        words = codes[[names.setdefault(x, len(names)) for w in group for x in w]]
        docs = np.repeat(np.arange(len(group)), [len(w) for w in group])
        base = np.cumsum([0] + [len(w) for w in group])
        got = find_runs(words, docs)
        for d, w in enumerate(group):
            own = [(s - base[d], n, q) for s, n, q in got.tolist() if base[d] <= s < base[d + 1]]
            assert own == plain_runs(w), w


@pytest.mark.parametrize("words", [[0] * 400_000, [i % 10 for i in range(400_000)], ([0, 1] * 30_000 + [0]) * 2])
def test_a_frequent_gram_stays_cheap(words):
    """A gram that occurs everywhere has few partners, or none; all pairs would not end."""
    codes = np.random.default_rng(5).integers(0, 2**63, 10).astype(np.uint64)
    got = find_runs(codes[words], np.zeros(len(words), dtype=np.int64))
    if len(words) == 400_000:
        assert got.tolist() == [[0, 400_000, 10 if words[1] else 1]]
    else:
        # two long runs that touch: a square of every odd length around the seam
        assert len(got) > 29_000 and {q % 2 for _, _, q in got.tolist()[2:]} <= {0, 1}
        w = words
        for s, n, q in got.tolist()[:: len(got) // 50]:
            assert w[s : s + n - q] == w[s + q : s + n]
            assert (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q])


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def check(rows, texts):
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        if len(words) > 3000:
            continue  # the plain scan is quadratic; the exact method does not look at length
        found = plain_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        rest = " ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.n_runs == len(found) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)


def test_query(spark, sf, texts):
    rows = queries.op12_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    check(rows, texts)


def test_planting(spark, documents, texts):
    for r in planted_periods(documents).collect():
        assert WORD.findall(r.text or "") == planted(r.doc_id, texts[r.doc_id])


def test_odd_rows(spark, odd, nothing):
    got = periodic_runs(odd, ["doc_id", "n_chars", "row"]).collect()
    assert len(got) == odd.count()
    assert sorted((r.doc_id is None, r.n_words, r.collapsed) for r in got if not r.n_words) == [
        (False, 0, ""), (False, 0, ""), (False, 0, ""), (True, 0, "")
    ]
    prose = next(r for r in got if r.doc_id == 9)
    assert [tuple(x) for x in prose.runs] == [(0, prose.n_words, prose.n_words // 3)]
    assert len(prose.collapsed.split(" ")) == prose.n_words // 3
    assert periodic_runs(nothing, ["doc_id"]).collect() == []
    assert planted_periods(odd).count() == odd.count() and planted_periods(nothing).count() == 0


def test_a_text_of_millions_of_words(spark):
    line = "one two three four five six seven eight nine ten eleven\n"
    text = "start " + line * 150_000 + "end"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic_runs(df, ["doc_id"]).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 1_650_000, 11)]
    assert got[1].collapsed == "start " + line.strip() + " end" and got[2].collapsed == ""
