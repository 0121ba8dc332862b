"""Alignment of two tokenizers against a plain two-pointer walk over the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankforge.llm import alignment, queries
from rankforge.llm.alignment import TokenizerPair, align_documents, crossings, merge_links, pair_counts, with_pair_counts

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


@pytest.fixture(scope="module")
def pair():
    with open(A_FILE, encoding="utf-8") as f, open(B_FILE, "rb") as g:
        return TokenizerPair(f.read(), g.read())


def plain_links(a, b):
    i = j = g = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((i, j, g))
        x, y = a[i], b[j]
        g += x == y
        i, j = i + (x <= y), j + (y <= x)
    return out


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.integers(1, 4), max_size=200), st.randoms(use_true_random=False), st.sampled_from([1, 2, 3, 7, 64])
)
def test_merge_links(sizes, rng, piece):
    a = np.cumsum(np.array(sizes, dtype=np.int64))
    n = int(a[-1]) if len(a) else 0
    b = np.array(sorted(x for x in range(1, n + 1) if x == n or rng.random() < 0.4), dtype=np.int64)
    got = list(zip(*(x.tolist() for x in merge_links(a, b, piece)), strict=True))
    assert got == plain_links(a.tolist(), b.tolist())
    every = np.arange(len(a) + len(b) + 1)
    taken = np.cumsum([0] + [side == 0 for _, side in sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])])
    assert crossings(a, b, every).tolist() == taken.tolist()


def test_one_side_without_cuts_crosses_every_piece():
    """A group far longer than a piece is stitched from all of them."""
    a, b = np.arange(1, 100_001), np.array([50_000, 100_000])
    i, j, g = merge_links(a, b, 64)
    assert len(i) == 100_000 and (g == (i >= 50_000)).all() and (j == g).all()


def whole(libraries, pair, text):
    """Ids by the libraries over the whole text; none if the bytes do not come back."""
    if not text:
        return [], []
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[x] for x in a) != raw or b"".join(pair.b_bytes[x] for x in b) != raw:
        return [], []
    return a, b


def test_segments_are_encoded_as_in_the_whole_text(libraries, pair, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT_CHARS", 3)
    assert pair.ranked is not None
    rng = random.Random(11)
    parts = [
        "a", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "日本", "🙂", "1", "²", "the", "<|endoftext|>", "\xa0",
        "▁", "<s>", "<0x41>", "000", "--", "ﬁ", "é", "word", " word", "\r\n", "\x00", "ß", "ك", "​", "Ω", "я", "한", "हिन्दी", "\u1c89", "𐐀", "①",
    ]
    assert pair.cuttable
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        got = tuple(x.tolist() for x in pair.encode(text))
        assert got == tuple(whole(libraries, pair, text)), repr(text)


def brute(libraries, pair, rows):
    """Contract columns of (key, text) rows."""
    made, counts = {}, Counter()
    for key, text in rows:
        a, b = whole(libraries, pair, text)
        ends_a, ends_b = np.cumsum([len(pair.a_bytes[x]) for x in a]).tolist(), np.cumsum([len(pair.b_bytes[x]) for x in b]).tolist()
        links = plain_links(ends_a, ends_b)
        groups = defaultdict(lambda: ([], []))
        for i, j, g in links:
            for side, ids, n in ((0, a, i), (1, b, j)):
                if n not in groups[g][side]:
                    groups[g][side].append(n)
        text_of = ";".join(
            ",".join(str(a[i]) for i in groups[g][0]) + "|" + ",".join(str(b[j]) for j in groups[g][1]) for g in sorted(groups)
        )
        counts.update({(a[i], b[j]) for i, j, _ in links})
        made[key] = [len(a), len(b), len(groups), [(a[i], b[j]) for i, j, _ in links], text_of]
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return {
        key: (
            n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), text_of
        )
        for key, (n_a, n_b, n_groups, links, text_of) in made.items()
    }, counts


def test_query(spark, sf, texts, libraries, pair):
    want, _ = brute(libraries, pair, texts.items())
    got = queries.op13_alignment(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        *numbers, groups = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == tuple(numbers)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_odd_rows_and_blocks(spark, odd, nothing, libraries, pair, monkeypatch):
    """Nulls, empty and long texts, repeated rows, clashing names; counts span blocks."""
    rows = [(n, r.doc_id, r.text) for n, r in enumerate(odd.collect())]
    df = spark.createDataFrame(
        [(n, i, t, "x", "y", 1) for n, i, t in rows],
        "n bigint, doc_id bigint, text string, block string, links string, row int",
    ).repartition(5, "n")
    want, counts = brute(libraries, pair, [(n, t) for n, _, t in rows])
    aligned = align_documents(df, A_FILE, B_FILE, ["n", "doc_id"]).cache()
    for r in aligned.collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (*want[r.n][:4], want[r.n][6])
    for r in with_pair_counts(aligned, ["n", "n_links"]).collect():
        assert (r.n_links, r.n_best, r.count_sum) == want[r.n][3:6]
    assert {(r.a_id, r.b_id): r.n_docs for r in pair_counts(aligned).collect()} == dict(counts)
    empty = align_documents(nothing, A_FILE, B_FILE, ["doc_id"])
    assert empty.collect() == [] and with_pair_counts(empty, ["doc_id"]).collect() == []
    blank = df.filter("text is null or text = ''")
    assert {(r.n_best, r.count_sum) for r in with_pair_counts(align_documents(blank, A_FILE, B_FILE, ["n"]), ["n"]).collect()} == {(0, 0)}


def test_a_text_of_megabytes(pair, libraries):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "naïve", "東京", "x" * 30, "don't", "1234567"]) for _ in range(200_000))
    made = alignment._align_block(pair, [None, text, ""])
    a, b = whole(libraries, pair, text)
    assert made["n_a"].to_pylist() == [0, len(a), 0] and made["n_b"].to_pylist() == [0, len(b), 0]
    links = plain_links(np.cumsum(pair.a_sizes[a]).tolist(), np.cumsum(pair.b_sizes[b]).tolist())
    assert made["n_links"].to_pylist() == [0, len(links), 0]
    assert made["n_groups"].to_pylist() == [0, links[-1][2] + 1, 0]
    assert made["groups"].to_pylist()[0] == ""
