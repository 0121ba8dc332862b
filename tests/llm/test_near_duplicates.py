"""N-gram join, line dedup, fingerprints and substring dedup against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankforge.llm.components import connected_components
from rankforge.llm.fingerprints import edited_fingerprints, near_duplicate_classes
from rankforge.llm.line_dedup import _verified, dedup_lines
from rankforge.llm.ngram_join import _cells, _classes, keep_representatives, ngram_jaccard_components
from rankforge.llm.substring_dedup import _longest, compact_windows, repeated_passages
from rankforge.session import CLEANUP, write_scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width, lower=True):
    w = WORD.findall((text or "").translate(LOW) if lower else text or "")
    return frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()


def alike(sets, percent):
    """Pairs of keys of ``sets`` of Jaccard similarity percent / 100 or more."""
    holders = defaultdict(list)
    for key, own in sets.items():
        for s in own:
            holders[s].append(key)
    met = Counter(p for keys in holders.values() for p in combinations(sorted(keys), 2))
    return [(a, b) for (a, b), n in met.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (2, 60)])
def test_ngram_join(documents, texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    want = Sets(sets)
    for a, b in alike(sets, percent):
        want.join(a, b)
    got = {r.doc_id: r for r in ngram_jaccard_components(documents, width, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: want.find(i) for i in sets}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_of_one_word_more_or_less(spark, width, percent):
    """Sets of 1 to 40 shingles, each with a near copy that has one word more or less at an end."""
    rows = []
    for size in range(1, 41):
        words = [f"s{size}w{i}" for i in range(size + width - 1)]
        for trial in range(3):
            own = [f"t{trial}{w}" for w in words]
            rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate([own, [*own, "more"]])]
            own = [f"d{w}" for w in own]
            rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate([own, own[1:]])]
    sets = {i: shingles(t, width) for i, t in rows}
    want = Sets(sets)
    for a, b in alike(sets, percent):
        want.join(a, b)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard_components(docs, width, percent).collect()}
    assert got == {i: want.find(i) for i in sets}


def test_ngram_join_chain_and_group(spark):
    """A chain of links whose ends do not link, and a group of near copies."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 50])) for i in range(8)]
    rows += [(100 + i, " ".join([f"v{j}" for j in range(80)] + [f"own{i}"])) for i in range(90)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    want = Sets(sets)
    for a, b in alike(sets, 85):
        want.join(a, b)
    assert got == {i: want.find(i) for i in sets}
    assert len({got[i] for i in range(8)}) == 1 and len({got[100 + i] for i in range(90)}) == 1


def test_ngram_join_odd(odd, nothing):
    got = sorted(map(tuple, ngram_jaccard_components(odd, 4, 85).collect()), key=str)
    by = defaultdict(set)
    for doc, n, comp in got:
        by[doc].add((n, comp))
    assert len(got) == 15
    assert by[1] == by[2] == {(4, 1)} and (4, 1) in by[None] and (0, None) in by[None]
    assert by[3] == {(0, 3)} and by[5] == {(0, 5)} and by[7] == {(19997, 7)} and by[8] == {(20000, 7)} and by[11] == {(1, 11)}
    assert ngram_jaccard_components(nothing, 4, 85).count() == 0
    kept = keep_representatives(odd, 4, 85)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and ids[1] == 1 and ids[2] == 0 and ids[8] == 0 and ids[3] == 1 and ids[None] == 2
    assert keep_representatives(nothing).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_cells_of_pairs(percent):
    """Sets at the threshold share a cell of the smaller one's class, however small; a common passage gives few."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 120), 500, 3000]:
        for m in {n, 100 * n // percent}:
            common = -(-percent * (n + m) // (100 + percent))
            if common > min(n, m):
                continue
            fresh = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), dtype=np.uint64) * np.uint64(2))
            fresh = rng.permutation(fresh)[: n + m - common]
            a, b = np.sort(fresh[:n]), np.sort(np.concatenate([fresh[:common], fresh[n:]]))
            of_a, of_b = _classes(n, percent), dict(_classes(m, percent))
            c, differ = of_a[0]
            assert c in of_b
            (w_a, one), (w_b, two) = _cells(a, c, differ), _cells(b, c, differ)
            need = max(1, max(w_a, w_b) - (100 - percent) * (n + m) // (100 + percent))
            assert len(np.intersect1d(one, two)) >= need
    passage = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, 350, dtype=np.uint64) * np.uint64(2)])) for _ in range(40)]
    keys = [set(_cells(s, *_classes(len(s), 85)[0])[1].tolist()) for s in sets]
    assert sum(len(a & b) for a, b in combinations(keys, 2)) < 3 * 40 * 39 / 2  # of 150 shingles each


def test_scratch_leaves_no_shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, asked = held.getAllFiles().size(), spark.conf.get(CLEANUP, None)
    table, _ = write_scratch(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while held.getAllFiles().size() > before and time.time() < until:
        time.sleep(0.2)
    assert held.getAllFiles().size() <= before
    assert table.count() == 7 and spark.conf.get(CLEANUP, None) == asked


def test_one_representative_of_recurring_ids(spark):
    """A near copy goes although its doc_id has another, unlinked text; near copies of one doc_id leave one."""
    words = " ".join(f"r{i}" for i in range(60))
    rows = [(1, words), (2, words + " more"), (2, " ".join(f"u{i}" for i in range(60)))]
    rows += [(3, " ".join(f"v{i}" for i in range(60))), (3, " ".join(f"v{i}" for i in range(61)))]
    kept = keep_representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.text for r in kept if r.doc_id < 3] and {(r.doc_id, r.text) for r in kept if r.doc_id < 3} == {rows[0], rows[2]}
    assert sum(r.doc_id == 3 for r in kept) == 1 and len(kept) == 3


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)]
    want = Sets({x for p in links for x in p})
    for a, b in links:
        want.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want.find(x) for x in touched}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_lines_not_their_shingles_reach_the_verification(spark):
    rng = random.Random(3)
    lines = ["short", "12345678"] + ["".join(rng.choice("abé𝄞 ") for _ in range(60)) for _ in range(6)]
    lines += [t[:-1] + "!" for t in lines] + [t + " and more" for t in lines]
    held = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    pairs = list(combinations(range(len(lines)), 2))
    got = _verified(spark.createDataFrame(pairs, "a bigint, b bigint"), held, 8, 80).collect()
    sets = {i: frozenset(t[j : j + 8] for j in range(max(1, len(t) - 7))) for i, t in enumerate(lines)}
    assert {(r.a, r.b) for r in got} == set(alike(sets, 80)) and got


def test_line_dedup(documents, texts):
    occurrences, sets = [], {}
    for i, t in sorted(texts.items()):
        for at, line in enumerate((t or "").split("\n")):
            if re.search(r"[^ \t\n\x0b\x0c\r]", line):
                occurrences.append((i, at, line))
                sets[line] = frozenset(line[j : j + 8] for j in range(len(line) - 7)) if len(line) > 8 else frozenset([line])
    same = Sets(sets)
    for a, b in alike(sets, 80):
        same.join(a, b)
    seen, gone = set(), defaultdict(set)
    for i, at, line in occurrences:
        gone[i] |= {at} if same.find(line) in seen else set()
        seen.add(same.find(line))
    got = {r.doc_id: r for r in dedup_lines(documents).collect()}
    assert {i: r.n_dropped for i, r in got.items()} == {i: len(gone[i]) for i in texts}
    for i, t in texts.items():
        assert got[i].text == "\n".join(x for at, x in enumerate((t or "").split("\n")) if at not in gone[i])


def test_line_dedup_odd(odd, nothing):
    out = dedup_lines(odd)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert set(out.columns) == set(odd.columns) | {"n_dropped"}
    assert [r.text for r in got[3]] == [None] and got[3][0].n_lines == 0
    assert [r.text for r in got[1]] == ["one two three four five six seven"] * 2
    assert got[2][0].n_dropped in (0, 1) and sorted(str(r.text) for r in got[None]) == ["", "None"]
    assert got[5][0].text == " \n\t " and got[5][0].n_dropped == 0 and got[8][0].n_dropped == 1
    assert {r.n_dropped for r in got[10]} == {0, 1}
    assert dedup_lines(nothing).count() == 0


def test_fingerprints(documents, texts):
    got = {r.doc_id: r for r in edited_fingerprints(documents).collect()}
    ids = sorted(texts)
    for at, i in enumerate(ids):
        t, following = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t, 5, False), shingles(edited, 5, False)
        if a and b:
            assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.3


def test_fingerprint_classes(documents, texts):
    sets = {i: shingles(t, 5, False) for i, t in texts.items()}
    want = Sets(sets)
    for a, b in alike(sets, 80):
        want.join(a, b)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(documents).collect()}
    wrong = [i for i in sets if sets[i] and got[i] != want.find(i)]
    assert not wrong


def test_fingerprints_odd(odd, nothing):
    rows = edited_fingerprints(odd).collect()
    prints = defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 256
    assert len(rows) == 15 and prints[1] < prints[None] and prints[3] == prints[4] == prints[5]
    assert edited_fingerprints(nothing).count() == 0 and near_duplicate_classes(nothing).count() == 0
    classes = {r.doc_id: r.class_id for r in near_duplicate_classes(odd).collect()}
    assert classes[8] == classes[7] == 7 and classes[11] == 11


def test_passages(documents, texts):
    places = defaultdict(set)
    words = {i: WORD.findall((t or "").translate(LOW)) for i, t in texts.items()}
    for i, w in words.items():
        for j in range(len(w) - 49):
            places[tuple(w[j : j + 50])].add((i, j))
    repeated = {p for s in places.values() if len({i for i, _ in s}) > 1 for p in s}
    got = {r.doc_id: r for r in repeated_passages(documents).collect()}
    covered = {i: set().union(*[range(s, e) for s, e in r.passages]) for i, r in got.items()}
    for i, j in repeated:
        assert set(range(j, j + 50)) <= covered.get(i, set())
    for i, r in got.items():
        assert r.n_words >= 50 and r.partner != i
        other = set(zip(*[words[r.partner][k:] for k in range(5)], strict=False))
        own = set(zip(*[words[i][k:] for k in range(5)], strict=False))
        assert len(own & other) >= 25


def test_near_passages_are_candidates(spark):
    """A 50-word passage with one word changed in the middle, between just two documents each."""
    rows, trials = [], 600
    for t in range(trials):
        core = [f"n{t}c{i}" for i in range(50)]
        for side, word in enumerate(("one", "two")):
            around = [[f"n{t}s{side}{end}{i}" for i in range(60)] for end in "ab"]
            rows.append((2 * t + side, " ".join(around[0] + core[:25] + [word] + core[26:] + around[1])))
    got = {r.doc_id // 2 for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) >= 0.98 * trials


def test_passages_around_a_differing_stretch(spark):
    """Two exact passages on one shift, 40 to 120 words apart, are both found."""
    rows = []
    for t in range(200):
        parts = [[f"f{t}p{p}w{i}" for i in range(50)] for p in range(2)]
        for side in range(2):
            gap = [f"f{t}s{side}g{i}" for i in range(40 + t % 81)]
            rows.append((2 * t + side, " ".join(parts[0] + gap + parts[1])))
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        n = len(text.split())
        spans = got[i].passages  # a ninth of a passage may differ, so that it can reach into the stretch
        assert [(p.start, p.end) for p in (spans[0], spans[-1])] == [(0, spans[0].end), (spans[-1].start, n)]
        assert len(spans) == 2 and spans[0].end >= 50 and spans[1].start <= n - 50 and got[i].n_words <= 120


def test_passages_that_a_third_document_holds_in_part(spark):
    """X and Y share what a third one has 47 words of, or X and Y are one word apart and the third one has other edits."""
    rows, trials = [], 120

    def add(i, t, name, core):
        around = [[f"{t}{name}{end}{k}" for k in range(40)] for end in "ab"]
        rows.append((i, " ".join(around[0] + core + around[1])))

    for t in range(trials):
        core = [f"e{t}c{i}" for i in range(50)]
        for k, own in enumerate((core, core, core[:47])):
            add(10 * t + k, f"e{t}", f"s{k}", own)
        core = [f"v{t}c{i}" for i in range(50)]
        for k, edits in enumerate(((), (24,), (10, 35))):
            own = [f"edit{t}{k}{i}" if i in edits else w for i, w in enumerate(core)]
            add(10 * t + 5 + k, f"v{t}", f"s{k}", own)
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    spans = [got[10 * t + k].passages[0] for t in range(trials) for k in (0, 1)]
    assert all(p.start <= 40 and p.end >= 90 for p in spans)
    assert sum(10 * t + 5 in got and 10 * t + 6 in got for t in range(trials)) >= 0.95 * trials


def test_passages_odd(odd, nothing, spark):
    got = {r.doc_id: r for r in repeated_passages(odd).collect()}
    assert set(got) == {7, 8} and got[7].n_words == 20_000 and got[7].partner == 8
    assert repeated_passages(nothing).count() == 0
    same = "again " * 3000
    rows = spark.createDataFrame([(1, same), (2, same), (3, "else " * 3000)], "doc_id bigint, text string")
    assert {r.doc_id for r in repeated_passages(rows).collect()} == {1, 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 8))
def test_windows_partition_the_subsequences(values, shortest):
    hashed = np.array(values, dtype=np.uint64)
    seen = Counter()
    for a, c, b in compact_windows(hashed, shortest):
        assert hashed[c] == hashed[a : b + 1].min()
        for i in range(a, c + 1):
            for j in range(c, b + 1):
                seen[i, j] += j - i + 1 >= shortest
    n = len(values)
    assert all(seen[i, j] == 1 for i in range(n) for j in range(i + shortest - 1, n))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=40))
def test_longest_run(agree):
    gain = np.array(agree) - 8 / 9
    start, end = _longest(gain)
    n = len(agree)
    best = max((j - i for i in range(n) for j in range(i + 1, n + 1) if 9 * sum(agree[i:j]) >= 8 * (j - i)), default=0)
    assert end - start == best


def test_line_recall_at_the_threshold(spark):
    """Planted pairs of lines at a similarity of 0.80 to 0.88, hardly above what links."""
    from rankforge.llm.line_dedup import line_links

    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz    "

    def shingles(s):
        return {s[i : i + 8] for i in range(max(1, len(s) - 7))}

    pairs = []
    while len(pairs) < 1500:
        a = "".join(rng.choices(letters, k=rng.randint(70, 180)))
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            b[rng.randrange(len(b))] = rng.choice("0123456789")
        b = "".join(b)
        x, y = shingles(a), shingles(b)
        if 0.80 <= len(x & y) / len(x | y) <= 0.88:
            pairs.append((a, b))
    docs = spark.createDataFrame([(i, a + "\n" + b) for i, (a, b) in enumerate(pairs)], "doc_id long, text string")
    lines = spark.createDataFrame([(i, s) for i, p in enumerate(pairs) for s in p], "pair long, line string")
    told = lines.select("pair", F.xxhash64("line").alias("node")).join(line_links(docs), "node")
    found = told.groupBy("pair", "component").count().filter("count = 2").count()
    assert found >= 0.985 * len(pairs)
    assert told.groupBy("component").agg(F.countDistinct("pair").alias("n")).filter("n > 1").count() == 0
