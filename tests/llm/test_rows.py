"""Language ID, BPE, mixing, quality, licences and chat against references and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rankforge.llm import queries
from rankforge.llm.bpe import TextEncoder, decode_documents, encode_documents, read_ranks
from rankforge.llm.chat import format_conversations, read_loss, read_turns
from rankforge.llm.langid import classify, predict, train
from rankforge.llm.licenses import BASE_PHRASES, TEMPLATES, scan_licenses
from rankforge.llm.mixing import mix_sources, mixed_documents, source_targets
from rankforge.llm.quality import estimate, quality, quality_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, sf, texts, reference):
    for r in queries.op3_bpe(spark, sf).collect():
        text = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_strings_and_edits(ranks, reference):
    own = TextEncoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "日本", "🙂", "1", "²", "the", "<|endoftext|>", "\xa0", "0" * 9, "--", "\x00"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert own.encode(s) == np.array(reference.encode_ordinary(s), "<u4").tobytes(), repr(s)
    coder = own.coder
    for _ in range(500):
        data = bytes(rng.choices(b"abeinrst", k=rng.randint(0, 60)))
        last = coder.extend(data, [])
        assert coder.extend(data + b"ing", list(last)) == coder.extend(data + b"ing", [])
        i = rng.randint(0, len(data))
        j, new = rng.randint(i, len(data)), bytes(rng.choices(b"abe", k=rng.randint(0, 5)))
        edited, fresh = coder.edit(data, last, i, j, new)
        assert edited == data[:i] + new + data[j:] and fresh == coder.extend(edited, [])


def test_bpe_odd(odd, nothing):
    done = decode_documents(encode_documents(odd, RANKS, public_tokenizers.PATTERN, ["doc_id", "text"]), RANKS)
    rows = done.collect()
    assert len(rows) == 15 and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert encode_documents(nothing, RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_mixing(documents, texts):
    rows = mix_sources(documents).collect()
    source = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    sums = Counter()
    for i, s in source.items():
        sums[s] += size[i]
    names = sorted(sums)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left = {}, 1.5 * sum(sums.values())
    free = set(names)
    while free:  # reshare until none is above twice its size
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sums[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * sums[s] for s in over}
        left -= sum(2.0 * sums[s] for s in over)
        free -= over
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[source[r.doc_id]] and r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    largest = defaultdict(int)
    for i, s in source.items():
        largest[s] = max(largest[s], size[i])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = mix_sources(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_keeps_chances(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string")
    seen = Counter()
    for seed in range(4):
        for r in mix_sources(docs, share=0.5, seed=seed).collect():
            seen[r.doc_id % 2, r.copies] += 1
    rate = {s: sum(c * n for (x, c), n in seen.items() if x == s) / 800 for s in (0, 1)}
    assert rate[0] == pytest.approx(0.75, abs=0.06) and rate[1] == pytest.approx(0.25, abs=0.06)


def test_mixing_odd(odd, nothing):
    rows = mix_sources(odd).collect()
    assert len(rows) == 15 and all(r.taken <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (3, 4, 5)} == {0}
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mix_sources(nothing).count() == 0 and mixed_documents(nothing).count() == 0


def test_targets_all_full(spark):
    sized = spark.createDataFrame([("a", 5), (None, 7)], "source string, size bigint")
    got = {r.source: r.target for r in source_targets(sized, 2.0, (3, 1, 2), 2.0).collect()}
    assert got == {"a": 10.0, None: 14.0}


def test_quality_query(spark, sf, texts):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in queries.op5_quality(spark, sf).collect():
        text = texts[r.doc_id] or ""
        w = WORD.findall(text)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often = Counter(windows)
        inside = {j + k for j, x in enumerate(windows) if often[x] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
        if r.doc_id in label and not r.base_failed:
            assert r.kept == (label[r.doc_id] == 1)


def test_repeated_windows_of_very_long_texts(spark):
    """Hashes of few bits meet by chance in a long text; equal words decide."""
    n = 4_000_000
    different = spark.range(1).select(
        F.lit(1).cast("bigint").alias("doc_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), F.hex(i))), " ").alias("text"),
    )
    got = quality_measures(different).select("n_words", "n_repeat_words", "n_different").first()
    assert tuple(got) == (n, 0, n)
    some = different.withColumn("text", F.concat("text", F.lit(" w1 w2 w3 w4 x w1 w2 w3")))
    assert quality_measures(some).first().n_repeat_words == 4 + 4 + 3


def test_quality_odd(odd, nothing):
    rows = quality(odd).collect()
    assert len(rows) == 15 and all(r.kept is not None for r in rows) and quality(nothing).count() == 0
    assert not any(r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert estimate([]) == (0.5, estimate([])[1])


def test_license_query(spark, sf, texts):
    for r in queries.op6_licenses(spark, sf).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], []
        for label, phrase in BASE_PHRASES:
            p = phrase.split()
            at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            places += at
            labels += [label] * bool(at)
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert ("mit" in r.labels.split(",")) == ("mit license" in low)


def test_licenses_odd(odd, nothing, spark):
    rows = {r.doc_id: r for r in scan_licenses(odd).collect()}
    assert rows[3].n_words == rows[4].n_words == 0 and rows[3].labels == "" and scan_licenses(nothing).count() == 0
    said = "CC BY cc-by cc by-NC 4.0! General Public\nLicense. x all rights reserved; Released under the MIT License"
    r = scan_licenses(spark.createDataFrame([(1, said)], "doc_id bigint, text string")).first()
    assert (r.n_base, r.first_word, r.base_labels) == (5, 0, "cc-by,gpl,reserved") and "mit" in r.labels and r.score == 1.0


def test_licenses_of_a_notices_file(spark):
    """A file with every template, in any order and beside other words, has a full match of each."""
    rows = [(0, " filler ".join(text for _, text, _ in TEMPLATES)), (1, " and the ".join(text for _, text, _ in reversed(TEMPLATES)))]
    rows += [(2 + t, text) for t, (_, text, _) in enumerate(TEMPLATES)]
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        words, want = dict(rows)[r.doc_id].split(), set()
        for label, text, key in TEMPLATES:
            body, wanted = text.split(), key.split()
            ahead = next(i for i in range(len(body)) if body[i : i + len(wanted)] == wanted)
            for at in range(len(words)):
                if words[at : at + len(wanted)] == wanted:
                    same = sum(0 <= at - ahead + k < len(words) and words[at - ahead + k] == w for k, w in enumerate(body))
                    want.add((label, at - ahead, same / len(body)))
        assert {tuple(m) for m in r.matches} == want and r.score == 1.0


def test_langid_query(spark, sf):
    got = queries.op7_langid(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_sample_keeps_languages_of_any_size(spark):
    """A cap on the sample takes the same part of each language, large or of middle size."""
    sizes = {"aa": 6000, "bb": 6000, "cc": 100, "dd": 101, "ee": 102, "ff": 103}
    rows = [(1000000 * k + i, f"{lang * 3} {lang}{lang[::-1]} x", lang) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    model = train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=40, in_all=60)
    assert model.members == {lang: [lang] for lang in sizes}
    assert [classify([f"{lang * 3} {lang}{lang[::-1]} x"], model)[0][0] for lang in sizes] == list(sizes)


def test_langid_odd(odd, nothing, documents):
    model = train(documents)
    rows = defaultdict(set)
    for r in predict(odd, model, ["doc_id", "row"]).collect():
        rows[r.doc_id].add(r.lang_pred)
    assert rows[3] == rows[4] == rows[5] == rows[6] == {"und"} and rows[1] == {"en"}
    assert predict(nothing, model, ["doc_id"]).count() == 0 and train(nothing) is None
    assert {r.lang_pred for r in predict(odd, None, ["doc_id"]).collect()} == {"und"}
    assert classify(["", "the house"], model)[0][0] == "und"


def test_chat_query(spark, sf):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op10_chat(spark, sf).collect()}
    assert set(got) == set(turns)
    for k, rows in turns.items():
        told = "".join(f"{role}\n{text}\n" for _, role, text in sorted(rows))
        loss = "".join(text for _, role, text in sorted(rows) if role == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(rows), hashlib.sha256(told.encode()).hexdigest())
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_odd(spark):
    hard = ["<|", "<&|", "<&&|im_end|>", "<|im_turn|>", "", None, "a\nb", "<", "|>", "<|im_start|>user\nx<|im_end|>\n", "🙂<&", "$1\\"]
    rows = [(1, i, "user" if i % 5 < 2 else "assistant", t, "x") for i, t in enumerate(hard)]
    rows += [(2, None, None, "first", "x"), (2, 1, "odd\nrole<|", "second", "x"), (2, 1, "odd\nrole<|", "second", "x"), (None, 0, "user", "q", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n string")
    made = format_conversations(turns)
    read = {
        r.conv_id: r
        for r in made.select("conv_id", "n_blocks", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    }
    assert [(t.role, t.text) for t in read[1].t] == [(r[2], r[3] or "") for r in rows[:12]]
    assert read[1].loss == "".join(r[3] or "" for r in rows[:12] if r[2] == "assistant") and read[1].n_blocks == 5
    assert [(t.role, t.text) for t in read[2].t] == [("", "first"), ("odd\nrole<|", "second"), ("odd\nrole<|", "second")]
    assert read[None].t[0].text == "q"
    assert format_conversations(turns.limit(0)).count() == 0
