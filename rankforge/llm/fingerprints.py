"""Document fingerprints: MinHash in vectorised numpy, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.components import connected_components
from rankforge.llm.linking import Rule, leader_pairs, remaining_pairs, with_shared
from rankforge.llm.textops import list_array, mix64, shingle_hashes, text_runs, word_hashes
from rankforge.session import write_scratch

PERMUTATIONS, WIDTH = 64, 5
BANDS, ROWS = 16, 4  # at similarity 0.8 a pair meets in a band with probability 0.9998
#: Bounds that cut the order of documents into buckets; a bucket is streamed, not held.
MOST_BUCKETS = 4096
ROWS_PER_BUCKET = 1000

_SEEDS = np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
_A, _B = mix64(_SEEDS[:PERMUTATIONS]) | np.uint64(1), mix64(_SEEDS[PERMUTATIONS:])


def minhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signatures (rows, PERMUTATIONS) of 16 bits each; a text without words has all bits set.

    Permutation j is the universal hash (a_j x + b_j mod 2**64) / 2**32 of a shingle's
    64-bit hash; the low 16 bits of its minimum are kept.
    """
    words, counts = word_hashes(data, offsets, lower=False)
    shingles, sizes = shingle_hashes(words, counts, WIDTH)
    out = np.full((len(sizes), PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        scratch = np.empty_like(shingles)
        for j in range(PERMUTATIONS):
            np.multiply(shingles, _A[j], out=scratch)
            np.add(scratch, _B[j], out=scratch)
            least = np.minimum.reduceat(scratch, starts) >> np.uint64(32)
            out[full, j] = least.astype(np.uint16)
    return out


def _signatures(texts: pa.Array) -> np.ndarray:
    parts = [minhash(data, offsets) for _, _, data, offsets in text_runs(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint16)


def _hex(signatures: np.ndarray) -> pa.Array:
    return pa.array([row.astype(">u2").tobytes().hex() for row in signatures], type=pa.string())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; the last row of a bucket is the first of the next one, marked ``head``."""
    held: pa.RecordBatch | None = None
    held_sign: np.ndarray | None = None
    for batch in batches:
        signs = _signatures(batch.column("text"))
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            signs = np.concatenate([held_sign, signs])
        last = len(batch) - 1
        if last < 0:
            continue
        held, held_sign = batch.slice(last), signs[last:]
        heads = batch.column("head").to_pylist()
        own = np.flatnonzero(~np.array(heads[:last], dtype=bool))  # a head closes its bucket and is no row
        texts = batch.column("text").to_pylist()
        for part in np.array_split(own, max(1, len(own) // 256)):
            edited = []
            for i in part:
                cut = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            column = pa.array(edited, type=pa.large_string())
            edited_signs = _signatures(column)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(part)),
                    "n_chars": pa.array([len(texts[i]) for i in part], type=pa.int64()),
                    "edited": column.cast(pa.string()),
                    "fingerprint": _hex(signs[part]),
                    "edited_fingerprint": _hex(edited_signs),
                    "near_edited": pa.array((signs[part] == edited_signs).mean(axis=1)),
                    "near_next": pa.array((signs[part] == signs[part + 1]).mean(axis=1)),
                }
            )


def _bucket(value: Column, bounds: list) -> Column:
    """Number of bounds at or below ``value`` by binary search; a null is below all."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    rises = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(known, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at),
    )
    return rises


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint and that of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many of the next document, by ascending doc_id (null first, ties by a digest of the
    text), and the first document after the last. A null text is empty. near_edited and
    near_next are shares of equal signature entries; two texts without words are equal.
    Texts move once: rows are cut into ranges of doc_id that are sorted and streamed, and
    the first row of a range is sent to the range before it too.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))
    n = rows.count()
    wanted = min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET))
    bounds = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        got = rows.agg(F.percentile_approx("doc_id", shares, 10 * MOST_BUCKETS)).first()[0]
        bounds = sorted(set(got or []))
    cut = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest")
    firsts = cut.groupBy("bucket").agg(F.min(place).alias("p")).orderBy("bucket").collect()  # at most MOST_BUCKETS rows
    before = [firsts[i - 1]["bucket"] for i in range(len(firsts))]
    heads = docs.sparkSession.createDataFrame(
        [(f["p"]["doc_id"], f["p"]["digest"], b) for f, b in zip(firsts, before, strict=True)],
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest bigint, target int",
    )
    same = F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.digest") == F.col("h.digest"))
    sent = cut.alias("r").join(F.broadcast(heads).alias("h"), same)
    sent = sent.select("r.doc_id", "text", "r.digest", F.col("target").alias("bucket")).dropDuplicates(["doc_id", "digest", "bucket"])
    both = cut.withColumn("head", F.lit(False)).unionByName(sent.withColumn("head", F.lit(True)))
    order = ["bucket", "head", F.col("doc_id").asc_nulls_first(), "digest"]
    placed = both.repartition(max(1, len(firsts)), "bucket").sortWithinPartitions(*order)
    shape = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    made = placed.select("doc_id", "text", "head").mapInArrow(_pairs, shape)
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = _signatures(batch.column("text"))
        bands = signs.reshape(len(signs), BANDS, ROWS).astype(np.uint64)
        keys = np.zeros((len(signs), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r] + np.uint64(1))
        keys = mix64(keys + np.arange(BANDS, dtype=np.uint64))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "digest": batch.column("digest"),
                "keys": list_array(keys.ravel().view(np.int64), np.full(len(signs), BANDS)),
            }
        )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_runs(batch.column("text")):
            words, counts = word_hashes(data, offsets, lower=False)
            values, sizes = shingle_hashes(words, counts, WIDTH)
            rows = [np.unique(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": batch.column("digest").slice(first, end - first),
                    "tokens": list_array(np.concatenate(rows).view(np.int64), np.array([len(r) for r in rows])),
                }
            )


def near_duplicate_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and class_id, the smallest doc_id of its class.

    Texts meet in bands of their fingerprints (recall by probability, see BANDS), and a
    link needs an exact Jaccard similarity of the 5-word shingle sets of ``percent`` or
    more. Equal texts are one. A text without words is alone with its equals.
    """
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    signed, _ = write_scratch(texts.mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest bigint, keys array<bigint>"), "signatures")
    one = F.lit(1)
    post = signed.dropDuplicates(["digest"]).select(F.col("digest").alias("gid"), one.alias("n"), one.alias("w"), F.explode("keys").alias("h"))
    busy = post.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    post, _ = write_scratch(post.join(busy, "h", "left_semi"), "bands")
    post = with_shared(post)
    wanted = post.select(F.col("gid").alias("digest")).distinct()
    held = texts.join(wanted, "digest", "left_semi").select("digest", "text").dropDuplicates(["digest"])
    tokens, _ = write_scratch(held.mapInArrow(_shingles, "digest bigint, tokens array<bigint>"), "tokens")

    def verified(pairs: DataFrame) -> DataFrame:
        a = tokens.select(F.col("digest").alias("a"), F.col("tokens").alias("ta"))
        b = tokens.select(F.col("digest").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        sure = (both > 0) & (100 * both >= percent * (F.size("ta") + F.size("tb") - both))
        return write_scratch(pairs.join(a, "a").join(b, "b").filter(sure).select("a", "b"), "links")[0]

    links = verified(leader_pairs(post, Rule()))
    comp, _ = write_scratch(connected_components(links).withColumnRenamed("node", "gid"), "components")
    united = post.join(comp, "gid", "left").select("h", F.col("gid").alias("id"), "n", "w", "m", F.coalesce("component", "gid").alias("comp"))
    links = links.union(verified(remaining_pairs(united, Rule())))
    comp = connected_components(links).withColumnRenamed("node", "digest")
    owner = signed.select("doc_id", "digest").join(comp, "digest", "left").withColumn("class", F.coalesce("component", "digest"))
    low = owner.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return owner.join(low, "class").select("doc_id", "class_id")
