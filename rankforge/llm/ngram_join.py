"""N-gram Jaccard join: grouped prefix join over word shingle sets.

Two documents link when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of distinct
word shingles. The plan, without a step that emits all pairs of a group:

1. Documents with the same set become one set (key: md5 of the sorted shingle hashes).
2. Two linked sets share at least ``need`` shingles within windows of both: the prefix
   (all but the required overlap, and one) and half as many more, in any one order of
   shingles. A set whose window by hash holds fewer shingles of other documents than a
   partner of any size needs cannot have one; the rest, usually few, fetch their shingles.
3. These are cut into cells by hash, more cells than the shingles two linked sets can
   differ in, so that some cells of linked sets are equal, whole. A cell is as rare as its
   rarest shingle: passages and words that many documents have do not make candidates.
4. Sets that share cells are verified against a leader of the cell; links found so are
   united. Then every pair of sets that share enough cells, fit in size and still lie in
   different components is expanded and verified. Pairs already united need no
   verification, as only reachability is asked for.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.components import connected_components
from rankforge.llm.linking import Rule, leader_pairs, remaining_pairs, with_shared
from rankforge.llm.textops import list_array, mix64, shingle_hashes, text_runs, word_hashes
from rankforge.session import drop_scratch, write_scratch

#: Partners of at most this size are gone through one by one for the least they share.
ALL_SIZES = 5_000
#: The largest size of each class; a pair is sought by the cells of its smaller set's class.
SIZES = [1]
while SIZES[-1] < 1 << 40:
    SIZES.append(max(SIZES[-1] + 1, SIZES[-1] * 3 // 2))


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words, counts = word_hashes(data, offsets, lower=True)
    shingles, sizes = shingle_hashes(words, counts, width)
    return [np.unique(s) for s in np.split(shingles, np.cumsum(sizes)[:-1])]


@lru_cache(maxsize=100_000)
def _window(n: int, percent: int) -> tuple[int, int]:
    """(length of the window of a set of n, shingles that any partner shares within it at least).

    The second is the least ``Rule.need`` over the sizes of partners. Without rounding it
    is concave in the size, thus least at an end; rounding moves it by less than 3, which
    large sets give away instead of going through every size.
    """
    if not n:
        return 0, 1
    least, most = -(-percent * n // 100), 100 * n // percent
    sizes, slack = (np.arange(least, most + 1), 0) if most <= ALL_SIZES else (np.array([least, most]), 3)

    def width(m):
        return (m - -(-percent * m // 100) + 1) * 3 // 2

    overlap = -(-percent * (n + sizes) // (100 + percent))
    need = np.minimum(width(n) - n, width(sizes) - sizes) + overlap
    return width(n), max(1, int(need.min()) - slack)


@lru_cache(maxsize=100_000)
def _classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, shingles that a pair of it can differ in) where a set of n may be one of a pair."""
    found, c = [], bisect_left(SIZES, n)
    while not found or (c >= 0 and 100 * SIZES[c] >= percent * n):
        found.append((c, SIZES[c] * (100 - percent) // percent))
        c -= 1
    return found


def _cells(shingles: np.ndarray, c: int, differ: int) -> tuple[int, np.ndarray]:
    """(cells that hold a shingle, keys) of sorted shingles in class ``c``.

    Of differ + 1 + spare cells, spare + 1 are equal in both sets of a pair at least. Empty
    cells have keys only where a set has more of them than spare; if one set of a pair has
    not, one of the equal cells holds a shingle.
    """
    spare = differ // 4
    count = differ + 1 + spare
    cell = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    code = mix64(np.array([c + 1], dtype=np.uint64))
    keys = mix64(np.add.reduceat(mix64(shingles), starts) ^ code)
    if count - len(starts) > spare:
        empty = np.setdiff1d(np.arange(count, dtype=np.uint64), cell[starts], assume_unique=True)
        keys = np.concatenate([keys, mix64(mix64(empty + np.uint64(1)) + code)])
    return len(starts), keys


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return list_array(np.concatenate(rows).view(np.int64), np.array([len(r) for r in rows]))


def _describe(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_runs(batch.column("text")):
            sets = _sets(data, offsets, width)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row").slice(first, end - first),
                    "doc_id": batch.column("doc_id").slice(first, end - first),
                    "digest": batch.column("digest").slice(first, end - first),
                    "n": pa.array([len(s) for s in sets], type=pa.int64()),
                    "need": pa.array([_window(len(s), percent)[1] for s in sets], type=pa.int64()),
                    "key": pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], type=pa.binary()),
                    "window": _lists([s[: _window(len(s), percent)[0]] for s in sets]),
                }
            )


def _fetch(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row per set and class of sizes: its cells; the first row of a set has its shingles."""
    for batch in batches:
        ids = batch.column("set_id").to_pylist()
        for first, _, data, offsets in text_runs(batch.column("text")):
            rows = []
            for i, own in enumerate(_sets(data, offsets, width), first):
                for at, (c, differ) in enumerate(_classes(len(own), percent)):
                    rows.append((ids[i], len(own), *_cells(own, c, differ), None if at else own.view(np.int64)))
            yield pa.RecordBatch.from_pydict(
                {
                    "set_id": pa.array([r[0] for r in rows], type=pa.int64()),
                    "n": pa.array([r[1] for r in rows], type=pa.int64()),
                    "w": pa.array([r[2] for r in rows], type=pa.int64()),
                    "cells": _lists([r[3] for r in rows]),
                    "tokens": pa.array([r[4] for r in rows], type=pa.list_(pa.int64())),
                }
            )


class _Join:
    """The state of one join: shingles of the remaining sets, and links found so far."""

    def __init__(self, tokens: DataFrame, percent: int):
        self.tokens, self.percent = tokens, percent
        self.links: list[DataFrame] = []

    def verify(self, pairs: DataFrame) -> None:
        """Keep the pairs (a, b) of sets that link."""
        one = self.tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"))
        two = self.tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb"))
        union = F.size("ta") + F.size("tb") - both
        sure = pairs.join(one, "a").join(two, "b").filter(F.lit(100) * both >= F.lit(self.percent) * union)
        self.links.append(write_scratch(sure.select("a", "b"), "links")[0])

    def components(self) -> DataFrame:
        found = self.links[0]
        for more in self.links[1:]:
            found = found.union(more)
        return write_scratch(connected_components(found), "components")[0]


def _place() -> Column:
    """What tells rows apart: doc_id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))


def ngram_jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, itself included. A-Z is
    lower-cased; words are runs outside U+0020 and U+0009 to U+000D; a text of fewer
    than ``width`` words has one shingle, its whole sequence. A null or wordless text
    has no shingles and links with nothing. Rows that repeat a doc_id are separate
    documents; a null doc_id is kept and never is a component_id unless alone. Other
    columns are ignored.
    """
    owner = _owners(docs, width, percent)
    smallest = owner.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("low"))
    found = owner.join(smallest, "comp", "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _owners(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, its digest, n shingles and comp, a number of its component."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", _place().alias("digest"))
    shape = (
        f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, "
        "n bigint, need bigint, key binary, window array<bigint>"
    )
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    described, wide_path = write_scratch(numbered.mapInArrow(partial(_describe, width=width, percent=percent), shape), "described")
    sets, _ = write_scratch(described.filter("n > 0").groupBy("key").agg(F.min("row").alias("set_id")), "sets")
    post = described.select("row", "need", F.explode("window").alias("h"))
    several, several_path = write_scratch(post.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "several")

    met = post.join(several, "h", "left_semi").groupBy("row", "need").agg(F.count("*").alias("c"))
    hopeful = met.filter("c >= need").select(F.col("row").alias("set_id")).join(sets, "set_id", "left_semi")
    hopeful, _ = write_scratch(hopeful, "hopeful")
    described, _ = write_scratch(described.drop("window"), "owners")
    for path in (wide_path, several_path):  # nothing below reads the windows
        drop_scratch(spark, path)
    wanted = described.select("digest", F.col("row").alias("set_id")).join(hopeful, "set_id")
    # alike rows of one (doc_id, text) fall to the one set they share
    fetched = texts.drop("doc_id").join(wanted, "digest").dropDuplicates(["digest"])
    shape = "set_id bigint, n bigint, w bigint, cells array<bigint>, tokens array<bigint>"
    how = partial(_fetch, width=width, percent=percent)
    fetched, cells_path = write_scratch(fetched.select("set_id", "text").mapInArrow(how, shape), "cells")

    post = fetched.select(F.col("set_id").alias("gid"), "n", "w", F.explode("cells").alias("h"))
    busy = post.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    post, path = write_scratch(post.join(busy, "h", "left_semi"), "postings")
    post, post_path = write_scratch(with_shared(post), "shared-postings")
    drop_scratch(spark, path)

    rule = Rule(percent)
    join = _Join(fetched.filter("tokens IS NOT NULL").select("set_id", "tokens"), percent)
    join.verify(leader_pairs(post, rule))
    comp, path = write_scratch(join.components().withColumnRenamed("node", "gid"), "components")
    held = post.join(comp, "gid", "left")
    held = held.select("h", F.col("gid").alias("id"), "n", "w", "m", F.coalesce("component", "gid").alias("comp"))
    join.verify(remaining_pairs(held, rule))
    comp = join.components()
    for done in (cells_path, post_path, path):
        drop_scratch(spark, done)

    owner = described.select("doc_id", "digest", "n", "key").join(sets, "key", "left")
    owner = owner.join(comp.withColumnRenamed("node", "set_id"), "set_id", "left")
    return owner.select("doc_id", "digest", "n", F.coalesce("component", "set_id").alias("comp"))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id, then digest.

    Of rows with the same doc_id and text one stays, also where doc_id is null; rows of
    one doc_id with different texts are separate documents. Documents without words and
    null doc_ids stay. Other columns pass through.
    """
    owner = _owners(docs, width, percent)
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    first = owner.filter(linked).groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select("first.digest")
    kept = first.union(owner.filter(~linked).select("digest")).distinct()
    stay = docs.alias("d").join(kept.alias("k"), _place() == F.col("k.digest"), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"])
