"""Alignment of the tokens of two tokenizers by merge-path partitioning.

Both tokenizers cut the same bytes, so their tokens align by merging the two sorted lists
of token ends. Binary searches on the diagonals of the merge divide it into pieces of equal
work that need nothing of each other; all pieces of a block of documents advance one merge
step at a time. A piece emits the overlaps it meets and numbers the groups it closes; running
sums over the pieces stitch groups that cross a border.

Counts over the corpus travel per block: a block names its different pairs once, and each
link is a number into that list.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.textops import list_array, text_runs
from rankforge.session import write_scratch

#: Merge steps of a piece, and pieces that advance together.
PIECE, TOGETHER = 64, 1 << 13
#: Bytes of text of the documents that share a list of pairs (a longer text has its own).
BLOCK_BYTES = 1 << 20
#: Longer texts are encoded in segments of about so many characters, with equal tokens.
SEGMENT_CHARS = 1 << 15

_END = np.iinfo(np.int64).max
_SIDES = ("n_a", "n_b", "n_groups", "n_links")


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` the merge of the sorted lists has taken after so many steps.

    Of equal values that of ``a`` is taken first. One binary search per diagonal, all at once.
    """
    low = np.maximum(0, diagonals - len(b))
    high = np.minimum(diagonals, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        before = a[middle] <= b[diagonals[open_] - 1 - middle]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]


def merge_links(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (number in a, number in b, group) of two lists of token ends, in merge order.

    The lists ascend and end alike. A link is a pair of tokens whose byte ranges overlap; a
    group closes where both lists have an end.
    """
    total = len(a) + len(b)
    if not total:
        return (np.zeros(0, dtype=np.int32),) * 3
    pad = np.full(piece + 1, _END)
    end_a, end_b = np.concatenate([a, pad]), np.concatenate([b, pad])
    # behind its last token a list begins nowhere, so nothing overlaps there
    begin_a, begin_b = np.concatenate([[0], a[:-1], pad]), np.concatenate([[0], b[:-1], pad])
    diagonals = np.arange(0, total, piece)
    starts = crossings(a, b, diagonals)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    groups = 0
    for at in range(0, len(diagonals), TOGETHER):
        i = starts[at : at + TOGETHER].copy()
        j = diagonals[at : at + TOGETHER] - i
        closed = np.zeros(len(i), dtype=np.int64)
        seen_i, seen_j, seen_g = (np.empty((piece, len(i)), dtype=np.int32) for _ in range(3))
        linked = np.empty((piece, len(i)), dtype=bool)
        for step in range(piece):
            x, y = end_a[i], end_b[j]
            overlap = (begin_a[i] < y) & (begin_b[j] < x)
            seen_i[step], seen_j[step], seen_g[step], linked[step] = i, j, closed, overlap
            closed += overlap & (x == y)
            first = x <= y
            i += first
            j += ~first
        # a group that a piece leaves open is the first one of the next piece
        seen_g += (np.cumsum(closed) - closed + groups).astype(np.int32)
        groups += int(closed.sum())
        kept = linked.T
        found.append((seen_i.T[kept], seen_j.T[kept], seen_g.T[kept]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _byte_of_letter() -> dict[str, int]:
    """The letters of byte-level vocabularies: a printable byte is its own character, the
    others follow in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class TokenizerPair:
    """A byte-level tokenizer (A) and a sentence-piece model (B) over space + text."""

    # a space between two visible characters begins a token of either side
    _cut = re.compile(r"(?<=\S)(?= \S)")
    # The pattern of byte-level pre-tokenizers, and characters whose class has
    # been the same in all versions of Unicode that two libraries may have been built with.
    _pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _plain = re.compile(
        "[\x00-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u0900-\u0939\u2010-\u2027\u2030-\u205e\u20a0-\u20b5"
        "\u3000-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]*"
    )

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_of_letter()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [
            bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i])
            else names.get(i, "").encode() for i in range(max(names) + 1)
        ]
        self.b_bytes = [self._b_token(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (
            np.array([len(t) for t in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes)
        )
        # a token that holds a space behind another character would cross a cut
        self.cuttable = not any(re.search(rb"[^ ] ", t) for t in self.b_bytes)
        self.ranked = self._ranked(json.loads(a_json))
        self.written = [self._written(len(self.a_bytes), ",|"), self._written(len(self.b_bytes), ",;")]
        self.last = np.array([str(i) for i in range(len(self.b_bytes))], dtype=object)

    def _ranked(self, spec: dict):
        """A quicker encoder of A over ranks, where its merges are in the order of their ids; else None."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or any(odd) or spec.get("normalizer") or any(cut.get(k) != v for k, v in usual.items()):
            return None
        vocab, letters = model["vocab"], _byte_of_letter()
        order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        singles = [vocab.get(c) for c in letters]
        if None in singles or max(singles) > min(order, default=256) or any(x >= y for x, y in zip(order, order[1:])):
            return None
        import tiktoken

        ranks = {self.a_bytes[i]: i for i in [*singles, *order]}
        return tiktoken.Encoding("a", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})

    def _b_token(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @staticmethod
    def _written(n: int, marks: str) -> list[np.ndarray]:
        return [np.array([f"{i}{mark}" for i in range(n)], dtype=object) for mark in marks]

    def _segments(self, text: str) -> list[str]:
        """Parts of space + text without their first space, cut where no token crosses."""
        if len(text) <= SEGMENT_CHARS or not self.cuttable:
            return [text]
        out, held, size = [], [], 0
        for part in self._cut.split(" " + text):
            held.append(part)
            size += len(part)
            if size >= SEGMENT_CHARS:
                out.append("".join(held)[1:])
                held, size = [], 0
        return out + (["".join(held)[1:]] if held else [])

    def _encode_a(self, segment: str) -> list[int]:
        if self.ranked is not None and self._plain.fullmatch(segment):
            return self.ranked.encode_ordinary(" " + segment)
        return self.a.encode(" " + segment, add_special_tokens=False).ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; both empty if either does not give space + text."""
        segments = self._segments(text)
        a = np.array([i for part in segments for i in self._encode_a(part)], dtype=np.int32)
        b = np.array([i for part in self.b.encode(segments, num_threads=1) for i in part], dtype=np.int32)
        raw = (" " + text).encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in b.tolist()]) != raw:
            return a[:0], b[:0]
        return a, b

    def group_strings(self, a, b, group_a, group_b, rows_a, rows_b) -> list[str]:
        """Each row's groups as ``a1,a2|b1;a3|b2,b3``."""
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        out = np.empty(len(a) + len(b), dtype=object)
        ends_a, ends_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        out[place_a] = self.written[0][0][a]
        out[place_a[ends_a]] = self.written[0][1][a[ends_a]]
        out[place_b] = self.written[1][0][b]
        out[place_b[ends_b]] = self.written[1][1][b[ends_b]]
        edges = np.cumsum(rows_a + rows_b)
        full = rows_b > 0
        out[edges[full] - 1] = self.last[b[np.cumsum(rows_b)[full] - 1]]
        edges = np.concatenate([[0], edges])
        return ["".join(out[x:y].tolist()) for x, y in zip(edges[:-1], edges[1:], strict=True)]


_PAIRS: dict[bytes, TokenizerPair] = {}


def _pair(a_json: str, b_model: bytes) -> TokenizerPair:
    key = hashlib.md5(a_json.encode() + b_model).digest()
    if key not in _PAIRS:
        _PAIRS[key] = TokenizerPair(a_json, b_model)
    return _PAIRS[key]


def _number_type(pairs: int) -> np.dtype:
    """What holds a number into a list of so many pairs."""
    return np.dtype("<u2" if pairs <= 1 << 16 else "<u4")


def _binary(values: np.ndarray, sizes: np.ndarray, kind: np.dtype) -> pa.Array:
    """One little-endian run of numbers per row."""
    raw = values.astype(kind).tobytes()
    edges = np.concatenate([[0], np.cumsum(sizes)]) * kind.itemsize
    return pa.array([raw[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)], type=pa.binary())


def _align_block(pair: TokenizerPair, texts: list[str | None]) -> dict[str, pa.Array]:
    none = np.zeros(0, dtype=np.int32)
    coded = [pair.encode(t) if t else (none, none) for t in texts]
    a, b = np.concatenate([x for x, _ in coded]), np.concatenate([y for _, y in coded])
    rows_a = np.array([len(x) for x, _ in coded], dtype=np.int64)
    rows_b = np.array([len(y) for _, y in coded], dtype=np.int64)
    i, j, group = merge_links(np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b]))
    group_a, group_b = np.empty(len(a), dtype=np.int64), np.empty(len(b), dtype=np.int64)
    group_a[i], group_b[j] = group, group
    owner = np.repeat(np.arange(len(texts)), rows_a)
    row = owner[i]
    links = np.bincount(row, minlength=len(texts))
    first = np.zeros(len(a), dtype=bool)  # the first token of each group of A
    first[1:] = group_a[1:] != group_a[:-1]
    first[:1] = True
    groups = np.bincount(owner[first], minlength=len(texts))
    pairs, number = np.unique(a[i].astype(np.int64) << 32 | b[j], return_inverse=True)
    held = np.unique(row * max(len(pairs), 1) + number) % max(len(pairs), 1)
    lists = np.zeros(len(texts), dtype=np.int64)
    lists[0] = len(pairs)
    head = pa.array([n != 0 for n in range(len(texts))])  # the list stands in the block's first row
    return {
        "n_a": pa.array(rows_a), "n_b": pa.array(rows_b), "n_groups": pa.array(groups), "n_links": pa.array(links),
        "groups": pa.array(pair.group_strings(a, b, group_a, group_b, rows_a, rows_b), type=pa.string()),
        "links": _binary(number, links, _number_type(len(pairs))),
        "pairs": pc.if_else(head, None, list_array(pairs, lists)),
        "pair_docs": pc.if_else(head, None, list_array(np.bincount(held, minlength=len(pairs)), lists)),
    }


def _align(batches: Iterator[pa.RecordBatch], a_json: str, b_model: bytes) -> Iterator[pa.RecordBatch]:
    pair = _pair(a_json, b_model)
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    for batch in batches:
        for first, end, _, _ in text_runs(batch.column("text"), BLOCK_BYTES):
            part = batch.slice(first, end - first)
            made = _align_block(pair, part.column("text").to_pylist())
            made = {"row": part.column("row"), "block": pa.array([block] * len(part)), **made}
            yield pa.RecordBatch.from_pydict(made)
            del made
            pa.default_memory_pool().release_unused()
            block += 1


def align_documents(docs: DataFrame, a_file: str, b_file: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the alignment of each text's tokens.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (``a1,a2|b1;a3|b2,b3``). A null or
    empty text, and one that a tokenizer does not give back as space + text, has zeros and an
    empty ``groups``. ``block``, ``links``, ``pairs`` and ``pair_docs`` serve ``with_pair_counts``.
    Repeated rows and ids are rows like others, columns outside ``keep`` are ignored, an empty
    table gives an empty one. A text is one row of one task and goes through it whole. The two
    files are read on the driver and travel with the task.
    """
    with open(a_file, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    row = docs.select(docs["text"].alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    shape = (
        f"row {row.schema['row'].dataType.simpleString()}, block bigint, "
        + ", ".join(f"{c} bigint" for c in _SIDES)
        + ", groups string, links binary, pairs array<bigint>, pair_docs array<bigint>"
    )
    made = row.mapInArrow(partial(_align, a_json=a_json, b_model=b_model), shape)
    return made.select("row.*", "block", *_SIDES, "groups", "links", "pairs", "pair_docs")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a_id``, ``b_id``, ``n_docs`` (documents in which the pair is linked) and ``is_best``
    (no pair of this a_id has more)."""
    named = aligned.filter(F.col("pairs").isNotNull()).select(F.inline(F.arrays_zip("pairs", "pair_docs")))
    counts = named.groupBy("pairs").agg(F.sum("pair_docs").alias("n_docs"))
    counts = counts.select(
        F.shiftright("pairs", 32).alias("a_id"), F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n_docs"
    )
    best = counts.groupBy("a_id").agg(F.max("n_docs").alias("_most"))
    return counts.join(best, "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("_most")).alias("is_best"))


def _sum_links(docs: pa.Table, counts: pa.Table) -> pa.Table:
    size = counts.num_rows
    per, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    slot = counts.column("slot").to_numpy()
    per[slot] = counts.column("n_docs").to_numpy()
    best[slot] = counts.column("is_best").to_numpy(zero_copy_only=False)
    raw = docs.column("links").to_pylist()
    kind = _number_type(size)
    numbers = np.frombuffer(b"".join(raw), dtype=kind)
    edges = np.concatenate([[0], np.cumsum([len(r) // kind.itemsize for r in raw])])

    def total(values: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(values[numbers])])[edges]
        return pa.array(np.diff(sums))

    return pa.table({"row": docs.column("row"), "n_best": total(best), "count_sum": total(per)})


def with_pair_counts(aligned: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``n_best`` (links whose count is the highest of their A id, ties
    included) and ``count_sum`` (counts summed over the links).

    The alignment is written once. Blocks, not documents, ask for the counts of their pairs, and
    links meet them inside their block, whose size is bounded (BLOCK_BYTES, or one text).
    """
    columns = list(dict.fromkeys([*keep, "block", "links", "pairs", "pair_docs"]))
    stored, _ = write_scratch(aligned.select(columns), "alignment")
    asked = stored.filter(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("slot", "pair"))
    rated = pair_counts(stored).select(
        F.shiftleft("a_id", 32).bitwiseOR(F.col("b_id")).alias("pair"), "n_docs", "is_best"
    )
    # a fresh name: both sides of the cogroup come from one table
    counts = asked.join(rated, "pair").select(F.col("block").alias("_block"), "slot", "n_docs", "is_best")
    rows = stored.select("block", F.struct(*[stored[c] for c in keep]).alias("row"), "links")
    shape = f"row {rows.schema['row'].dataType.simpleString()}, n_best bigint, count_sum bigint"
    summed = rows.groupBy("block").cogroup(counts.groupBy("_block")).applyInArrow(_sum_links, shape)
    return summed.select("row.*", "n_best", "count_sum")
