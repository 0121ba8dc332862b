"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end it in a valid encoding: the
one compatible with the token that ends the prefix before it. Keeping these last tokens
encodes a piece in one pass, extends it exactly when bytes are appended, and confines
the work after an edit to its neighbourhood. Pieces are cut by a pattern first, as BPE
never merges across them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rankforge.llm.textops import text_runs

#: Entries of a worker's cache of encoded words; it is emptied when full (speed only).
CACHE_WORDS = 200_000
#: Entries of its cache of token pairs, likewise.
CACHE_PAIRS = 400_000


class PrefixCoder:
    """Encoder of single pieces over a table of ranks (token bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        for data, i in ranks.items():
            if len(data) == 1:
                self.parts[i] = None
            elif (last := self._last_merge(data)) is not None:
                self.parts[i] = last
        reachable = [self.token[i] for i in self.parts]
        # a token's id; -1 for bytes that only begin one
        self.reachable = dict.fromkeys((b[:n] for b in reachable for n in range(1, len(b))), -1)
        self.reachable |= {b: ranks[b] for b in reachable}
        self.longest = max(map(len, reachable))
        self.sizes = {i: len(b) for i, b in self.token.items()}
        self._fits: dict[int, bool] = {}

    def _last_merge(self, data: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``data``; None if merging never gets there."""
        pieces = [data[i : i + 1] for i in range(len(data))]
        whole = self.ranks[data]
        while len(pieces) > 2:
            best, at = whole, -1
            for i in range(len(pieces) - 1):
                rank = self.ranks.get(pieces[i] + pieces[i + 1], whole)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return None
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        left, right = (self.ranks.get(p) for p in pieces)
        return None if left is None or right is None else (left, right)

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens stay apart when their bytes are encoded together.

        Time is run backwards: the younger of the two tokens at the border is undone, and
        a pair that met before is checked for a merge that would have come first. Of two
        merges of one rank the left one comes first.
        """
        a, b, before = left, right, len(self.token) + 1 << 1
        while True:
            met = self.ranks.get(self.token[a] + self.token[b])
            if met is not None and met < before:
                fits = False
                break
            if self.parts[a] is None and self.parts[b] is None:
                fits = True
                break
            if self.parts[b] is None or (self.parts[a] is not None and a > b):
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]
        if len(self._fits) > CACHE_PAIRS:
            self._fits.clear()
        self._fits[left << 32 | right] = fits
        return fits

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``piece``, given those of its first bytes."""
        get, known = self.reachable.get, self._fits.get
        low = max(0, len(last) + 1 - self.longest)
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(low, end):
                token = get(piece[start:end])
                if token is None:
                    # no token goes on from here, and none will as the prefix grows
                    if start == low:
                        low += 1
                    continue
                if token < 0:
                    continue
                if start == 0:
                    break
                before = last[start - 1]
                fits = known(before << 32 | token)
                if fits or (fits is None and self.compatible(before, token)):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)
        return last

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace piece[start:end]: prefixes before the edit stay, and recomputation stops
        once the last tokens agree with the old ones over the length of the longest token."""
        edited = piece[:start] + new + piece[end:]
        fresh, shift = last[:start], len(new) - (end - start)
        agreed = 0
        while len(fresh) < len(edited):
            at = len(fresh)
            self.extend(edited[: at + 1], fresh)
            old = at - shift
            inside = at >= start + len(new)
            agreed = agreed + 1 if inside and last[old] == fresh[at] else 0
            if agreed >= self.longest:
                fresh.extend(last[old + 1 :])
        return edited, fresh

    def walk(self, last: list[int]) -> list[int]:
        """The ids of a piece from the last tokens of its prefixes."""
        ids, at, sizes = [], len(last), self.sizes
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= sizes[token]
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # a piece that is a token is that token
        return [whole] if whole is not None else self.walk(self.extend(piece, []))


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder(dict):
    """Ids of whole texts as little-endian bytes; as a dict, of words already met."""

    # white space before a space: the cut at single spaces would not be one of the pattern
    _uneven = re.compile(r"\s ")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.coder = PrefixCoder(ranks)
        self._find = regex.compile(pattern).findall
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = _bytes_of(self.coder.encode(piece.encode()))
            if len(piece) < 64:
                if len(self._pieces) > CACHE_WORDS:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        # letters after at most one space are a piece, and so is a mark that follows them
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            ids = self._piece(word)
        elif word[1:-1].isalpha() and word[-1] in ",.;:" and (word[0] == " " or word[0].isalpha()):
            ids = self._piece(word[:-1]) + self._piece(word[-1])
        else:
            ids = b"".join(map(self._piece, self._find(word)))
        if len(word) < 64:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def forget(self) -> None:
        """Empty the caches (speed only)."""
        self.clear()
        self._pieces.clear()
        self.coder._fits.clear()

    def encode(self, text: str) -> bytes:
        # a space after a visible character begins a piece, so the text can be cut there
        if self._uneven.search(text):
            return self[text]
        head, *words = text.split(" ")
        return self[head] + b"".join([self[" " + w] for w in words])


_ENCODERS: dict[tuple[bytes, str], TextEncoder] = {}


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def _encoder(content: bytes, pattern: str) -> TextEncoder:
    key = hashlib.md5(content).digest(), pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(read_ranks(content), pattern)
    return _ENCODERS[key]


def _encode(batches: Iterator[pa.RecordBatch], content: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(content, pattern)
    for batch in batches:
        for first, end, _, _ in text_runs(batch.column("text")):
            texts = batch.column("text").slice(first, end - first)
            ids = [encoder.encode(t or "") for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(first, end - first), pa.array(ids, type=pa.binary())], ["row", "ids"]
            )


class Decoder:
    """Bytes of token ids: one gather from all tokens laid end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for data, i in ranks.items():
            self.sizes[i] = len(data)
        self.begin = np.cumsum(self.sizes) - self.sizes
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.flat = np.frombuffer(b"".join(data for data, _ in ordered), dtype=np.uint8)

    def decode(self, rows: list[bytes]) -> pa.Array:
        """The text of each row of little-endian ids."""
        ids = np.frombuffer(b"".join(rows), dtype="<u4")
        width = self.sizes[ids]
        stop = np.cumsum(width)
        source = np.arange(int(width.sum())) + np.repeat(self.begin[ids] - (stop - width), width)
        text = self.flat[source].tobytes()
        edges = np.concatenate([[0], stop])[np.cumsum([0, *[len(r) // 4 for r in rows]])]
        return pa.array([text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], type=pa.binary())


_DECODERS: dict[bytes, Decoder] = {}


def _decoder(content: bytes) -> Decoder:
    key = hashlib.md5(content).digest()
    if key not in _DECODERS:
        _DECODERS[key] = Decoder(read_ranks(content))
    return _DECODERS[key]


def _decode(batches: Iterator[pa.RecordBatch], content: bytes, column: str) -> Iterator[pa.RecordBatch]:
    decoder = _decoder(content)
    for batch in batches:
        names = batch.schema.names
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        while at < len(lengths):
            end, held = at + 1, lengths[at]
            while end < len(lengths) and held + lengths[end] < 1 << 20:
                held += lengths[end]
                end += 1
            part = batch.slice(at, end - at)
            decoded = decoder.decode([x or b"" for x in part.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*names, "decoded"])
            at = end


def _roundtrip(batches: Iterator[pa.RecordBatch], content: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    decoder = _decoder(content)
    for batch in _encode(batches, content, pattern):
        decoded = decoder.decode(batch.column("ids").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, decoded], ["row", "ids", "decoded"])
    # a worker outlives its task; what it met there is no use to the next stage
    _encoder(content, pattern).forget()


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``ids`` (binary: little-endian unsigned 32-bit ids).

    ``ranks_file`` is read on the driver; a vocabulary is small and travels with the
    task. A null text counts as empty and has no ids. Special tokens are ordinary text.
    """
    with open(ranks_file, "rb") as f:
        content = f.read()
    row = docs.select(docs["text"].alias("text"), _struct(docs, keep))
    shape = f"row {row.schema['row'].dataType.simpleString()}, ids binary"
    return row.mapInArrow(partial(_encode, content=content, pattern=pattern), shape).select("row.*", "ids")


def decode_documents(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the tokens in column ``ids`` (null: empty)."""
    with open(ranks_file, "rb") as f:
        content = f.read()
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(partial(_decode, content=content, column="ids"), f"{shape}, decoded binary")


def _struct(docs: DataFrame, keep: list[str]):
    from pyspark.sql import functions as F

    return F.struct(*[docs[c] for c in keep]).alias("row")


def roundtrip_documents(docs: DataFrame, ranks_file: str, pattern: str, keep: list[str]) -> DataFrame:
    """``encode_documents`` and ``decode_documents`` in one pass: ``keep``, ``ids`` and ``decoded``.

    A task then has one Python worker with one vocabulary, and ids do not travel between two.
    """
    with open(ranks_file, "rb") as f:
        content = f.read()
    row = docs.select(docs["text"].alias("text"), _struct(docs, keep))
    shape = f"row {row.schema['row'].dataType.simpleString()}, ids binary, decoded binary"
    made = row.mapInArrow(partial(_roundtrip, content=content, pattern=pattern), shape)
    return made.select("row.*", "ids", "decoded")
