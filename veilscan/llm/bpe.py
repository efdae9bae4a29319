"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

A byte string has one BPE encoding, and so has each of its prefixes; for each prefix the last token of that encoding is
stored. The last token of a longer prefix is the one token t that ends there and may follow the last token of the
prefix before t: a pair may stand side by side if undoing the merges of both, highest rank first, never shows a pair
across the border that would have been merged sooner. Appending bytes only adds entries; an edit keeps all entries
before it, and behind it the old encoding takes over where both have a token border.

Text is cut by the tokenizer's pattern first; each match is encoded by itself and matches are cached.

Edge cases: a null text is the empty text with no ids; equal rows give equal results; ids may repeat or be null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from .common import alone, blocks, kept, lean, read_table, slices

#: Matches of the pattern cached in a worker; the cache starts anew when full.
CACHE = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """ranks: token bytes to id, ids by order of merging. pattern: what cuts text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.longest = max(map(len, ranks))
        self.borders: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.cache = _Cache(self)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.halves:
            b = self.bytes_of[token]
            self.halves[token] = None if len(b) == 1 else self._last_pair(b, token)
        return self.halves[token]

    def _last_pair(self, b: bytes, below: int) -> tuple[int, int]:
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            best = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], below)) < below)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between these tokens alone."""
        key = left << 32 | right
        if key not in self.borders:
            if len(self.borders) > 2_000_000:
                self.borders.clear()
            self.borders[key] = self._fits(left, right)
        return self.borders[key]

    def _fits(self, left: int, right: int) -> bool:
        # The pair at the border exists until the merge that made the younger of its two tokens is undone; it must
        # not have been mergeable before that. Of equal ranks the left one is merged first.
        until = (1 << 60, 0)
        while True:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if rank is not None and (rank, 1) < until:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                until, left = (left, 0), a[1]
            else:
                until, right = (right, 2), b[0]

    def prefixes(self, b: bytes, last: list[int] | None = None, start: int = 0) -> list[int]:
        """last[i]: the last token of b[:i + 1]'s encoding. last: entries for b[:start] that hold already."""
        last = [] if last is None else last[:start]
        get, borders, longest = self.ranks.get, self.borders, self.longest
        for end in range(len(last) + 1, len(b) + 1):
            # The valid token is unique, so candidates may come shortest first: most last tokens are short.
            for begin in range(end - 1, max(-1, end - longest - 1), -1):
                t = get(b[begin:end])
                if t is not None:
                    if begin == 0:
                        break
                    left = last[begin - 1]
                    if (fit := borders.get(left << 32 | t)) or (fit is None and self.fits(left, t)):
                        break
            last.append(t)
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_bytes(self, b: bytes) -> list[int]:
        whole = self.ranks.get(b)
        return [whole] if whole is not None else self.walk(self.prefixes(b))

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.cut(text)))

    def encode(self, text: str) -> list[int]:
        return unpack(self.encode_packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Cache(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_bytes(piece.encode("utf-8", "surrogatepass"))
        self[piece] = packed = pack(ids)
        return packed


def pack(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpack(packed: bytes) -> array:
    import sys

    a = array("I")
    a.frombytes(packed)
    if sys.byteorder == "big":
        a.byteswap()
    return a


class PrefixText:
    """Bytes that grow and change, with the tokens of every prefix (no pattern: one match of it)."""

    def __init__(self, codec: Codec, b: bytes = b""):
        self.codec, self.bytes, self.last = codec, b, codec.prefixes(b)

    def append(self, b: bytes) -> None:
        """Exact: entries of old prefixes stay as they are."""
        self.bytes += b
        self.last = self.codec.prefixes(self.bytes, self.last, len(self.last))

    def replace(self, start: int, end: int, b: bytes) -> int:
        """bytes[start:end] become b; returns the number of entries made anew. Entries depend on those within the
        longest token before them, so once so many in a row agree with the old ones, the rest of those holds too."""
        old, tail = self.last, len(self.bytes) - end
        self.bytes = self.bytes[:start] + b + self.bytes[end:]
        last, shift, same, longest = old[:start], start + len(b) - end, 0, self.codec.longest
        while len(last) < len(self.bytes):
            at = len(last)
            window = max(0, at + 1 - longest)
            for begin in range(window, at + 1):
                t = self.codec.ranks.get(self.bytes[begin : at + 1])
                if t is not None and (begin == 0 or self.codec.fits(last[begin - 1], t)):
                    last.append(t)
                    break
            behind = at >= start + len(b)
            same = same + 1 if behind and last[at] == old[at - shift] else 0
            if same > longest and tail:
                self.last = last + old[at + 1 - shift :]
                return at + 1 - start
        self.last = last
        return len(last) - start

    @property
    def ids(self) -> list[int]:
        return self.codec.walk(self.last)


_codecs: dict[tuple[str, str], Codec] = kept("bpe")


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    alone("bpe")
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def _default() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens."""

    def run(batches):
        import pyarrow as pa

        c = codec(path, pattern)
        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                packed = [c.encode_packed(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, ids binary, n_tokens bigint")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: what the ids stand for, from encoded()'s rows."""

    def run(batches):
        import pyarrow as pa

        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(unpack(p or b"")) for p in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, decodes the ids, and digests both, in one pass."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    def run(batches):
        import pyarrow as pa

        c = codec(path, pattern)
        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                packed = [c.encode_packed(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([sha256(p).hexdigest() for p in packed]),
                        pa.array([sha256(c.decode(unpack(p))).hexdigest() for p in packed]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
