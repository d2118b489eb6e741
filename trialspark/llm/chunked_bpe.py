"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over bytes cuts each text where its content says so, so documents that share a passage share its
chunks; each distinct chunk is encoded once and remembered (the memory is bounded; what falls out is encoded
again, but for what was used since the memory last turned over). A cut falls anywhere, within words too. So a chunk's
core, from its first space to its last, is kept apart from what lies between two cores, the join, and whether a piece may
end before a space isn't taken for granted either (runs of white space are held together): at every edge the words on
both sides are encoded together and apart, and where the ids differ the pieces become one and are encoded anew, until
all neighbours agree.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, read, schema_with, texts_of, tune, with_columns
from .tokens import byte_ranks

VOCABULARY, WINDOW, MASK_BITS, KEPT_BYTES, TRIED = "byte_bpe_50k.json", 24, 9, 96 << 20, 100_000
#: The start of a piece that a join's trial encodes: white space and a word.
HEAD = re.compile(r"\s*\S*")
MIX = 0x9E3779B97F4A7C15


def cut_points(raw: bytes, bits: int = MASK_BITS, window: int = WINDOW) -> list[int]:
    """Byte positions at which the rolling hash of the last `window` bytes ends in zeros, at most one a window.

    The hash is polynomial modulo 2**64: prefix sums of byte * p**i, differences scaled back by p**-i, so it
    depends on the window alone.
    """
    n = len(raw)
    if n <= 2 * window:
        return []
    powers, inverse = _powers(n)
    sums = np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[:n])
    hashes = (sums[window:] - sums[:-window]) * inverse[: n - window]
    hits = np.flatnonzero(((hashes * np.uint64(MIX)) >> np.uint64(64 - bits)) == 0) + window + 1
    points, last = [], 0
    for p in hits.tolist():
        if p - last >= window and p < n:
            points.append(p)
            last = p
    return points


_cache: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or len(_cache[0]) < n:
        size = max(1 << 17, 1 << n.bit_length())
        base = 0xD6E8FEB86659FD93
        back = pow(base, -1, 1 << 64)
        _cache[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b), np.uint64)])) for b in (base, back)]
    return _cache[0], _cache[1]


class ChunkEncoder:
    """Encodes whole texts; remembers the chunks' ids as (count, decimal digits, decoded text)."""

    def __init__(self, name: str = VOCABULARY, kept_bytes: int = KEPT_BYTES):
        self.ranks, self.kept, self.old, self.held, self.most = byte_ranks(name), {}, {}, 0, kept_bytes // 2
        self.special = re.compile("|".join(map(re.escape, self.ranks._special_tokens)) or r"(?!)")
        self.tried: dict[tuple[str, str], bool] = {}
        self.digits = [str(i) for i in range(self.ranks.n_vocab)]
        self.asked = self.encoded = self.repaired = 0

    def plain(self, text: str) -> tuple[int, str, str]:
        """A core or a join, encoded once while it is remembered."""
        self.asked += 1
        got = self.kept.get(text)
        if got is None:
            got = self.old.get(text)
            if got is None:
                self.encoded += 1
                ids = self.ranks.encode_ordinary(text)
                digits = self.digits
                got = (len(ids), ",".join([digits[i] for i in ids]), self.ranks.decode(ids))
            self.held += 200 + 4 * len(text) + len(got[1])
            if self.held > self.most:  # what was used since the last turn stays for another one
                self.old, self.kept, self.held = self.kept, {}, 0
            self.kept[text] = got
        return got

    def stretches(self, text: str) -> list[str]:
        """The text as cores of chunks and joins, in order; each but the first starts at a space."""
        raw = text.encode("utf-8", "surrogatepass")
        points = cut_points(raw)
        if not points:
            return [text]
        if len(raw) != len(text):  # to code points, moved back to a character's start
            starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            points = sorted({int(starts[p - 1]) for p in points})
        out, done = [], 0
        for left, right in zip(points, [*points[1:], len(text)]):
            # the chunk [left, right): its core goes from its first space to its last; before it is a join
            first = text.find(" ", max(left, done + 1), right)
            if first < 0:  # no space: the join grows over the whole chunk
                continue
            last = text.rfind(" ", first + 1, right)
            if done == 0:  # the first chunk's core reaches back to the text's start
                head = text.rfind(" ", 1, left)
                if head > 0:
                    out.append(text[:head])
                    done = head
            out.append(text[done:first])
            done = first
            if last > done:
                out.append(text[done:last])
                done = last
        out.append(text[done:])
        return out

    def agrees(self, left: str, right: str) -> bool:
        """Whether the last word of one piece and the first of the next give the same ids together and apart."""
        pair = left[max(left.rfind(" ", 0, len(left) - 1), 0) :], HEAD.match(right)[0]
        got = self.tried.get(pair)
        if got is None:
            ids = self.ranks.encode_ordinary
            got = ids(pair[0] + pair[1]) == ids(pair[0]) + ids(pair[1])
            if len(self.tried) >= TRIED:
                self.tried.clear()
            if len(pair[0]) + len(pair[1]) <= 200:  # longer words are tried anew
                self.tried[pair] = got
        return got

    def agreed(self, pieces: list[str]) -> list[str]:
        """The pieces, those whose join doesn't agree made one; a grown piece is tried with both its neighbours again."""
        out: list[str] = []
        for piece in pieces:
            out.append(piece)
            while len(out) > 1 and not self.agrees(out[-2], out[-1]):
                self.repaired += 1
                last = out.pop()
                out[-1] += last
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        """How many ids, the ids as decimals joined by commas, and what they decode to."""
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [self.plain(s) for s in self.agreed(self.stretches(text[at : m.start()]))] if m.start() > at else []
            parts.append((1, str(self.ranks._special_tokens[m[0]]), m[0]))
            at = m.end()
        if at < len(text):
            parts += [self.plain(s) for s in self.agreed(self.stretches(text[at:]))]
        return sum(p[0] for p in parts), ",".join([p[1] for p in parts if p[0]]), "".join([p[2] for p in parts])


_encoders: dict = {}


def encode_docs(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens, ids (decimals joined by commas) and decoded text.

    Null and empty texts have no ids and decode to the empty text; a special token's string becomes its id.
    Texts of any length are encoded whole; repeated rows give repeated results; nothing depends on an order, so there are no ties; an empty table gives none. Columns of docs named n_tokens,
    ids or decoded are replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop("n_tokens", "ids", "decoded")

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, ChunkEncoder(vocabulary))
        done = [encoder.encode(t) for t in texts_of(batch)]
        return with_columns(batch, n_tokens=pa.array([d[0] for d in done], pa.int64()), ids=pa.array([d[1] for d in done], pa.string()), decoded=pa.array([d[2] for d in done], pa.string()))

    return map_rows(docs, add, schema_with(docs, n_tokens="bigint", ids="string", decoded="string"))


def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    tune(spark)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The operator's ids and decoded texts as digests, before they leave the task."""
        encoder = _encoders.get(VOCABULARY) or _encoders.setdefault(VOCABULARY, ChunkEncoder(VOCABULARY))
        done = [encoder.encode(t) for t in texts_of(batch)]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d[0] for d in done], pa.int64()), pa.array([sha(d[1]) for d in done]), pa.array([sha(d[2]) for d in done])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(docs, digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
