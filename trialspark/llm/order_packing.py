"""Order-preserving packing: where to cut the stream of documents into windows, by dynamic programming.

Documents follow one another as a Spark task reads them, each ended by the separator. Windows may end at a document's
end, after a sentence at a penalty, or, within stretches that have neither, every STEP tokens at a larger one. A window
shorter than the capacity costs its padding, but one whose length is a power of two is not padded. The cheapest cuts come
from one pass over the possible ends: the best start within reach is the front of a queue kept monotone in
cost + position (linear time in all), and starts at distances that are powers of two are looked up.

A task commits all but the last windows of a stretch and carries these on, so it holds one stretch (or one document)
at a time. Its last windows may end anywhere, which leaves next to nothing to pad. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import read, texts_of, tune
from .tokens import ByteWords, byte_ranks

CAPACITY, VOCABULARY, SEPARATOR = 2048, "byte_bpe_50k.json", 1
#: What a cut costs, in tokens of padding: after a sentence, within one, and each window.
SENTENCE, WITHIN, WINDOW = 16, 64, 4
#: The longest stretch without a possible end, the distance of ends within longer ones; tokens planned at once, windows carried on.
LONGEST, STEP, STRETCH, CARRIED = 256, 64, 1 << 20, 8


@lru_cache(maxsize=2)
def marks(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id: does its text end a sentence, does it start with white space, does it end with a new line."""
    ranks = byte_ranks(name)
    ends, opens, lines = (np.zeros(ranks.n_vocab, bool) for _ in range(3))
    for i in range(ranks.n_vocab):
        raw = ranks.decode_single_token_bytes(i)
        ends[i], opens[i], lines[i] = raw.rstrip(b"\"')]").endswith((b".", b"!", b"?")), raw[:1].isspace(), raw.endswith(b"\n")
    return ends, opens, lines


def ends_of(ids: np.ndarray, vocabulary: str = VOCABULARY, longest: int = LONGEST, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in one document's ids (the separator last), and each end's penalty; the last is its own end."""
    ends, opens, lines = marks(vocabulary)
    text = ids[:-1]
    sentence = np.flatnonzero((ends[text[:-1]] & opens[text[1:]]) | (lines[text[:-1]] & ~lines[text[1:]])) + 1 if len(text) > 1 else np.zeros(0, np.int64)
    stops = np.concatenate([[0], sentence, [len(ids)]])
    wide = np.flatnonzero(np.diff(stops) > longest)
    extra = [np.arange(stops[i] + step, stops[i + 1], step) for i in wide]
    at = np.concatenate([sentence, *extra, [len(ids)]]).astype(np.int64)
    penalty = np.full(len(at), SENTENCE, np.int64)
    penalty[len(sentence) : -1], penalty[-1] = WITHIN, 0
    order = np.argsort(at, kind="stable")
    return at[order], penalty[order]


def cheapest(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY, window: int = WINDOW) -> list[int]:
    """Indexes of the ends of the cheapest windows over [0, at[-1]]; at is rising and no gap passes the capacity.

    A window (i, j] costs `window`, penalty[j], and capacity less its length unless that is a power of two.
    """
    at, n = np.concatenate([[0], at]), len(at) + 1
    near: list[tuple] = [()] * n  # starts at distances that are powers of two
    rows, starts = [], []
    for p in range(capacity.bit_length()):
        i = np.searchsorted(at, at - (1 << p))
        hit = np.flatnonzero((at[i] == at - (1 << p)) & (1 << p <= capacity))
        rows.append(hit)
        starts.append(i[hit])
    for j, i in zip(np.concatenate(rows).tolist(), np.concatenate(starts).tolist()):
        near[j] = (*near[j], i)
    where, fees = at.tolist(), [0, *penalty.tolist()]
    cost, came = [0] * n, [0] * n
    queue = deque([(0, 0)])  # (cost + position, index), rising in both
    for j in range(1, n):
        here = where[j]
        while where[queue[0][1]] < here - capacity:
            queue.popleft()
        low, start = queue[0]
        low += capacity - here
        for i in near[j]:
            if cost[i] < low:
                low, start = cost[i], i
        cost[j], came[j] = low + fees[j] + window, start
        held = cost[j] + here
        while queue and queue[-1][0] >= held:
            queue.pop()
        queue.append((held, j))
    path, j = [], n - 1
    while j:
        path.append(j - 1)
        j = came[j]
    return path[::-1]


class Stream:
    """The documents of a task that no committed window holds yet: (doc_id, tokens in all, first token here, bytes of ids)."""

    def __init__(self, capacity: int, vocabulary: str, first_sequence: int):
        self.capacity, self.vocabulary, self.sequence = capacity, vocabulary, first_sequence
        self.docs: deque = deque()
        self.at, self.penalty, self.size = [], [], 0

    def add(self, doc, raw: bytes) -> None:
        at, penalty = ends_of(np.frombuffer(raw, "<u4"), self.vocabulary, min(LONGEST, self.capacity // 2 or 1), min(STEP, self.capacity // 4 or 1))
        self.docs.append((doc, len(raw) // 4, 0, raw))
        self.at.append(at + self.size)
        self.penalty.append(penalty)
        self.size += len(raw) // 4

    def commit(self, last: bool) -> Iterator[tuple]:
        """The pieces (doc, tokens, start, ids, sequence, offset) of all windows but the last few; of all at the task's end."""
        if not self.size:
            return
        at, penalty = np.concatenate(self.at), np.concatenate(self.penalty)
        if last:  # the rest may end anywhere
            anywhere = np.arange(max(1, self.size - 2 * self.capacity), self.size)
            anywhere = anywhere[~np.isin(anywhere, at)]
            order = np.argsort(np.concatenate([at, anywhere]), kind="stable")
            at, penalty = np.concatenate([at, anywhere])[order], np.concatenate([penalty, np.full(len(anywhere), WITHIN)])[order]
        path = cheapest(at, penalty, self.capacity)
        path = path if last else path[:-CARRIED]
        done = 0
        for j in path:
            offset, length = 0, int(at[j]) - done
            done = int(at[j])
            while length:
                doc, tokens, start, raw = self.docs.popleft()
                n = min(length, len(raw) // 4)
                yield doc, tokens, start, raw[: 4 * n], self.sequence, offset
                if n * 4 < len(raw):
                    self.docs.appendleft((doc, tokens, start + n, memoryview(raw)[4 * n :]))
                offset, length = offset + n, length - n
            self.sequence += 1
        later = at > done
        self.at, self.penalty, self.size = [at[later] - done], [penalty[later]], self.size - done


_encoders: dict[str, ByteWords] = {}


def pack_in_order(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, with_ids: bool = False, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of all documents.

    Documents keep the order in which tasks read docs (sort docs for another one), and a sequence holds documents of
    one task; numbers of sequences rise within a task. Null and empty texts are the separator alone. Texts of any
    length are encoded whole; repeated rows are packed one by one; among equally cheap cuts the longest window that
    is a plain one comes first. An empty table gives none. Columns of docs but doc_id and text are not read.
    """
    tune(docs.sparkSession)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, ByteWords(vocabulary))
        end = int(separator).to_bytes(4, "little")
        stream, doc_kind = Stream(capacity, vocabulary, TaskContext.get().partitionId() << 40), None

        def pieces(last: bool) -> Iterator[pa.RecordBatch]:
            out, kinds = tuple([] for _ in names), (doc_kind, *[pa.int64()] * 6, *([pa.binary()] if with_ids else []))
            for doc, tokens, start, ids, sequence, offset in stream.commit(last):
                for column, value in zip(out, (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, *([bytes(ids)] if with_ids else []))):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=list(names))

        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                stream.add(doc, encoder.encode(text) + end)
                if stream.size >= stretch:
                    yield from pieces(False)
        if doc_kind is not None:
            yield from pieces(True)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11(spark, sf_dir):
    return pack_in_order(read(spark, sf_dir, "documents").select("doc_id", "text"))
