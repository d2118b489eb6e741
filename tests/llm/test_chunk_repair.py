"""Joins of chunks are repaired until they agree with encoding the whole."""

import random

import pyarrow.parquet as pq

from trialspark.llm import chunked_bpe
from trialspark.llm.tokens import library


def test_pieces_that_disagree_become_one():
    encoder = chunked_bpe.ChunkEncoder()
    assert encoder.agreed(["hello", " world", " again"]) == ["hello", " world", " again"] and encoder.repaired == 0
    assert encoder.agreed(["hel", "lo wor", "ld", " again"]) == ["hello world", " again"] and encoder.repaired == 2
    assert encoder.agreed([""]) == [""] and encoder.agreed(["x"]) == ["x"]


def test_any_cuts_are_repaired_to_the_librarys_ids():
    encoder, lib, rng = chunked_bpe.ChunkEncoder(), library("byte_bpe_50k.json"), random.Random(5)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    for text in [t for t in texts if t][:80] + ["  a\n\n b  'll don't 12 34.5 é☃ " * 9]:
        cuts = sorted(rng.sample(range(1, len(text)), min(12, len(text) - 1)))
        pieces = encoder.agreed([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])])
        assert "".join(pieces) == text
        got = [i for p in pieces for i in encoder.ranks.encode_ordinary(p)]
        assert got == lib.encode(text, add_special_tokens=False).ids


def test_runs_of_white_space_are_repaired_within_whole_texts():
    """Edges at any space: where white space runs, pieces disagree and grow; the ids are the library's all the same."""
    encoder, lib, rng = chunked_bpe.ChunkEncoder(kept_bytes=200_000), library("byte_bpe_50k.json"), random.Random(8)
    units = ["word", "It's", "\n", "\t", " ", "  ", "\xa0", "12", "é", "...", "x" * 30, "日本", "😀"]
    for _ in range(60):
        text = "".join(rng.choice(units) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(50, 900)))
        n, ids, decoded = encoder.encode(text)
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want) and decoded == text
    assert encoder.repaired > 0
