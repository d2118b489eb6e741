"""Exact, fast encoders for the public vocabularies that packing and chunked BPE use.

Both vocabularies are byte-pair merges in which any two neighbours merge if their concatenation is a token, the
lowest id first; a merge-rank encoder gives the library's ids then, and tests hold it to that. The word
vocabulary's word end is written as a zero byte, which no word handed to the ranks may hold; such words, and
whatever holds a special token's string, go to the library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_OF_TEXT = "<|endoftext|>"


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; a full path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_padding()
    t.no_truncation()
    return t


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """ids of whole texts under a vocabulary whose words are encoded one by one; words are kept, up to a bound."""

    #: The vocabulary's own pattern of words.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, name: str, most: int = 200_000):
        import tiktoken

        model = json.load(open(vocabulary(name), encoding="utf-8"))
        special = {x["content"] for x in model["added_tokens"]}
        back, ranks = printable_bytes(), {}
        for token, i in model["model"]["vocab"].items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(back[c] for c in (token[:-4] if end else token)) + b"\0" * end] = i
        self.library, self.special, self.most, self.kept, self.old = library(name), special, most, {}, {}
        self.ranks = tiktoken.Encoding(name="words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Words are split at \\x20 and \\n alone; other white space inside them is the library's affair."""
        words, kept = text.replace("\n", " ").split(" "), self.kept
        missing = set(words).difference(kept)
        if not missing:
            return b"".join(map(kept.__getitem__, words))
        if len(kept) > self.most:  # what was used since the last turn stays for another one
            self.old, self.kept = kept, {}
            kept, missing = self.kept, set(words)
        old = self.old
        new = [w for w in missing if w not in old]
        for w in missing.difference(new):
            kept[w] = old[w]
        plain = [w for w in new if REGULAR.fullmatch(w) and "<|" not in w]
        if plain:
            counts = [self.WORDS.findall(w.lower()) for w in plain]
            flat = self.ranks.encode_ordinary("\0".join(x for c in counts for x in c) + "\0") if any(counts) else []
            ids, ends = np.array(flat, dtype="<u4"), self.ends()
            stops = np.flatnonzero(ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
            raw, at, done = ids.tobytes(), 0, 0
            for w, c in zip(plain, counts):
                done += len(c)
                stop = int(stops[done - 1]) if done else 0
                kept[w] = raw[at * 4 : stop * 4]
                at = stop
        done = set(plain)
        for w in new:
            if w not in done:
                kept[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(kept.__getitem__, words))

    def ends(self) -> np.ndarray:
        """Which ids end a word."""
        if not hasattr(self, "_ends"):
            values = self.ranks._mergeable_ranks
            self._ends = np.zeros(max(values.values()) + 1, dtype=bool)
            self._ends[[i for token, i in values.items() if token.endswith(b"\0")]] = True
        return self._ends


#: Visible Latin characters that normal form leaves alone and that each lower-case to one, so the ranks see what the library sees.
REGULAR = regex.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]+")


@lru_cache(maxsize=2)
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


@lru_cache(maxsize=2)
def byte_ranks(name: str):
    """The byte-level vocabulary of a tokenizers file as merge ranks, with its pattern and its special tokens."""
    import tiktoken

    model, back = json.load(open(vocabulary(name), encoding="utf-8")), printable_bytes()
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    #: Fixed value: the pattern of words of byte-level vocabularies of this family.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(name="bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class ByteWords:
    """ids of whole texts under a byte-level vocabulary, as bytes; words after a lone space are kept, up to a bound.

    Every text of this family splits before a lone space between two other characters, so what stands between two
    such spaces is encoded by itself. A special token's string becomes its id, as the library has it.
    """

    #: A lone space between two other characters.
    LONE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, name: str, most: int = 250_000):
        self.ranks, self.most, self.kept, self.old = byte_ranks(name), most, {}, {}
        self.special = re.compile("(" + "|".join(map(re.escape, self.ranks._special_tokens)) + ")" if self.ranks._special_tokens else r"((?!))")
        self.spaced = np.zeros(self.ranks.n_vocab, bool)  # ids that start with a space
        self.spaced[[i for raw, i in self.ranks._mergeable_ranks.items() if raw.startswith(b" ")]] = True

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.ranks._special_tokens):
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join([self.plain(p) if i % 2 == 0 else int(self.ranks._special_tokens[p]).to_bytes(4, "little") for i, p in enumerate(parts)])

    def ids(self, text: str) -> bytes:
        return np.array(self.ranks.encode_ordinary(text), dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *words = text.split(" ")
        missing = set(words).difference(self.kept)
        if not first or first[-1].isspace() or any(not w or w[0].isspace() or w[-1].isspace() for w in missing):
            first, *words = self.LONE.split(text)  # other white space stays within the stretches
            missing = set(words).difference(self.kept)
        if missing:
            if len(self.kept) > self.most:  # what was used since the last turn stays for another one
                self.old, self.kept = self.kept, {}
                missing = set(words)
            self.learn(missing)
        return self.ids(first) + b"".join(map(self.kept.__getitem__, words))

    def learn(self, words: set[str]) -> None:
        """Encode words in one call: of a word without a space in it, the first id starts with one and no other does."""
        kept, old, new = self.kept, self.old, []
        for w in words:
            if (got := old.get(w)) is not None:
                kept[w] = got
            elif " " in w:
                kept[w] = self.ids(" " + w)
            else:
                new.append(w)
        if new:
            ids = np.array(self.ranks.encode_ordinary(" " + " ".join(new)), dtype="<u4")
            raw, stops = ids.tobytes(), (4 * np.flatnonzero(self.spaced[ids])).tolist()
            for w, a, b in zip(new, stops, [*stops[1:], len(raw)], strict=True):
                kept[w] = raw[a:b]
