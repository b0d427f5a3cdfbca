"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that is adjacent in no vocabulary token can be joined by no
merge. Such pairs are certain cuts: every word is cut there, the fragments are
encoded independently and their ids are concatenated. Fragments that end a
word carry the end-of-word mark, the others do not.

White space never lies inside a token of this kind of vocabulary, so a text is
encoded as its white-space-separated pieces, and each worker keeps the pieces
it has met, up to a fixed number, which changes no result.

Defined results: a null text is encoded as the empty text, which has no ids
and decodes to the empty text; strings of special tokens in a text become
those tokens; rows are independent, so ties and repeated rows need no rule;
an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import unicodedata
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import documents, mapped, text_of

#: The vocabulary of the registered query.
VOCABULARY = "word_bpe_49k.json"
#: Pieces that one worker remembers before it starts afresh.
REMEMBERED = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level vocabularies use:
    printable Latin-1 stands for itself, the rest for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers-format BPE vocabulary with word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model["end_of_word_suffix"]
        self.last = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.end)
        self.inner = models.BPE(vocab=vocab, merges=merges)
        self.letters = byte_letters()
        self.joined = self.inside_pairs(vocab, self.end)
        split = next(p for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    @staticmethod
    def inside_pairs(vocab, end: str) -> frozenset[str]:
        """Every pair of letters adjacent inside some token."""
        found = set()
        for token in vocab:
            body = token.removesuffix(end)
            found.update(map("".join, zip(body, body[1:])))
        return frozenset(found)

    def fragments(self, word: str) -> list[str]:
        """word (in byte letters) cut at every pair that no token holds."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _word(self, word: str) -> bytes:
        return self._letters(word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()]))

    def _letters(self, letters: str) -> bytes:
        *inner, last = self.fragments(letters)
        ids = [t.id for fragment in inner for t in self.inner.tokenize(fragment)]
        ids += [t.id for t in self.last.tokenize(last)]
        return struct.pack(f"<{len(ids)}I", *ids)

    @cached_property
    def newer(self) -> re.Pattern:
        """Characters that Python's tables do not know, and that the library's newer ones may."""
        unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
        starts = [c for i, c in enumerate(unknown) if i == 0 or unknown[i - 1] != c - 1]
        stops = [c for i, c in enumerate(unknown) if i + 1 == len(unknown) or unknown[i + 1] != c + 1]
        return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, stops)) + "]")

    def _by_library(self, text: str) -> bytes:
        """As _plain, with the library's own normalizer and cuts."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([self._letters(word) for word, _ in words])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without white space and special tokens."""
        if not text.isascii():
            if self.newer.search(text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        out, known = [], self.known_words
        for word in self.words.findall(text.lower()):
            ids = known.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a text without white space."""
        if not self.specials.search(piece):
            return self._plain(piece)
        out, at = [], 0
        for m in self.specials.finditer(piece):
            out += [self._plain(piece[at:m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(piece[at:])])

    def encode(self, text: str) -> bytes:
        pieces = self.space.split(text) if self.odd_space.search(text) else text.split()
        known, out = self.known, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as the library does where a vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


def _worker_bpe(path: str) -> ForcedBoundaryBPE:
    """One encoder for each vocabulary and Python worker; tasks that reuse a worker reuse it."""
    kept = sys.modules.setdefault("spindrift_worker", types.ModuleType("spindrift_worker")).__dict__
    if ("bpe", path) not in kept:
        kept["bpe", path] = ForcedBoundaryBPE(path)
    return kept["bpe", path]


def encode(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """docs with ids (binary, little-endian 32-bit) and, if asked for, their decoded text.

    path is a vocabulary file that every executor can read.
    """
    path = path or default_vocabulary()

    def run(batch):
        bpe = _worker_bpe(path)
        ids = [bpe.encode(t) for t in batch.column(0).to_pylist()]
        return [pa.array(ids, pa.binary())] + ([pa.array(map(bpe.decode, ids), pa.string())] if decode else [])

    return mapped(docs, {"text": text_of()}, run, "ids binary" + (", decoded string" if decode else ""), without=["text", "ids", "decoded"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (with ids) with decoded in place of ids; null ids decode to the empty text."""
    path = path or default_vocabulary()

    def run(batch):
        bpe = _worker_bpe(path)
        return [pa.array([bpe.decode(ids or b"") for ids in batch.column(0).to_pylist()], pa.string())]

    return mapped(encoded, {"ids": F.col("ids")}, run, "decoded string", without=["ids"])


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(documents(spark, sf_dir).select("doc_id", "text"), decode=True))
