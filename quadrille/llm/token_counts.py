"""Operator 4: exact token counts by prefix dynamic programming.

For every prefix of a text its exact token count is kept: how many tokens the library would give for the text cut there.  A text is cut into words as the
tokenizer does; in a word the dynamic programme of bpe.py gives the count of every prefix were the word to end there, and the counts of the words before are added.
The text's count, whether it is over a limit, and where to cut it for a budget are read off that one array, whether the cut falls between words or
inside one; nothing is encoded again.  A word's counts are remembered, as they don't depend on what stands around it.

Prefixes are those of the text as the tokenizer reads it (NFC, lower case); positions are its code points.  Null and empty texts: 0 tokens.  Special strings
inside a text count as one token each, as is the library's default.  Ties do not arise: merges have distinct ranks.  Very long texts and words: linear
work, four bytes a code point while a slice of the batch is worked on.  Repeated rows and extra columns pass through; a column named as the result is replaced.
"""

import functools
import gc
import json
import re
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe, Memo
from .common import struct_udf, table

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: Stands for the end-of-word mark: the last byte of a word is moved up by this.
LAST = 0xE000
#: The characters of the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class WordBpe:
    """The tokenizer of a file of the kind word_bpe_49k.json."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        as_byte = {c: chr(b) for b, c in byte_chars().items()}

        def inner(token: str) -> str:
            if token.endswith(end) and token != end:
                body = [as_byte[c] for c in token[: -len(end)]]
                return "".join(body[:-1]) + chr(LAST + ord(body[-1]))
            return "".join(as_byte[c] for c in token)

        self.specials = [t["content"] for t in spec["added_tokens"]]
        tokens = {inner(t): i for t, i in model["vocab"].items() if t not in self.specials}
        ranks = {tuple(map(inner, m if isinstance(m, list) else m.split(" "))): k for k, m in enumerate(model["merges"])}
        self.bpe = Bpe(tokens, lambda a, b: ranks.get((a, b)), {chr(LAST + b): chr(b) for b in range(256)})
        self.capitals = {t.upper(): t for t in self.specials}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        # No word holds white space, so what stands between is cut into words on its own.
        self.pieces = re.compile(f"[{SPACE}]+|[^{SPACE}]+").findall
        self.word = Memo(self._word, 1 << 19, longest=64)
        self.piece = Memo(self._piece, 1 << 20, longest=64)

    @staticmethod
    def symbols(word: str) -> str:
        return word.encode("utf-8", "replace").decode("latin-1")

    def _counts(self, word: str) -> list[int]:
        return next(self.bpe.counts([self.symbols(word)]))

    def _word(self, word: str, counts: list[int] | None = None) -> bytes:
        """The count of every prefix of a word, from one code point on, were the word to end there; four bytes each."""
        counts = counts or self._counts(word)
        if "'" in word and len(word) > 1:  # a part of a contraction would be cut into other words
            return array("i", [*(sum(self._counts(w)[-1] for w in self.words(word[:k])) for k in range(1, len(word))), counts[-1]]).tobytes()
        if len(counts) > len(word) + 1:
            ends, at = [], 0
            for c in word:
                at += len(c.encode("utf-8", "replace"))
                ends.append(counts[at])
            return array("i", ends).tobytes()
        return array("i", counts[1:]).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Works out all words of pieces that are new, in order of their bytes, so that the programme goes over common beginnings once."""
        new = set()
        for p in pieces:
            if p not in self.piece and p[0] not in SPACE and p not in self.capitals:
                new.update((p,) if p.isalpha() else self.words(p))
        new = sorted([w for w in new if w not in self.word])  # code points sort as their UTF-8 bytes do
        for word, counts in zip(new, self.bpe.counts(map(self.symbols, new))):
            if len(word) <= self.word.longest:
                self.word.put(word, self._word(word, counts))

    def _piece(self, piece: str) -> bytes:
        """The same for a run between white space; white space adds nothing."""
        if piece in self.capitals:
            return self.special(self.capitals[piece])
        if piece[0] in SPACE:
            return bytes(4 * len(piece))
        found = [piece] if piece.isalpha() else self.words(piece)
        out = self.word[found[0]]
        for w in found[1:]:
            before = int.from_bytes(out[-4:], "little")
            out += array("i", [before + n for n in memoryview(self.word[w]).cast("i")]).tobytes()
        return out

    def special(self, text: str) -> bytes:
        """The counts of a special string: one token, but its parts are ordinary text."""
        parts = [sum(self._counts(w)[-1] for w in self.words(self.normal(text[:k]))) for k in range(1, len(text))]
        return array("i", [*parts, 1]).tobytes()

    def split(self, text: str) -> list[str]:
        """The text in pieces: white space, what stands between, and special strings in capitals, which no other piece has."""
        if not any(s in text for s in self.specials):
            return self.pieces(self.normal(text))
        out = []
        for part in self.at_special.split(text):
            out += [part.upper()] if part in self.specials else self.pieces(self.normal(part))
        return out

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def prefixes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all prefixes of each text, the empty one first, laid end to end; and where each text ends among them."""
        split = [self.split(t) for t in texts]
        flat = [p for pieces in split for p in pieces]
        self.learn(set(flat))
        inside = np.frombuffer(b"".join(map(self.piece.__getitem__, flat)), "<i4")
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        n = np.fromiter(map(len, split), np.int64, len(split))
        first, some = np.cumsum(n) - n, n > 0
        before = inside[np.cumsum(size) - 1].astype(np.int64)
        before = np.cumsum(before) - before
        before -= np.repeat(before[first[some]], n[some])  # each text starts at 0
        length = np.zeros(len(split), np.int64)
        if some.any():
            length[some] = np.add.reduceat(size, first[some])
        counts = np.insert(inside + np.repeat(before, size).astype(np.int32), np.cumsum(length) - length, 0)
        return counts, np.cumsum(length + 1)


def fits(counts: np.ndarray, budget: int) -> int:
    """The length of the longest prefix within the budget: a look-up in the stored counts (which may fall where longer tokens come about)."""
    return len(counts) - 1 if counts[-1] <= budget else int(np.flatnonzero(counts <= budget)[-1])


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordBpe:
    """One tokenizer a worker process, whatever the number of tasks."""
    made = WordBpe(path)
    gc.freeze()  # the vocabulary stays; collections need not look through it
    return made


def _udf(path: str, stored: bool, limit: int):
    def make():
        bpe = tokenizer_of(path)

        def work(texts: pa.Array):
            counts, ends = bpe.prefixes([t or "" for t in texts.to_pylist()])
            begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            kept = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(counts))] if stored else []
            return [counts[ends - 1].astype(np.int64), [fits(counts[a:b], limit) for a, b in zip(begin, ends)], *kept]

        return work

    return struct_udf(make, [("n_tokens", pa.int64()), ("chars_in_limit", pa.int64()), *([("counts", pa.list_(pa.int32()))] if stored else [])])


def token_counts(docs: DataFrame, text: str = "text", out: str = "tokens", stored: bool = False, limit: int = LIMIT, model: str | None = None) -> DataFrame:
    """docs with a struct read off the prefix counts: n_tokens, chars_in_limit (the longest prefix within limit tokens) and, if stored, counts: that of every prefix, the empty one first."""
    return docs.withColumn(out, _udf(model or public_tokenizers.path(MODEL), stored, limit)(F.col(text)))


def within(counts, budget: int):
    """The length of the longest prefix within a budget, from a column of stored counts alone."""
    return F.array_max(F.transform(counts, lambda n, k: F.when(n <= budget, k)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.col("tokens")
    return token_counts(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), t["n_tokens"].alias("n_tokens"), (t["n_tokens"] > LIMIT).alias("over_limit"), t["chars_in_limit"].alias("chars_in_limit"))
