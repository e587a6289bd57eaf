"""Operator 1: SentencePiece encoding and decoding by a streaming Viterbi pass.

The public model is of the BPE kind, whose ids a maximum-score (unigram) path would not give.  The pass is therefore Viterbi over BPE: one
backpointer a position chosen by the neighbour rule (bpe.py), a window of the longest piece, ids committed where all surviving backpointer paths
meet.  Between two characters that no piece holds side by side all paths meet whatever the text, so what lies between such boundaries is a
segment of its own and may be remembered; every segment that is not goes through the pass.  A text is worked on in chunks that end at such a boundary.

Null: null ids and text.  Empty text: no ids.  A literal U+2581 counts as a space, as in the library.  Characters without a piece: one id a byte.
Ties: pieces of spaces alone have equal scores and are merged leftmost first, so a run of spaces is cut by length alone.  Very long texts, words and runs of
spaces: the pass keeps what lies after the last committed boundary.  Repeated rows and extra columns pass through; ids and decoded are columns that a caller names,
and a column of that name is replaced.
"""

import functools
import gc
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe, Memo
from .common import free_name, keeps, struct_udf, table

MODEL = "piece_bpe_32k.model"
#: Characters after which a chunk ends at its next boundary.
CHUNK = 1 << 16


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i).replace("▁", " "): i for i in plain}
        order = {p: -sp.get_score(i) for p, i in self.ids.items()}
        if any(" " in p.lstrip(" ") or "\n" in p or p.startswith("  ") and p.strip(" ") for p in self.ids):
            raise ValueError("pieces must not reach over a word's start, a line break or two spaces and a word")
        self.bpe = Bpe(self.ids, lambda a, b: order.get(a + b))
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # no piece holds any other two characters side by side
        self.space = np.array([self.ids[" "]], "<i4").tobytes()
        if min(order[p] for p in order if not p.strip(" ")) < max(order[p] for p in order if p.strip(" ")):
            raise ValueError("pieces of spaces must merge last")
        self.spaces = Memo(self.run, 1 << 10)
        self.units = Memo(self.unit, 1 << 18, longest=48)
        self.parts = Memo(self.part, 1 << 17, longest=48)
        self.split = re.compile(r" *[^ \n]+| +|\n").findall
        self.boundary = re.compile(r"(?<=[^ ]) |\n").search

    def run(self, spaces: str) -> bytes:
        """The ids of spaces alone, merged from the left: whole blocks of 16 come first."""
        n = len(spaces)
        blocks = max(0, n - 32) // 16
        rest = self.bpe.merge(" " * (n - 16 * blocks))
        return np.array([self.ids[" " * 16]] * blocks + [self.ids[p] for p in rest], "<i4").tobytes()

    def unit(self, unit: str) -> bytes:
        """The ids of a unit (spaces and the word after them), cut where no piece can reach over."""
        n = len(unit) - len(unit.lstrip(" "))
        if n == len(unit):
            return self.spaces[unit]
        if n > 1:  # spaces merge after everything else, with the last one if the word has left it alone
            word = self.units[unit[n - 1 :]]
            return self.spaces[unit[:n]] + word[4:] if word[:4] == self.space else self.spaces[unit[: n - 1]] + word
        out, at, beside = [], 0, self.beside
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in beside:
                out.append(self.parts[unit[at:k]])
                at = k
        return b"".join([*out, self.parts[unit[at:]]])

    def part(self, text: str) -> bytes:
        """The ids of a segment between two boundaries, by the streaming pass."""
        out: list[int] = []
        for committed in self.bpe.stream(text):
            for p in committed:
                if (i := self.ids.get(p)) is not None:
                    out.append(i)
                else:
                    out.extend(self.byte_ids[b] for b in p.encode("utf-8", "replace"))
        return array("i", out).tobytes()

    def chunks(self, text: str):
        """The text as the model sees it, with a space before it, in chunks; a unit is never divided."""
        text, at = " " + text.replace("▁", " "), 0
        while at < len(text):
            m = self.boundary(text, at + CHUNK)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        return b"".join(b"".join(map(self.units.__getitem__, self.split(c))) for c in self.chunks(text)) if text else b""

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec a worker process, whatever the number of tasks."""
    made = Codec(path)
    gc.freeze()  # the vocabulary stays; collections need not look through it
    return made


keeps(codec_of.cache_clear)


def _encoder(path: str):
    def make():
        packed = codec_of(path).packed

        def work(texts: pa.Array):
            flat = [packed(t or "") for t in texts.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), "<i4")), mask=texts.is_null())]

        return work

    return struct_udf(make, [("ids", pa.list_(pa.int32()))], 1 << 20)


def _decoder(path: str):
    def make():
        codec = codec_of(path)
        pieces = [codec.bytes.get(i, b"") for i in range(max(codec.bytes) + 1)]
        size = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(pieces), np.uint8)

        def work(lists: pa.Array):
            """All lists at once: the pieces' bytes laid end to end, without the space that encoding put before each text."""
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            n = size[ids]
            ends = np.cumsum(n)
            raw = flat[np.repeat(begin[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            stop = np.concatenate([[0], ends])[np.cumsum(counts)]
            start = np.concatenate([[0], stop[:-1]])
            full = stop > start
            raw = np.delete(raw, start[full])
            offsets = np.concatenate([[0], np.cumsum(stop - start - full)])
            data = raw.tobytes()
            try:
                data.decode()
            except UnicodeDecodeError:  # ids that no text has
                return [[None if x is None else codec.decode(x) for x in lists.to_pylist()]]
            mask = pa.array(np.asarray(lists.is_valid()))
            return [pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data), mask.buffers()[1])]

        return work

    return struct_udf(make, [("text", pa.string())])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None) -> DataFrame:
    """docs with the ids of each whole text; a column of that name is replaced."""
    return docs.withColumn(ids, _encoder(model or public_tokenizers.path(MODEL))(F.col(text))["ids"])


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    return rows.withColumn(text, _decoder(model or public_tokenizers.path(MODEL))(F.col(ids))["text"])


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as training reads it: id, source, language and token ids of each document taken; null texts have no ids, other columns end here."""
    ids = free_name(docs, "ids")
    rows = encode(docs.withColumn("text", F.coalesce("text", F.lit(""))), ids=ids)
    return rows.select("doc_id", "source", "lang", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the ids, their number, and whether decoding them gives the text back (a text that holds U+2581 does not)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return decode(encode(docs)).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"), "ids")
