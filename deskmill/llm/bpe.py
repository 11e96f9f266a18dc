"""Byte-level BPE through a sentencepiece model that is written from a rank file.

No training: the vocabulary becomes the piece list of a sentencepiece BPE model, every byte as one printable
character, with the negative rank as score and no normalisation. Sentencepiece then merges the best-scored pair
first, which is the lowest rank first. Each pre-token is encoded by itself; ids are the ranks. Decoding maps the
pieces back to bytes. Texts are encoded where they lie, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.names import free_name

CACHED = 150_000  # pre-tokens a task remembers; the memory of a worker stays bounded, results don't depend on it
LONGEST = 64  # longer pre-tokens are not remembered


def byte_characters() -> list[str]:
    """One printable character per byte: itself where it is printable Latin-1, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


BYTES = byte_characters()
TO_CHARACTERS = {b: c for b, c in enumerate(BYTES)}
TO_BYTE = {c: b for b, c in enumerate(BYTES)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank; the ranks have to be gapless."""
    with open(path, "rb") as lines:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n & (1 << 64) - 1)


def _bytes(tag: int, data: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model (protocol-buffer wire format) with the given tokens, ids in order."""
    # Field numbers and enum values of the public model format
    pieces_f, trainer_f, normaliser_f = 1, 2, 3
    piece_f, score_f, type_f, unknown_type = 1, 2, 3, 2
    model_type_f, vocab_size_f, bpe = 3, 4, 2
    whitespace_f, unk_f, bos_f, eos_f, pad_f = 22, 40, 41, 42, 43
    name_f, dummy_prefix_f, extra_spaces_f, escape_f = 1, 3, 4, 5
    out = []
    for rank, token in enumerate(tokens):
        text = "".join(BYTES[b] for b in token).encode()
        out.append(_bytes(pieces_f, _bytes(piece_f, text) + _varint(score_f << 3 | 5) + struct.pack("<f", -rank)))
    out.append(_bytes(pieces_f, _bytes(piece_f, b"<unk>") + _number(type_f, unknown_type)))
    out.append(_bytes(trainer_f, _number(model_type_f, bpe) + _number(vocab_size_f, len(tokens) + 1)
                      + _number(whitespace_f, 0) + _number(unk_f, len(tokens))
                      + _number(bos_f, -1) + _number(eos_f, -1) + _number(pad_f, -1)))
    out.append(_bytes(normaliser_f, _bytes(name_f, b"identity") + _number(dummy_prefix_f, 0)
                      + _number(extra_spaces_f, 0) + _number(escape_f, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes with the model; one per Python worker."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.table = [bytes(TO_BYTE.get(c, 0) for c in self.pieces.id_to_piece(i))
                      for i in range(self.pieces.get_piece_size() - 1)]
        self.known = {t: struct.pack("<I", i) for i, t in enumerate(self.table)}
        self.cache: dict[str, bytes] = {}

    def _one(self, token: str) -> bytes:
        data = token.encode("utf-8", "surrogatepass")
        found = self.known.get(data)  # a pre-token that is a token is not taken apart
        if found is None:
            ids = self.pieces.encode(data.decode("latin-1").translate(TO_CHARACTERS))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= LONGEST:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[token] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for a null or empty text."""
        get, one = self.cache.get, self._one
        return b"".join([get(t) or one(t) for t in self.split(text or "")])

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in memoryview(ids).cast("I")])


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(model: bytes, pattern: str) -> Codec:
    """The codec of this worker, kept between the tasks that it runs."""
    key = (hashlib.sha256(model).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def _columns(docs: DataFrame, source: str, run, added: list[tuple[str, T.DataType]]) -> DataFrame:
    """``docs`` with columns that ``run`` makes of one column; a column of the same name is replaced."""
    names = [n for n, _ in added]
    work_col = free_name("_in", [*docs.columns, *names])
    frame = docs.select(*[c for c in docs.columns if c not in names], F.col(source).alias(work_col))
    kept = [f for f in frame.schema if f.name != work_col]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])
    arrow = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}

    def work(batches):
        for batch in batches:
            made = run(batch.column(work_col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], *[pa.array(x, arrow[t]) for x, (_, t) in zip(made, added)]],
                [f.name for f in schema])

    return frame.mapInArrow(work, schema)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens``.

    Whole texts, no special tokens, no shuffle. Null and empty texts have no ids; repeated rows are encoded each;
    an empty table stays empty. Other columns are kept; ones named like an added column are replaced.
    """
    model = serialise_model(tokens)

    def run(texts):
        own = codec(model, pattern)
        ids = [own.encode(x) for x in texts]
        return ids, [len(x) // 4 for x in ids]

    return _columns(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, run,
                    [("ids", T.BinaryType()), ("n_tokens", T.LongType())])


def decode(frame: DataFrame, tokens: list[bytes], pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids; a null is decoded to no bytes."""
    model = serialise_model(tokens)

    def run(rows):
        own = codec(model, pattern)
        return ([own.decode(x or b"") for x in rows],)

    return _columns(frame, ids_col, run, [("decoded", T.BinaryType())])
