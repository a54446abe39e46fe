"""Problem 6: encoding a whole corpus with a public byte-level BPE vocabulary.

The rank file is serialised as a sentencepiece BPE model: each of the 256 bytes becomes one private character, each token
the string of its bytes' characters, scored by its negative rank, with identity normalisation. A text is split into
pre-tokens by the vocabulary's pattern; each distinct pre-token is encoded once per batch; decoding is the inverse map.
Sentencepiece merges the best-scored adjacent pair whose joined piece is in the vocabulary, leftmost first, which is the
rank order of the vocabulary's own merges, so the ids are the same.

Defined results: null and empty texts give an empty list; blank texts are ordinary text; strings of special tokens are
ordinary text; bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"

#: Fixed value: the pre-token pattern published with the vocabulary.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: One character per byte, outside ASCII, white space and sentencepiece's own marks.
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]
_BYTE_TABLE = str.maketrans({chr(b): c for b, c in enumerate(BYTE_CHARS)})

#: Distinct pre-tokens kept per worker process; the memo is emptied beyond that (results do not depend on it).
MEMO_LIMIT = 400_000


def as_byte_chars(token: bytes) -> str:
    return token.decode("latin-1").translate(_BYTE_TABLE)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto (BPE) whose piece ids are the token ids; the unknown piece comes last."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = _field(1, as_byte_chars(token).encode()) + b"\x15" + np.float32(-rank).tobytes() + _number(3, 1)
        out += _field(1, piece)
    out += _field(1, _field(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, 2**64 - 1) + _number(42, 2**64 - 1)
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Encoder:
    """Encodes texts to ids and back."""

    def __init__(self, tokenizer_dir: str = TOKENIZER_DIR, rank_file: str = RANK_FILE) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(os.path.join(tokenizer_dir, rank_file))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.split = regex.compile(PRETOKEN_PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The pre-tokens of each text, all of them in the memo."""
        split = self.split
        each = [split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(each))
        if len(self.memo) > MEMO_LIMIT:
            self.memo.clear()
        new.difference_update(self.memo)
        if new:
            order = list(new)
            self.memo.update(zip(order, self.model.encode([as_byte_chars(w.encode()) for w in order], out_type=int, num_threads=1)))
        return each

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        look = self.memo.__getitem__
        return [list(chain.from_iterable(map(look, words))) for words in self.words(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer_dir: str = TOKENIZER_DIR, rank_file: str = RANK_FILE) -> Encoder:
    """The encoder of this process, built once."""
    key = (tokenizer_dir, rank_file)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def texts_of(column: pa.Array) -> list[str | None]:
    """Python strings of a binary column; what is not UTF-8 becomes U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()]


def encode_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "ids",
    tokenizer_dir: str = TOKENIZER_DIR,
    rank_file: str = RANK_FILE,
) -> DataFrame:
    """(id, ids ARRAY<INT>): one row for each row of df, no shuffle; other columns are pruned at the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir, rank_file)
        for batch in batches:
            ids = enc.encode(texts_of(batch.column(1)))
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values))], names=[id_col, out_col])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` array<int>")


def count_tokens(text: Column, tokenizer_dir: str = TOKENIZER_DIR, rank_file: str = RANK_FILE) -> Column:
    """The number of tokens of a text column as INT (0 for null and empty texts)."""

    @F.arrow_udf("int")
    def count(column: pa.Array) -> pa.Array:
        enc = encoder(tokenizer_dir, rank_file)
        each = enc.words(texts_of(column))
        size = {w: len(enc.memo[w]) for w in set(chain.from_iterable(each))}
        return pa.array([sum(map(size.__getitem__, words)) for words in each], type=pa.int32())

    return count(text.cast("binary"))
