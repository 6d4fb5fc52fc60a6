"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed and rebuilt as a ``tokenizers`` model: normaliser, metaspace marker,
scores (unigram) or merges ranked by score (BPE), byte fallback. Texts are encoded by chunks (white
space with the word that follows): no piece holds the marker after another letter, which is
checked, so chunks are independent. Chunks new to a worker are encoded as one multithreaded batch
and each is held against the SentencePiece library.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
from tokenizers import Tokenizer, models, normalizers

from helixframe.llm.common import bounded_batches

MARK = "▁"
#: Chunks whose ids a Python worker keeps; it starts afresh beyond that.
CACHE = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def parse(path: str) -> sentencepiece_model_pb2.ModelProto:
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def rebuild(proto: sentencepiece_model_pb2.ModelProto) -> Tokenizer:
    """A tokenizers model of the pieces. User-defined pieces and removal of extra white space are not supported."""
    if any(p.type == USER for p in proto.pieces) or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("models with user-defined pieces or removed extra white space are not supported")
    pieces = [p.piece for p in proto.pieces]
    unknown = next(k for k, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    fallback = proto.trainer_spec.byte_fallback
    if proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk_id=unknown, byte_fallback=fallback)
    else:
        place = {p.piece: (-p.score, k) for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        merges = [
            (place[piece], place[piece[:k]], (piece[:k], piece[k:]))
            for piece in place
            for k in range(1, len(piece))
            if piece[:k] in place and piece[k:] in place
        ]
        model = models.BPE(
            {p: k for k, p in enumerate(pieces)}, [m[2] for m in sorted(merges)],
            unk_token=pieces[unknown], fuse_unk=True, byte_fallback=fallback,
        )
    tokenizer = Tokenizer(model)
    if proto.normalizer_spec.precompiled_charsmap:
        tokenizer.normalizer = normalizers.Precompiled(proto.normalizer_spec.precompiled_charsmap)
    return tokenizer


class Codec:
    """Encoder and decoder of one model file, with a bounded store of chunks."""

    def __init__(self, path: str) -> None:
        proto = parse(path)
        self.tokenizer = rebuild(proto)
        self.library = SentencePieceProcessor(model_file=path)
        self.prefix = " " if proto.normalizer_spec.add_dummy_prefix else ""
        crosses = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type == NORMAL)
        self.chunk = re.compile(r"(?s).+") if crosses or self.tokenizer.normalizer else re.compile(r" *[^ ]+| +")
        self.ids: dict[str, bytes] = {}
        self.differs: set[str] = set()
        self.surface = []
        for p in proto.pieces:
            if p.type == BYTE:
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(MARK, " ").encode())

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) > CACHE:
            self.ids.clear()
        new = [c for c in chunks if c not in self.ids]
        for c, e in zip(new, self.tokenizer.encode_batch([c.replace(" ", MARK) for c in new], add_special_tokens=False)):
            self.ids[c] = array.array("I", e.ids).tobytes()
        plain = [c for c in new if not self.prefix or c.startswith(" ") and len(c) > 1]
        for c, want in zip(plain, self.library.encode([c[len(self.prefix) :] for c in plain], num_threads=1)):
            if self.ids[c] != array.array("I", want).tobytes():
                self.differs.add(c)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """For each text its ids as little-endian unsigned 32-bit numbers, and whether every chunk
        agrees with the SentencePiece library."""
        split = [self.chunk.findall(self.prefix + t) if t else [] for t in texts]
        self.learn(set().union(*split) if split else set())
        ids = self.ids
        return [(b"".join([ids[c] for c in s]), not self.differs or self.differs.isdisjoint(s)) for s in split]

    def decode(self, raw: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        out = b"".join(map(self.surface.__getitem__, array.array("I", raw)))
        text = out.decode("utf-8", "replace")
        return text[len(self.prefix) :] if text.startswith(self.prefix) else text


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, parity) for each row of ``docs`` (doc_id, text).

    ``ids`` is array<int>; ``parity`` tells that the SentencePiece library gives the same ids. Null
    and empty texts have no ids; repeated rows each get a row; no rows give none; other columns are
    not read.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = codec(model).encode([t or "" for t in batch["text"]])
            ids = [np.frombuffer(r, "<u4").astype(np.int32) for r, _ in done]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "parity": [p for _, p in done]})

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, "doc_id long, ids array<int>, parity boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for each row of ``encoded`` (doc_id, ids); null ids count as none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [codec(model).decode(np.asarray([] if i is None else i, "<u4").tobytes()) for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": text})

    return bounded_batches(encoded).select("doc_id", "ids").mapInPandas(each, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), parity, round_trip
    (the ids decode to the text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            done = c.encode(texts)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(r) // 4 for r, _ in done],
                    "ids_crc32": [zlib.crc32(r) for r, _ in done],
                    "parity": [p for _, p in done],
                    "round_trip": [c.decode(r) == t for (r, _), t in zip(done, texts)],
                }
            )

    schema = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, schema)
