"""Byte-level BPE: the tokenizers library over Arrow batches, with a byte-to-character table both ways.

The rank file gives the vocabulary; its merges are every split of a token into two known tokens, in the order of the ranks.
Bytes are shown to the library as printable characters, one each; it also cuts the texts, by the pattern given. Decoding turns the
vocabulary's characters back into bytes by the same table, and joins the bytes of the ids of many texts in one Arrow call.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 256  # texts encoded at a time
RANKS = "byte_bpe_multi_50k.tiktoken"


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next character from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes with the ranks in a file; pattern cuts a text into pieces that never merge with each other."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.table = byte_characters()
        shown = lambda token: token.decode("latin-1").translate(self.table)
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
            splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown(a), shown(b)) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)  # the matches alone, each apart
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {ch: b for b, ch in self.table.items()}
        tokens = {i: bytes(map(byte_of.__getitem__, token)) for token, i in self.tokenizer.get_vocab().items()}
        every = range(max(tokens) + 1)
        self.vocabulary = pa.array([tokens.get(i) for i in every], pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in every], pa.large_binary())

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and where each text's begin and end in them."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        bounds = np.cumsum([0, *map(len, found)])
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(bounds[-1])), bounds

    def encode(self, texts: Iterable[str]) -> Iterator[str]:
        """The ids of each text in decimal, joined by commas."""
        texts = iter(texts)
        while some := list(itertools.islice(texts, SLICE)):
            ids, bounds = self.ids_of(some)
            yield from (part.tobytes()[:-1].decode() for part in parts_of(*joined(self.decimal, ids), bounds))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of each text; a character whose bytes lie in several tokens comes out whole, as bytes are joined before UTF-8 is read."""
        return parts_of(*joined(self.vocabulary, ids), bounds)

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the first character of its text that it touches, the one after the last, and whether it starts inside a character."""
        raw, at = joined(self.vocabulary, ids)
        first = (raw & 0xC0) != 0x80
        character = np.concatenate([np.cumsum(first) - 1, [0]])
        base = np.repeat(character[at[bounds[:-1]]], np.diff(bounds))
        return character[at[:-1]] - base, character[at[1:] - 1] + 1 - base, ~first[at[:-1]]


def joined(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of table at ids as one run of bytes, and where each begins and ends."""
    if ids.size and (ids.min() < 0 or ids.max() >= len(table)):
        raise ValueError("an id outside the vocabulary")
    taken = table.take(pa.array(ids))
    if taken.null_count:
        raise ValueError("an id outside the vocabulary")
    _, at, raw = taken.buffers()
    at = np.frombuffer(at, np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8))[: at[-1]], at


def parts_of(raw: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    view, cut = memoryview(raw), at[bounds].tolist()
    return [view[a:b] for a, b in zip(cut, cut[1:])]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file, made once in each Python worker."""
    import public_tokenizers

    key = (path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, starts and ends array<int> (character offsets). A null text is encoded as an empty one."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                ids, bounds = c.ids_of([t or "" for t in part.column("text").to_pylist()])
                starts, ends, _ = c.offsets(ids, bounds)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes binary for rows (doc_id, ids array<int>); null ids give empty bytes, an id outside the vocabulary is an error."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            lists = [np.array(ids or (), np.int32) for ids in batch.column("ids").to_pylist()]
            bounds = np.cumsum([0, *map(len, lists)])
            found = [bytes(part) for part in c.decode(np.concatenate([np.empty(0, np.int32), *lists]), bounds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """Encode, decode what was encoded, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256; with offsets also n_split, the tokens that start inside a character.

    Null texts count as empty; null and repeated doc_ids are ordinary rows; other columns are ignored. A batch is cut into
    slices, so memory is bounded by SLICE texts or one very long one.
    """

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                ids, bounds = c.ids_of([t or "" for t in part.column("text").to_pylist()])
                decimal = [hashlib.sha256(x[:-1]).hexdigest() for x in parts_of(*joined(c.decimal, ids), bounds)]
                decoded = [hashlib.sha256(x).hexdigest() for x in c.decode(ids, bounds)]
                columns = [pa.array(np.diff(bounds), pa.int64()), pa.array(decimal, pa.string()), pa.array(decoded, pa.string())]
                if offsets:
                    inside = c.offsets(ids, bounds)[2]
                    columns.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(inside)])[bounds]), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", n_split long" * offsets
    names = [field.split()[0] for field in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), offsets=True)
