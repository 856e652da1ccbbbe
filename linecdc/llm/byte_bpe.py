"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. *Explode.* Each Arrow batch is cut into blocks of whole texts. The pattern
   splits the texts into words (pre-tokens). A block keeps, per text, the
   positions as a list of numbers into the block's distinct words, and gives off
   the distinct words themselves, dealt into buckets by their hash. Positions and
   words leave in one shuffle of packed rows, read by both steps below; a word that
   a block holds a thousand times is shuffled once.
2. *Encode.* Words are dealt by bucket, so equal words of all blocks meet in one
   task, which merges each distinct word once.
3. *Join back.* The ids go back to their blocks, are joined to the positions, and
   the ids of each text are put together in order of position.
4. *Decode* joins ids with the table of token bytes (the vocabulary, 50,000 rows,
   of a fixed size, sent to every task).

No task holds more than a block, or the distinct words of one bucket. Blocks have
``BLOCK_CHARS`` characters, or one text if that is longer. The input should be a
stored table: a task that is run again must read its rows in the same order.

Nulls and edge cases: a null or empty text has no ids and decodes to the empty
text; repeated rows are encoded each; a null id stays null; special tokens'
strings are ordinary text; extra columns are not looked at; an empty table gives
an empty table. Vocabularies are files in tiktoken's format; the ranks come from
``path``, a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecdc.llm.common import shuffle_parts

BLOCK_CHARS = 4_000_000
STEP_WORDS = 200_000  # words put together at once
# A row of texts has its block as the key, bucket -1, the texts' ids, the number of
# words of each text, the words' ranks, and the bucket of every rank. A row of
# words or of their ids has the bucket or the block as the key.
PACKED = "key string, block string, bucket int, ids array<long>, lens binary, data binary, buckets binary"


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file (under 1 MB). The driver reads it and broadcasts it, so
    executors need no file of their own."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def load_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: start and length of each id, and all bytes."""
    ranks = load_ranks(vocabulary)
    words = [b""] * (max(ranks.values()) + 1)
    for w, i in ranks.items():
        words[i] = w
    lens = np.array([len(w) for w in words], np.int64)
    return np.cumsum(lens) - lens, lens, np.frombuffer(b"".join(words), np.uint8)


def _pack(a: np.ndarray) -> bytes:
    """Compressed planes of bytes, lowest first, as many as the largest value needs."""
    planes = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    raw = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes()
    return len(a).to_bytes(4, "little") + bytes([planes]) + pa.compress(raw, "zstd", asbytes=True) if len(a) else b""


def _unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, np.uint32)
    n, planes = int.from_bytes(b[:4], "little"), b[4]
    raw = np.frombuffer(pa.decompress(b[5:], n * planes, "zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 4), np.uint8)
    out[:, :planes] = raw.reshape(planes, n).T
    return out.view("<u4").ravel()


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    flat = b"".join(words)
    return (_pack(np.fromiter(map(len, words), np.uint32, len(words))),
            len(flat).to_bytes(4, "little") + pa.compress(flat, "zstd", asbytes=True))


def _unpack_words(lens: bytes, data: bytes) -> list[bytes]:
    n = _unpack(lens).tolist()
    flat = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)
    out, at = [], 0
    for k in n:
        out.append(flat[at:at + k])
        at += k
    return out


def _bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, n = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1)):
        ids.append(i.as_py())
        texts.append(t.as_py() or "")
        n += len(texts[-1])
        if n >= size:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    key, block, bucket, ids, lens, data, buckets = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(key, pa.string()), pa.array(block, pa.string()), pa.array(bucket, pa.int32()),
        pa.array(ids, pa.list_(pa.int64())), pa.array(lens, pa.binary()), pa.array(data, pa.binary()),
        pa.array(buckets, pa.binary())], names=["key", "block", "bucket", "ids", "lens", "data", "buckets"])


def explode_words(pattern: str, buckets: int, size: int = BLOCK_CHARS) -> Callable:
    """Per block: one row of texts (positions) and a row of words per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, part, k = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, texts in _blocks(batch, size):
                seen: dict[str, int] = {}
                seq = [np.fromiter((seen.setdefault(w, len(seen)) for w in find(t)), np.uint32) for t in texts]
                flat = np.concatenate(seq)
                # Ranks go from the most frequent word, equal ones by spelling: both pack well.
                count = np.bincount(flat, minlength=len(seen))
                words = list(seen)
                spelling = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
                by_rank = spelling[np.argsort(-count[spelling], kind="stable")]
                rank = np.empty(len(words), np.uint32)
                rank[by_rank] = np.arange(len(words), dtype=np.uint32)
                raw = [words[i].encode() for i in by_rank]
                bucket = np.fromiter((_bucket_of(w, buckets) for w in raw), np.uint32, len(raw))
                block = f"{part}-{k}"
                k += 1
                out = [(block, block, -1, ids, _pack(np.array([len(s) for s in seq], np.uint32)),
                        _pack(rank[flat]), _pack(bucket))]
                order = np.argsort(bucket, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                    lens, data = _pack_words([raw[i] for i in own])
                    b = int(bucket[own[0]])
                    out.append((f"w{b}", block, b, None, lens, data, None))
                yield _rows(out)
    return run


def encode_words(vocabulary, pattern: str) -> Callable:
    """Rows of words become rows of ids: ``lens`` ids per word, ``data`` the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _encoder(vocabulary.value, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}  # the distinct words of this task's buckets
        for batch in batches:
            out = []
            for block, bucket, lens, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "lens", "data"))):
                if bucket < 0:
                    continue
                words = _unpack_words(lens, data)
                for w in words:
                    if w not in known:
                        known[w] = merge(w)
                got = [known[w] for w in words]
                out.append((block, block, bucket, None, _pack(np.fromiter(map(len, got), np.uint32, len(got))),
                            _pack(np.fromiter(chain.from_iterable(got), np.uint32)), None))
            if out:
                yield _rows(out)
    return run


def _gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + count[i]] of all i, one after the other."""
    ends = np.cumsum(count)
    return values[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


def _texts_of_block(key: tuple, texts: pa.Table, words: pa.Table) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(text ids, ids, number of ids per text) in slices of about STEP_WORDS words."""
    if key[0].as_py().startswith("w"):  # words on their way to be encoded
        return
    texts, words = texts.to_pylist(), sorted(words.to_pylist(), key=lambda w: w["bucket"])
    lens = [_unpack(w["lens"]).astype(np.int64) for w in words]
    flat = np.concatenate([_unpack(w["data"]) for w in words]) if words else np.empty(0, np.uint32)
    n = np.concatenate(lens) if lens else np.empty(0, np.int64)
    for t in texts:
        seq, per = _unpack(t["data"]).astype(np.int64), _unpack(t["lens"]).astype(np.int64)
        # The words came by bucket, within it by rank.
        rank = np.argsort(_unpack(t["buckets"]), kind="stable")
        start, count = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        start[rank], count[rank] = np.cumsum(n) - n, n
        ends = np.cumsum(per)
        at = 0
        while at < len(per):
            base = ends[at] - per[at]
            to = max(at + 1, int(np.searchsorted(ends, base + STEP_WORDS, "right")))
            s = seq[base:ends[to - 1]]
            c = count[s]
            total = np.r_[0, np.cumsum(c)]
            inner = np.r_[0, ends[at:to] - base]
            yield t["ids"][at:to], _gather(flat, start[s], c), np.diff(total[inner])
            at = to


def decode_bytes(vocabulary: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, and how many each id has."""
    start, count, flat = token_bytes(vocabulary)
    return _gather(flat, start[ids], count[ids]), count[ids]


def _id_lists(vocabulary) -> Callable:
    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        out_id, out = [], []
        for own, ids, n in _texts_of_block(key, texts, words):
            out_id += own
            out += np.split(ids.astype(np.int32), np.cumsum(n)[:-1])
        return pa.table({"doc_id": pa.array(out_id, pa.int64()), "ids": pa.array(out, pa.list_(pa.int32()))})
    return run


def _digests(vocabulary) -> Callable:
    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for own, ids, n in _texts_of_block(key, texts, words):
            raw, size = decode_bytes(vocabulary.value, ids)
            sizes = np.r_[0, np.cumsum(size)]
            le, ends = ids.astype("<u4").view(np.uint8), np.r_[0, np.cumsum(n)]
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                for col, v in zip(out, (own[i], int(b - a), sha(le[4 * a:4 * b]), sha(raw[sizes[a]:sizes[b]]))):
                    col.append(v)
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()),
                         "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})
    return run


def _encode(docs: DataFrame, path: str, pattern: str, finish: Callable, schema: str,
            buckets: int | None, size: int) -> DataFrame:
    spark = docs.sparkSession
    buckets = buckets or 2 * shuffle_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    packed = rows.mapInArrow(explode_words(pattern, buckets, size), PACKED).repartition("key")
    # Both read the one shuffle: a filter here would go below it and make two.
    words = packed.mapInArrow(encode_words(vocabulary, pattern), PACKED)
    words = words.toDF(*words.columns)
    return packed.groupBy("key").cogroup(words.groupBy("key")).applyInArrow(finish(vocabulary), schema)


def encode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, size: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of (doc_id, text)."""
    return _encode(docs, path, pattern, _id_lists, "doc_id long, ids array<int>", buckets, size)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if r is None else decode_bytes(vocabulary.value, np.asarray(r, np.int64))[0].tobytes().decode("utf-8", "replace")
                   for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, size: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids as little-endian
    unsigned 32-bit integers, and the bytes that the ids decode to."""
    return _encode(docs, path, pattern, _digests,
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", buckets, size)


def op10_query(documents: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return digest(documents, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
