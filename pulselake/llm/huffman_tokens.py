"""Token ids in files, Huffman-coded, in ascending order of document id.

Ids of all documents are counted first. From the counts comes one length-limited code (package-merge), made canonical, so
that the lengths alone describe it. A file holds the documents of a range of ids: a JSON header, the code lengths, ids and
sizes of the documents, the bit offset of every block of ``BLOCK`` ids, and the bits. Blocks can be decoded apart; a
file's blocks are decoded side by side, each step looking up the next bits of all of them in one table.

Files are written by tasks under unique names into the shared folder, whole and then renamed; only those that the manifest
of the finished job lists are read, so a repeated task does no harm. A file holds ``FILE_IDS`` ids at most unless one
document is larger. Null texts are empty and, like all others, get the end id. Rows with a null id come first; rows that share
an id come by size and content.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.byte_bpe import SLICE_CHARS, Encoder, supported
from pulselake.llm.common import Kept, held, slices, table, written
from pulselake.session import shared_folder

END_ID = 2
BLOCK = 512
FILE_IDS = 4_000_000
TABLE_BITS = 18
MAGIC = b"HUFTOK01"


WORDS_A_TEXT = 50


def library_encoder(path: str) -> tuple[Encoder, int]:
    """Ids as the tokenizers library gives them, which encodes each word once; and the size of the vocabulary.

    The library gets words joined by a special token, at which it cuts a text itself: an object for each word would cost
    more than encoding it.
    """
    from tokenizers import Tokenizer

    def make() -> tuple[Encoder, int]:
        supported(path)
        tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        between, end = next(((t, i) for t, i in special.items()), ("", -1))
        step = WORDS_A_TEXT if between else 1

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            texts = [between.join(words[i : i + step]) + between for i in range(0, len(words), step)]
            lists = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            if not between:
                return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
            ids = np.concatenate(lists)
            return ids[ids != end], np.diff(np.flatnonzero(ids == end), prepend=-1) - 1

        return Encoder(special, encode), tokenizer.get_vocab_size(with_added_tokens=True)

    return held(("library", path), make)


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids): the ids of every row of (doc_id, text) with the end id, as little-endian bytes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        coder, size = library_encoder(path)
        kind = width(max(size, end_id + 1))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                ids, sizes = coder.encode(texts[a:b])
                ends = np.cumsum(sizes)
                closed = np.insert(ids, ends, end_id).astype(kind)
                raw = closed.tobytes()
                item = closed.itemsize
                offsets = pa.array(np.append(0, ends + np.arange(1, b - a + 1)) * item, pa.int64())
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, offsets.buffers()[1], pa.py_buffer(raw)])
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(sizes + 1, pa.int64()), data.cast(pa.binary())], names=["doc_id", "n", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n bigint, ids binary")


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The values of all binaries of a column, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def global_counts(coded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; a row for each id comes to the driver."""
    kind = width(vocabulary)

    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            counts += np.bincount(_flat(batch.column(0), kind), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["id", "count"])

    totals = np.zeros(vocabulary, np.int64)
    for i, n in coded.select("ids").mapInArrow(run, "id bigint, count bigint").groupBy("id").agg(F.sum("count")).collect():
        totals[i] = n
    return totals


def code_lengths(counts: np.ndarray, limit: int = TABLE_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (more if there are too many ids), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    leaves, merged = [], weights
    for level in range(limit):
        if level:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, pairs])
            order = np.argsort(both, kind="stable")
            merged = both[order]
            leaves.append(order < len(weights))
        else:
            leaves.append(np.ones(len(weights), bool))
    take = 2 * len(used) - 2
    depth = np.zeros(len(used), np.int64)
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[used] = depth
    return lengths


class Code:
    """The canonical code of the lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = int(lengths.max()) if len(lengths) else 0
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.int64(1) << (self.bits - lengths[order].astype(np.int64))
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = first >> (self.bits - lengths[order].astype(np.int64))
        self.symbols = np.zeros(1 << self.bits, np.int32)
        self.steps = np.ones(1 << self.bits, np.uint8)  # bits that no code begins with are in no file
        filled = np.repeat(order, span)
        self.symbols[: len(filled)], self.steps[: len(filled)] = filled, lengths[filled]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every block."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        word, shift = begins >> 5, 64 - (begins & 31) - sizes
        value = self.codes[ids].astype(np.uint64) << shift.astype(np.uint64)  # of 64 bits from the word on
        words = np.zeros((int(ends[-1]) >> 5) + 3 if len(ends) else 3, np.uint64)
        if len(ids):
            new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            total = np.add.reduceat(value >> np.uint64(32), new)
            words[word[new]] += total
            words[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
        return words.astype(">u4").tobytes(), begins[::BLOCK].astype("<u8")

    def decode(self, data: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
        """``total`` ids from bytes and block offsets: all blocks side by side, one id of each in a step."""
        count = len(offsets)
        out = np.zeros((BLOCK, count), np.int32)
        at = offsets.astype(np.int64)
        last = total - BLOCK * (count - 1)
        drop = np.uint32(32 - self.bits)
        for k in range(BLOCK if count > 1 else last):
            live = count if k < last else count - 1
            here = at[:live]
            byte = here >> 3
            window = (
                (data[byte].astype(np.uint64) << np.uint64(32))
                | (data[byte + 1].astype(np.uint64) << np.uint64(24))
                | (data[byte + 2].astype(np.uint64) << np.uint64(16))
                | (data[byte + 3].astype(np.uint64) << np.uint64(8))
                | data[byte + 4].astype(np.uint64)
            )
            top = ((window >> (np.uint64(8) - (here & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)).astype(np.uint32) >> drop
            out[k, :live] = self.symbols[top]
            at[:live] += self.steps[top]
        return out.T.ravel()[:total]


def file_bytes(names: list, sizes: np.ndarray, ids: np.ndarray, code: Code) -> bytes:
    bits, offsets = code.encode(ids)
    parts = [zlib.compress(code.lengths.tobytes()), zlib.compress(json.dumps(names).encode()), zlib.compress(sizes.astype("<u8").tobytes()), offsets.tobytes(), bits]
    header = json.dumps({"ids": len(ids), "documents": len(names), "block": BLOCK, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + b"".join(parts)


@lru_cache(maxsize=2)
def _code(packed: bytes) -> Code:
    return Code(np.frombuffer(zlib.decompress(packed), np.uint8))


def read_bytes(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, sizes, token ids) of a file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of coded token ids")
    at = len(MAGIC) + 4
    header = json.loads(data[at : at + int.from_bytes(data[at - 4 : at], "little")])
    at += int.from_bytes(data[at - 4 : at], "little")
    parts = []
    for size in header["parts"]:
        parts.append(data[at : at + size])
        at += size
    offsets = np.frombuffer(parts[3], "<u8")
    ids = _code(parts[0]).decode(np.frombuffer(parts[4], np.uint8), offsets, header["ids"]) if header["ids"] else np.zeros(0, np.int32)
    return json.loads(zlib.decompress(parts[1])), np.frombuffer(zlib.decompress(parts[2]), "<u8").astype(np.int64), ids


def write(coded: DataFrame, vocabulary: int) -> DataFrame:
    """Write (doc_id, n, ids) to files; the manifest (place, part, path, documents, ids, start) of those that count."""
    kind = width(vocabulary)
    code = Kept(coded.sparkSession, code_lengths(global_counts(coded, vocabulary)), Code)
    total = coded.agg(F.sum("n")).first()[0] or 0
    folder = shared_folder(coded.sparkSession, "token-files")
    ordered = coded.repartitionByRange(max(1, -(-total // FILE_IDS)), "doc_id").sortWithinPartitions("doc_id", "n", "ids")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        place, part = TaskContext.get().partitionId(), 0
        names, sizes, raw, held = [], [], [], 0

        def flush():
            path = f"{base}/{place:06d}-{part:04d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(path + ".tmp", compression=None) as out:
                out.write(file_bytes(names, np.array(sizes, np.int64), np.frombuffer(b"".join(raw), kind), code.get()))
            fs.move(path + ".tmp", path)
            return pa.record_batch(
                [pa.array([place], pa.int64()), pa.array([part], pa.int64()), pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64())],
                names=["place", "part", "path", "documents", "ids"],
            )

        for batch in batches:
            for name, n, ids in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["ids"].to_pylist()):
                if names and held + n > FILE_IDS:
                    yield flush()
                    part += 1
                    names, sizes, raw, held = [], [], [], 0
                names.append(name)
                sizes.append(n)
                raw.append(ids)
                held += n
        if names:
            yield flush()

    manifest = written(ordered.mapInArrow(run, "place bigint, part bigint, path string, documents bigint, ids bigint"), "token-manifest")
    before = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    files = manifest.count()

    def run(batches):
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as source:
                    names, sizes, ids = read_bytes(source.read())
                ends = np.cumsum(sizes)
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * ends).tolist()]
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.record_batch(
                    [pa.array(names, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.select("path", "start").repartition(max(1, files))
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    _, vocabulary = library_encoder(path)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    coded = written(encode(docs, path), "token-ids")
    return read(write(coded, max(vocabulary, END_ID + 1)))
