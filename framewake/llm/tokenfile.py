"""Token-id files: one concatenated id array with Elias-Fano coded document boundaries and document ids.

A file image holds: a header, the ids (two bytes each where the vocabulary allows it), the boundaries, and the ids of
the documents. A monotone sequence of n numbers up to u takes n * (2 + log2(u / n)) bits: each number's low bits packed,
its high bits as ones in a bit vector at place high + index. select(i) finds the i-th one from a sample of every 256th
place and bit counts of the bytes between, so a document's offsets are read without a table of 64-bit numbers.

Documents are sorted by doc_id (nulls first, ties by text digest) over a range partitioning; each task cuts its run into images
of bounded size. Images are rows of a table in the shared folder, so Spark's commit protocol covers lost executors and
any store that Spark writes to holds them. Null and empty texts are the end id alone. An empty table gives no images.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import BLOCK_BYTES, encoder_for, tidy, vocabulary, with_end
from .common import blocks, shared_dir

MAGIC = b"FWIDS1\0\0"
SAMPLE = 256
#: Ids in an image, unless one document alone has more.
IMAGE_IDS = 1 << 19
_COUNT = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)


class EliasFano:
    """A monotone sequence of whole numbers >= 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = ((values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)) if n else np.zeros(0, np.int64)
        high = np.zeros((int(places[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(high, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
        if low_bits and n:
            bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, low_bits, low, high, places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th number."""
        at = int(self.sample[i // SAMPLE])
        rest = i % SAMPLE
        byte = at >> 3
        head = int(self.high[byte]) >> (at & 7) << (at & 7)
        if rest >= int(_COUNT[head]):
            rest -= int(_COUNT[head])
            byte += 1
            while True:
                counts = np.cumsum(_COUNT[self.high[byte : byte + 64]])
                k = int(np.searchsorted(counts, rest, "right"))
                if k < len(counts):
                    rest -= int(counts[k - 1]) if k else 0
                    byte += k
                    break
                rest -= int(counts[-1])
                byte += 64
            head = int(self.high[byte])
        for _ in range(rest):
            head &= head - 1
        place = byte * 8 + (head & -head).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        word = int.from_bytes(self.low[a >> 3 : (a + self.low_bits + 7) >> 3].tobytes(), "little")
        return word >> (a & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number, in order."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def dump(self) -> bytes:
        return struct.pack("<QBxxxIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.sample)) + self.low.tobytes() + self.high.tobytes() + self.sample.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: memoryview) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QBxxxIII", data)
        at = struct.calcsize("<QBxxxIII")
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c


def write_image(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """ids of documents one after another, each document's number of ids, and the document ids in ascending order (nulls first)."""
    nulls = sum(x is None for x in doc_ids)
    numbers = np.array([x for x in doc_ids if x is not None], np.int64)
    base = int(numbers[0]) if len(numbers) else 0
    wide = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    body = b"".join([
        struct.pack("<BxxxIQq", wide, nulls, len(ids), base),
        EliasFano.of(np.cumsum(lengths)).dump(),
        EliasFano.of((numbers - base).view(np.uint64) if len(numbers) else numbers).dump(),
        ids.astype(f"<u{wide}").tobytes(),
    ])
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class TokenFile:
    """An image read back."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("no token-id file")
        body = memoryview(image)[12:]
        if zlib.crc32(body) != struct.unpack_from("<I", image, 8)[0]:
            raise ValueError("damaged token-id file")
        wide, self.nulls, n, self.base = struct.unpack_from("<BxxxIQq", body)
        at = struct.calcsize("<BxxxIQq")
        self.ends, used = EliasFano.load(body[at:])
        at += used
        self._docs, used = EliasFano.load(body[at:])
        self.ids = np.frombuffer(body, f"<u{wide}", n, at + used)

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by select."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self._docs.all().view(np.int64) + self.base).tolist()


def write_token_files(docs: DataFrame, path: str, vocab: str = "word_bpe_49k.json", end_id: int = 2, image_ids: int = IMAGE_IDS) -> None:
    """Images of all documents in ascending doc_id order as rows (part, seq, n_docs, n_ids, image) of a table at path."""

    def run(batches):
        encoder, part, seq = encoder_for(vocabulary(vocab)), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        lengths: list[int] = []
        names: list[int | None] = []
        size = 0

        def image():
            nonlocal held, lengths, names, size, seq
            data = write_image(np.concatenate(held), np.array(lengths), names)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_ids", "image"])
            held, lengths, names, size, seq = [], [], [], 0, seq + 1
            return out

        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            flat, each = with_end(*encoder.encode(block.column("text")), end_id)
            for doc, n, to in zip(block.column("doc_id").to_pylist(), each.tolist(), np.cumsum(each).tolist(), strict=True):
                if size and size + n > image_ids:
                    yield image()
                held.append(flat[to - n : to])
                lengths.append(n)
                names.append(doc)
                size += n
        if size:
            yield image()
        tidy()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(run, "part int, seq int, n_docs long, n_ids long, image binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the images alone."""
    images = spark.read.parquet(path)
    # two running sums: over parts (as many rows as partitions were written), and over the images of each part
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("seq")
    starts = images.select("part", "seq", "n_ids").withColumn("inside", F.sum("n_ids").over(within) - F.col("n_ids")).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches):
        for batch in batches:
            for image, base in zip(batch.column("image"), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(image.as_py())
                ends, crc, at = [], [], 0
                for i in range(len(file)):  # select gives each boundary; no table of offsets is decoded
                    to = file.ends.select(i)
                    ends.append(to)
                    crc.append(zlib.crc32(file.ids[at:to].astype("<u4")))
                    at = to
                ends = np.array(ends, np.int64)
                begins = np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids(), pa.int64()), pa.array(begins + base), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # an image is read where it lies; only its number of ids was moved
    return images.select("part", "seq", "image").join(F.broadcast(starts) if _few(images) else starts, ["part", "seq"]).select("image", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _few(images: DataFrame, most: int = 1_000_000) -> bool:
    """Whether the numbers of all images (24 bytes each) may be broadcast."""
    return images.count() <= most


def token_files(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 2, image_ids: int = IMAGE_IDS) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark, "ids")
    write_token_files(docs, path, vocab, end_id, image_ids)
    return read_token_files(spark, path)
