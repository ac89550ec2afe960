"""Media columns: content-defined chunks, deduplicated by digest, that rebuild verified media."""

from __future__ import annotations

import bz2
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.llm.common import _CLEANUP, delete, hot_keys, read, settled, stored, work_dir

#: Payloads are padded with spaces to a positive multiple of this.
FRAME = 192
#: Chunk sizes in bytes: none below LEAST but a last one, about MEAN (a power of two) beyond it, none above MOST.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Bytes of a WAVE file before its samples. They hold lengths, so they are a chunk of their own.
HEADER = 44
RATE = 8000
#: A dictionary for compressing chunks is trained on the chunks of so many rows, on at most so many chunks (at least LEARN_LEAST, or there
#: is none), to at most so many bytes.
LEARN_ROWS, LEARN_CHUNKS, LEARN_LEAST, WORDS = 3000, 8000, 500, 112_640
#: Level of compression; chunks from this length on are also tried with bz2.
LEVEL, LONG = 15, 1536
#: Media are read back in so many parts, one after the other, so that only a part of the chunks lies beside their table at once.
PARTS = 2
#: The gear table: 256 numbers drawn from a fixed seed.
GEAR = np.random.RandomState(20_240_229).randint(0, 2**63, size=256, dtype=np.int64).astype(np.uint64)


def wave(payload: bytes) -> bytes:
    """A mono WAVE file whose unsigned 8-bit samples are the payload."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAVE file as ``wave`` writes it."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or struct.unpack("<I", media[40:44])[0] != len(media) - HEADER:
        raise ValueError("not a WAVE file of this store")
    return media[HEADER:]


def cuts(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks. The gear hash at a byte is the sum of GEAR[byte] << age over the last 64 bytes; a chunk ends where its top
    bits are zero, so where it ends depends on the bytes before the end only and an edit moves few ends."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    bits = mean.bit_length() - 1
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):  # doubling: the sum over 2k bytes from two sums over k
        h[k:] += h[:-k] << np.uint64(k)
    ends = (np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1).tolist()
    out, start = [], 0
    for e in [*ends, n]:
        while e - start > most:
            start += most
            out.append(start)
        if e - start >= least or e == n and e > start:
            out.append(e)
            start = e
    return out


def feature(payload: bytes) -> str:
    """Mean, root mean square about 128, zero crossings and byte entropy of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    c = np.bincount(x, minlength=256)
    p = c[c > 0] / len(x)
    side = x >= 128
    return f"mean={x.sum() / len(x):.4f};rms={float(np.sqrt(((x - 128) ** 2).sum() / len(x))):.4f};crossings={int((side[1:] != side[:-1]).sum())};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def listed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, media (digest of the text's media), n_bytes, chunks (digests in order); no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                names, sizes, lists = [], [], []
                for s in part.column(1).to_pylist():
                    raw, media, pieces = split(s)
                    names.append(digest(media))
                    sizes.append(len(raw))
                    lists.append([digest(p) for p in pieces])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.array(lists, type=pa.list_(pa.binary()))], names=["doc_id", "media", "n_bytes", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary, n_bytes long, chunks array<binary>")


def split(text: str | None) -> tuple[bytes, bytes, list[bytes]]:
    """A text's bytes, its media and the media's chunks."""
    raw = (text or "").encode()
    media = wave(raw + b" " * (-len(raw) % FRAME if raw else FRAME))
    ends = [HEADER, *(HEADER + e for e in cuts(media[HEADER:]))]
    return raw, media, [media[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def digest(piece: bytes) -> bytes:
    """The first 128 bits of the SHA-256 of a chunk or a medium: its key in all tables. The whole hash of a medium is checked on reading."""
    return hashlib.sha256(piece).digest()[:16]


def packed(piece: bytes, coder: zstandard.ZstdCompressor | None = None) -> bytes:
    """The shortest of a raw deflate stream after a D, or a frame of ``coder`` after a Z if there is one, and, for longer chunks, a bz2 stream."""
    out = b"Z" + coder.compress(piece) if coder else b"D" + zlib.compress(piece, 9, -15)
    return min(out, bz2.compress(piece, 1), key=len) if len(piece) >= LONG else out


def unpacked(data: bytes, coder: zstandard.ZstdDecompressor | None = None) -> bytes:
    if data[:1] == b"Z":
        return coder.decompress(data[1:], max_output_size=MOST)
    return zlib.decompress(data[1:], -15) if data[:1] == b"D" else bz2.decompress(data)


def learnt(docs: DataFrame) -> bytes:
    """A compression dictionary: from the chunks with least digests of LEARN_ROWS rows, those with least hashes of doc_id; b'' if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {digest(p): p for s in batch.column(0).to_pylist() for p in split(s)[2][1:]}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), type=pa.binary()), pa.array(list(rows.values()), type=pa.binary())], names=["digest", "data"])

    order = F.xxhash64("doc_id", F.lit("learn"))
    least = docs.select(order.alias("x")).orderBy("x").limit(LEARN_ROWS).agg(F.max("x")).first()[0]
    some = docs.filter(order <= F.lit(least)).select("text").limit(LEARN_ROWS)
    rows = some.mapInArrow(run, "digest binary, data binary").dropDuplicates(["digest"]).orderBy("digest").limit(LEARN_CHUNKS).collect()
    return zstandard.train_dictionary(WORDS, [bytes(r[1]) for r in rows]).as_bytes() if len(rows) >= LEARN_LEAST else b""


def chunks(docs: DataFrame, words: bytes = b"") -> DataFrame:
    """(text) -> (digest, data), data compressed with the dictionary ``words``; a task sends a digest once as long as it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False) if words else None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                names, data = [], []
                for s in batch.column(0).slice(k, 256).to_pylist():
                    for piece in split(s)[2]:
                        if (d := digest(piece)) not in seen:
                            seen.add(d)
                            names.append(d)
                            data.append(packed(piece, coder))
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.binary()), pa.array(data, type=pa.binary())], names=["digest", "data"])

    return docs.select("text").mapInArrow(run, "digest binary, data binary")


def rebuilt(lists: DataFrame, words: bytes = b"") -> DataFrame:
    """(media, chunks: array of (place, digest, data)) -> what is read back, after each chunk and the whole are verified."""
    kinds = {"media": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.binary(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.binary(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for name, parts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    pieces = []
                    for c in sorted(parts, key=lambda c: c["place"]):
                        pieces.append(unpacked(c["data"], coder))
                        if digest(pieces[-1]) != c["digest"]:
                            raise ValueError("a stored chunk doesn't have its digest")
                    media = b"".join(pieces)
                    whole = hashlib.sha256(media).digest()
                    if whole[:16] != name:
                        raise ValueError("the chunks of a list don't give its media")
                    payload = samples(media)
                    rows.append((name, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(media), whole, feature(payload)))
                cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    return lists.mapInArrow(run, "media binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stores the media of (doc_id, text): the chunk lists of all rows, and the table of chunks, each digest once.

    The first pass over the texts writes lists of digests; the second sends each new chunk to the task of its digest, which
    writes it once into a table bucketed by digest, so that reading media joins lists to chunks without moving the table. The
    dictionary that chunks are compressed with is a file under its digest, which the lists name (``words``; empty: none).
    """
    spark = docs.sparkSession
    words = learnt(docs)
    name = digest(words) if words else b""
    if words:
        spark.createDataFrame([(words,)], "words binary").coalesce(1).write.mode("overwrite").parquet(_words_path(spark, name))
    lists, _ = stored(listed(docs).withColumn("words", F.lit(name)), "chunk-lists")
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"chunks_{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        first = F.row_number().over(Window.partitionBy("digest").orderBy("digest"))
        rows = chunks(docs, words).repartition(n, "digest").withColumn("_n", first).filter("_n = 1").drop("_n")
        rows.write.option("path", f"{work_dir(spark)}/{table}").option("compression", "uncompressed").bucketBy(n, "digest").saveAsTable(table)
    finally:
        spark.conf.set(_CLEANUP, before)
    return lists, spark.table(table).alias(table)


def drop(table: DataFrame) -> None:
    """Deletes the chunks that ``store`` has written; the lists are a table in the work folder."""
    name = table._jdf.queryExecution().analyzed().identifier().name()
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    delete(table.sparkSession, f"{work_dir(table.sparkSession)}/{name}")


def _words_path(spark: SparkSession, name: bytes) -> str:
    return f"{work_dir(spark)}/chunk-words-{bytes(name).hex()}"


def load(lists: DataFrame, table: DataFrame) -> DataFrame:
    """What each distinct medium reads back as, stored.

    Lists are made distinct by medium first, so copies cost nothing. Chunks that over a thousandth of all references name are fewer
    than a thousand; with at most MOST bytes each, they are broadcast. All others are joined by digest. Media are dealt by hash into PARTS
    parts, and the shuffled chunks of one are deleted before the next is read.
    """
    spark = lists.sparkSession
    name = lists.select("words").first()
    words = bytes(spark.read.parquet(_words_path(spark, name[0])).first()[0]) if name and name[0] else b""

    def part(refs: DataFrame, hot: DataFrame) -> DataFrame:
        cold = refs.join(F.broadcast(hot), "digest", "left_anti").join(table.hint("merge"), "digest")
        warm = refs.join(F.broadcast(table.join(F.broadcast(hot), "digest")), "digest")
        rows = cold.select("media", "place", "digest", "data").unionByName(warm.select("media", "place", "digest", "data"))
        # one binary a chunk moves: its place in four bytes, digest and data
        one = F.concat(F.unhex(F.lpad(F.hex(F.col("place").cast("long")), 8, "0")), "digest", "data")
        chunk = lambda b: F.struct(F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("int").alias("place"), F.substring(b, 5, 16).alias("digest"), b.substr(F.lit(21), F.length(b)).alias("data"))
        lists_ = rows.groupBy("media").agg(F.collect_list(one).alias("chunks"))
        return rebuilt(lists_.select("media", F.transform("chunks", chunk).alias("chunks")), words)

    def make() -> DataFrame:
        refs = lists.groupBy("media").agg(F.first("chunks").alias("chunks")).select("media", F.posexplode("chunks").alias("place", "digest"))
        refs, _ = stored(refs, "references")
        hot = hot_keys(refs, "digest").select("digest")
        which = F.pmod(F.xxhash64("media"), F.lit(PARTS))
        return reduce(DataFrame.unionByName, [stored(part(refs.filter(which == k), hot), "media-part")[0] for k in range(PARTS)])

    return settled(spark, make, "media")


def op1_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text of ``documents`` as a WAVE file in chunks, reads all back and returns a digest row per document.

    Null text: as empty, 192 spaces. Rows with equal texts have one medium. Null or repeated ids: a row each. Empty table: empty result.
    Other columns don't matter. The store of the query is deleted once its result is written.
    """

    def make() -> DataFrame:
        lists, table = store(read(spark, sf_dir, "documents"))
        media = load(lists, table)
        drop(table)
        return lists.select("doc_id", "media", "n_bytes").join(media, "media").select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_sha256")).alias("payload_sha256"), "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")

    return settled(spark, make, "digests")
