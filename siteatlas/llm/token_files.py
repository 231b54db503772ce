"""Token ids in bit-plane files.

Ids are cut into blocks of a fixed size; a block is transposed into bit or byte planes, plane p holding bit (or byte) p of
every id, and each plane of a chunk is compressed with zstandard.  A chunk holds the blocks of whole documents, up to a
bounded number of ids; a longer document fills chunks of its own.

A written folder holds ``chunks`` (part, chunk, n_ids, planes, and the documents whose ids it holds) and ``index`` (the
first id, ids and bytes of every chunk, in the order of the ids), both Parquet: the planes are compressed already, and
Spark's commit makes a retried task's files count once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteatlas.llm.common import identified, text_mark
from siteatlas.llm.encoding import encoder

# split: 0, or the number (from 1) of the part of one long document that the chunk holds.
CHUNKS = ("part int, chunk long, n_ids long, split int, plane_bits int, planes array<binary>, "
          "doc_ids array<long>, doc_sizes array<long>")


def to_planes(ids: np.ndarray, block_ids: int, plane_bits: int) -> list[bytes]:
    """Planes of all blocks; the last block is filled up with zeros."""
    blocks = np.zeros(-(-max(len(ids), 1) // block_ids) * block_ids, dtype="<u4")
    blocks[:len(ids)] = ids
    wide = max(int(blocks.max()).bit_length(), 1)
    raw = blocks.view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        return [raw[:, p].tobytes() for p in range(-(-wide // 8))]
    bits = [np.packbits(raw[:, p // 8] >> (p % 8) & 1, bitorder="little") for p in range(wide)]
    return [b.tobytes() for b in bits]


def from_planes(planes: list[bytes], n: int, plane_bits: int) -> np.ndarray:
    ids = np.zeros(n, dtype="<u4")
    for p, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if plane_bits == 1:
            raw = np.unpackbits(raw, count=n, bitorder="little")
        ids |= raw[:n].astype("<u4") << (p * plane_bits)
    return ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, plane_bits: int = 8, block_ids: int = 8192,
          chunk_ids: int = 1 << 20, level: int = 3) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write their ids, each document followed by ``end_id``, by ascending doc_id.

    Documents are dealt out by ranges of (doc_id, text mark), so the files of part i hold smaller ids than those of part
    i + 1, and a single id on very many rows is spread as well.

    Null or empty text: the end id alone.  Repeated rows are written each; rows of one id are ordered by the mark of
    their text; null ids come first.  A document longer than ``chunk_ids`` goes over several chunks.  Empty table: both
    folders exist and are empty.  Other columns are left alone.  ``plane_bits`` is 1 or 8.
    """
    if plane_bits not in (1, 8):
        raise ValueError("plane_bits is 1 or 8")
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bulk, press, part = encoder(tokenizer), zstandard.ZstdCompressor(level=level), TaskContext.get().partitionId()
        held, names, sizes, filled, number = [], [], [], 0, 0

        def chunk(ids: np.ndarray, split: int, doc_ids: list, doc_sizes: list) -> pa.RecordBatch:
            planes = [press.compress(p) for p in to_planes(ids, block_ids, plane_bits)]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([split], pa.int32()), pa.array([plane_bits], pa.int32()), pa.array([planes], pa.list_(pa.binary())),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([doc_sizes], pa.list_(pa.int64()))],
                names=[f.split()[0] for f in CHUNKS.split(", ")])

        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            ids, bounds = bulk.encode(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.concatenate([ids[bounds[i]:bounds[i + 1]], end])
                if names and filled + len(own) > chunk_ids:
                    yield chunk(np.concatenate(held), 0, names, sizes)
                    held, names, sizes, filled, number = [], [], [], 0, number + 1
                if len(own) > chunk_ids:
                    for at in range(0, len(own), chunk_ids):
                        some = own[at:at + chunk_ids]
                        yield chunk(some, at // chunk_ids + 1, [doc_id], [len(some)])
                        number += 1
                else:
                    held.append(own)
                    names.append(doc_id)
                    sizes.append(len(own))
                    filled += len(own)
        if names:
            yield chunk(np.concatenate(held), 0, names, sizes)

    ordered = identified(docs).select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
    ordered = ordered.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    (ordered.mapInArrow(run, CHUNKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/chunks"))
    _index(docs.sparkSession, path).write.mode("overwrite").parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    """First id of every chunk: sums over the parts' totals (one small row a part), then over the chunks of a part."""
    bytes_of = F.aggregate("planes", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p))
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select(
        "part", "chunk", "n_ids", bytes_of.alias("n_bytes"))
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))
    parts = parts.select("part", (F.sum("ids_of_part").over(Window.orderBy("part")) - F.col("ids_of_part")).alias("before"))
    inner = Window.partitionBy("part").orderBy("chunk")
    chunks = chunks.withColumn("inside", F.sum("n_ids").over(inner) - F.col("n_ids"))
    return chunks.join(parts, "part").select("part", "chunk", (F.col("before") + F.col("inside")).alias("start"), "n_ids", "n_bytes")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``part, chunk, start, split, doc_id, ids`` back from the files, a row for each document (or part of a split one).

    ``start`` counts the ids before it; ``ids`` are little-endian unsigned 32-bit integers.
    """
    import zstandard

    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    starts = spark.read.parquet(f"{path}/index").select("part", "chunk", "start")
    schema = "part int, chunk long, start long, split int, doc_id long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                c = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids = from_planes([press.decompress(p) for p in c["planes"]], c["n_ids"], c["plane_bits"])
                ends = np.cumsum(c["doc_sizes"])
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array([c["part"]] * n, pa.int32()), pa.array([c["chunk"]] * n, pa.int64()),
                    pa.array(c["start"] + np.concatenate([[0], ends[:-1]]), pa.int64()), pa.array([c["split"]] * n, pa.int32()),
                    pa.array(c["doc_ids"], pa.int64()),
                    pa.array([ids[e - s:e].tobytes() for e, s in zip(ends, c["doc_sizes"], strict=True)], pa.binary())],
                    names=[f.split()[0] for f in schema.split(", ")])

    # Apart, so that who asks for whole documents, or for the parts of split ones, does not unpack the others.
    chunks = chunks.join(starts, ["part", "chunk"])
    whole = chunks.where("split = 0").mapInArrow(run, schema).withColumn("split", F.lit(0))
    return whole.unionByName(chunks.where("split > 0").mapInArrow(run, schema))


def digest(pieces: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document that ``read`` gives back.

    A whole document is digested in its row.  The parts of a split one lie next to each other: they are brought together
    by part and the checksum runs on from one to the next, so only one part is held at a time.
    """
    whole = pieces.where("split = 0").select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out(row: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["split"] > 1:
                    now = [*now[:2], now[2] + row["n"], zlib.crc32(row["ids"], now[3])]
                    continue
                if now:
                    yield out(now)
                now = [row["doc_id"], row["start"], row["n"], zlib.crc32(row["ids"])]
        if now:
            yield out(now)

    split = (pieces.where("split > 0").withColumn("n", (F.octet_length("ids") / 4).cast("long"))
             .repartition("part").sortWithinPartitions("part", "chunk"))
    return whole.unionByName(split.select("doc_id", "start", "n", "split", "ids").mapInArrow(run, schema))
