"""Best-fit packing planned over a histogram of lengths.

Documents are tokenised and longer ones cut, so a row is a piece of at most `capacity` tokens. The histogram of piece
lengths (at most `capacity` rows whatever the corpus) is all the driver sees. Best-fit decreasing runs over counts: the
items of one length go to the fullest open sequences that they fit, many at once, since sequences with equal room are
alike. The plan says, for a range of ranks within a length, which sequences and which offset they take. Pieces get
their rank within their length from chunked counts (a chunk for each CHUNK pieces of a length, LEAST at least for a length
with many, so a length that a third of all pieces have is ranked in many tasks) and look their slot up in the plan.

Null text counts as empty: a document of the end token alone. Null or repeated ids keep their rows: each is a document of
its own. Ties of length take slots in the order of (chunk, id, piece). Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repeatloom.llm import common, vectext
from repeatloom.llm.bpe import Codec

CAPACITY = 2048
CHUNK, LEAST = 200_000, 64
END, SPECIAL, SPECIAL_ID = 0, "<|endoftext|>", 50256  # fixed values of the public vocabulary


@lru_cache(maxsize=2)
def _codec(ranks: str) -> Codec:
    return Codec(ranks)


def document_ids(texts: list[str | None], codec: Codec) -> Iterator[np.ndarray]:
    """Each document's ids, the vocabulary's special string being one token, and the end token after them."""
    parts = [(t or "").split(SPECIAL) for t in texts]
    flat = [p for one in parts for p in one]
    numbers = iter([len(p) for p in parts])
    held: list[np.ndarray] = []
    need = next(numbers, None)
    for block in vectext.blocks(flat):
        ids, bounds = codec.encode(block)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            held += [np.array([SPECIAL_ID], np.uint32)] * bool(held) + [ids[a:b]]
            need -= 1
            if need == 0:
                yield np.concatenate([*held, np.array([END], np.uint32)])
                held, need = [], next(numbers, None)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones of capacity, but for the first, which takes the rest."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(df: DataFrame, ranks: str, capacity: int = CAPACITY, text: str = "text", id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for k, ids in enumerate(document_ids(texts, codec)):
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length].astype("<u4", copy=False)
                    rows.append((k, piece, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        kept.append(part)
            cols = list(zip(*rows)) if rows else [[]] * 5
            out = [keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = df.schema[id].dataType.simpleString()
    return df.select(df[id], df[text]).mapInArrow(common.tidy(run), f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, number, first sequence, offset), and the number of sequences. Best-fit decreasing over counts."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # open sequences by room left, as (first, number)
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, number: int, space: int, each: int) -> None:
            """The next items go to number sequences, each of them taking that many."""
            nonlocal rank, left
            for k in range(each):
                rows.append((length, rank, number, first, capacity - space + k * length))
                rank, left = rank + number, left - number
            if space - each * length:
                room[space - each * length].append((first, number))

        for space in range(length, capacity + 1):
            each = space // length
            while left and room[space]:
                first, number = room[space].pop()
                whole = min(number, left // each)
                if whole:
                    fill(first, whole, space, each)
                if whole < number:
                    rest = left  # fewer than each, when sequences are left over
                    if rest:
                        fill(first + whole, 1, space, rest)
                        whole += 1
                    if whole < number:
                        room[space].append((first + whole, number - whole))
            if not left:
                break
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            if whole:
                fill(opened, whole, capacity, each)
                opened += whole
            if rest:
                fill(opened, 1, capacity, rest)
                opened += 1
    return rows, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; pieces(id, piece, length, ...) must be stable when read again (a written table)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(histogram, capacity)
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    span = max(1, int(table[:, 1:3].sum(axis=1).max())) if len(table) else 1
    keys = table[:, 0].astype(object) * span + table[:, 1].astype(object)
    keys = np.array(keys, np.int64)  # length, then first rank

    # chunks of each length: their number follows the counts; lengths with few pieces are one chunk
    number = [max(-(-histogram.get(n, 0) // CHUNK), LEAST if histogram.get(n, 0) > 10 * LEAST else 1) for n in range(capacity + 1)]
    chunk_of = F.element_at(F.lit(number), F.col("length").cast("int") + 1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece"), chunk_of).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    chunks = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(F.col("id").asc_nulls_first(), "piece", "start")
    # the chunk table has a row for CHUNK pieces and a few thousand more; its measured size decides how it is joined
    ranked = salted.withColumn("_within", F.row_number().over(within) - 1).join(chunks, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within"))
    given = list(pieces.columns)
    names = [*given, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            slot = table[at]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in given], pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "_rank").mapInArrow(common.tidy(run), schema)


def pack_documents(docs: DataFrame, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(common.materialise(tokenise(docs, ranks, capacity), "pack-pieces"), capacity).withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
