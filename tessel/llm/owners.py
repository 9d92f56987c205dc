"""Global questions that blocks of documents ask owners of key ranges, in packed form.

A block is some megabytes of whole documents; how many there are follows from the measured size of the table. Each block
puts its distinct keys, sorted, into one binary value for each owner, and the owner of a key range answers with bits in the
same order. So a key that a third of all documents hold costs one entry for each block, and nothing is gathered on the
driver or broadcast. A block derives its keys anew when the answer comes: all functions are pure, so a lost executor's
blocks are simply run again.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a block, and what an owner should get from all blocks together.
BLOCK_BYTES = 4 << 20
ASK = "block int, owner int, keys binary"
ANSWER = "block int, owner int, bits binary"
_codec = pa.Codec("zstd", 3)


def blocks_of(docs: DataFrame, block_bytes: int, *keep: str) -> tuple[DataFrame, int]:
    """(block, doc_id, text, tie, keep), and the number of blocks, from the measured size of all texts.

    Documents are dealt by doc_id and a hash of the text (tie), so rows that share a doc_id, or have none, spread too.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("n")).first().n or 0
    n = max(1, -(-size // block_bytes))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), *keep)
    return rows.select(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)).cast("int").alias("block"), *rows.columns), n


def squeezed(data: bytes) -> bytes:
    """Compressed, with the size in front."""
    return len(data).to_bytes(8, "little") + _codec.compress(data, asbytes=True)


def spread(data: bytes) -> bytes:
    return _codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers: width and least, then the rest above it, byte plane after byte plane, in as few as the largest needs."""
    x = x.astype(np.uint64, copy=False)
    least = x.min() if len(x) else np.uint64(0)
    x = x - least
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    rows = np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + int(least).to_bytes(8, "little") + rows.tobytes()


def from_planes(b: bytes) -> np.ndarray:
    rows = np.frombuffer(b, dtype=np.uint8, offset=9).reshape(b[0], -1)
    out = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    out[:, : b[0]] = rows.T
    return out.view("<u8").reshape(-1) + np.uint64(int.from_bytes(b[1:9], "little"))


def bundle(*parts: bytes) -> bytes:
    """Several byte strings as one, compressed."""
    return squeezed(len(parts).to_bytes(4, "little") + b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts))


def unbundle(data: bytes) -> list[bytes]:
    data = spread(data)
    n = int.from_bytes(data[:4], "little")
    out, at = [], 4 + 8 * n
    for i in range(n):
        size = int.from_bytes(data[4 + 8 * i : 12 + 8 * i], "little")
        out.append(data[at : at + size])
        at += size
    return out


def cuts(keys: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's range of sorted keys starts; a last entry for the end."""
    owner = owner_of(keys, owners)
    return np.searchsorted(owner, np.arange(owners + 1))


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners divide the range of 64-bit keys evenly."""
    edges = np.array([(i << 64) // owners for i in range(1, owners)], dtype=np.uint64)
    return np.searchsorted(edges, keys, side="right")


def ask(block: int, owners: int, keys: np.ndarray) -> pa.Table:
    """keys: sorted and distinct."""
    at = cuts(keys, owners)
    own = np.flatnonzero(np.diff(at))
    return pa.table({
        "block": pa.array([block] * len(own), pa.int32()), "owner": pa.array(own, pa.int32()),
        "keys": pa.array([keys[at[i] : at[i + 1]].astype("<u8", copy=False).tobytes() for i in own], pa.binary()),
    })


def shared(asked: DataFrame, many: int) -> DataFrame:
    """For each key of each block two runs of bits: whether another block has it too, and whether more than `many` blocks have it."""

    def answer(t: pa.Table) -> pa.Table:
        blobs = t.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(blobs), dtype="<u8")
        order = np.argsort(keys)
        sorted_keys = keys[order]
        head = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        group = np.cumsum(head) - 1
        holders = np.empty(len(keys), dtype=np.int64)
        holders[order] = np.bincount(group)[group]
        at = np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])])
        bits = [np.packbits(holders[i:j] > 1).tobytes() + np.packbits(holders[i:j] > many).tobytes() for i, j in zip(at, at[1:], strict=False)]
        return pa.table({"block": t.column("block"), "owner": t.column("owner"), "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("owner").applyInArrow(answer, ANSWER)


def told(keys: np.ndarray, owners: int, answered: pa.Table) -> np.ndarray:
    """A row for each of the two runs of bits, for a block's sorted keys."""
    at, out = cuts(keys, owners), np.zeros((2, len(keys)), dtype=bool)
    for owner, bits in zip(answered.column("owner").to_pylist(), answered.column("bits").to_pylist(), strict=True):
        both = np.frombuffer(bits, dtype=np.uint8).reshape(2, -1)
        for k in range(2):
            out[k, at[owner] : at[owner + 1]] = np.unpackbits(both[k], count=at[owner + 1] - at[owner]).astype(bool)
    return out


def only(table: pa.Table, step: int) -> pa.Table:
    """Of answers to several questions, those to one."""
    return table.filter(pc.equal(table.column("step"), step)) if table.num_rows else table


def with_answers(blocks: DataFrame, answered: list[DataFrame], f: Callable[[int, pa.Table, list[pa.Table]], pa.Table], schema) -> DataFrame:
    """f(block, its documents, its answers to each question) for each block with documents. answered: may be empty."""
    if not answered:
        return blocks.groupBy("block").applyInArrow(lambda t: f(t.column("block")[0].as_py(), t, []), schema)
    n = len(answered)
    both = None
    for i, a in enumerate(answered):
        a = a.withColumn("step", F.lit(i))
        both = a if both is None else both.unionByName(a)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return f(key[0].as_py(), left, [only(right, i) for i in range(n)])

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema)


def doc_ranks(ids: pa.Array) -> np.ndarray:
    """doc_ids as unsigned numbers of the same order; rows without one come last."""
    rank = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.where(np.asarray(ids.is_null()), np.uint64((1 << 64) - 1), rank)


def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's documents by doc_id (rows without one last), then tie, then text; and for each a pair of numbers of that order: doc_id's and the tie's."""
    t = t.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
    rank = doc_ranks(t.column("doc_id").combine_chunks())
    tie = np.asarray(t.column("tie").combine_chunks()).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return t, np.stack([rank, tie], axis=1)
