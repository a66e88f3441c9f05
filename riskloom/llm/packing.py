"""First-fit decreasing packing of documents into token sequences.

Texts become ids where they are read; only counts and checksums travel further.
A document's full sequences stand alone, its last part is packed: documents
are dealt into random groups by a hash of their id, and each group packs its
parts from the longest down, each into the first sequence with room, found in a
tournament tree of free room. Groups have a few thousand documents whatever the
corpus, so they never meet in one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts
from .tokens import Encoder, encoder


class Room:
    """Tournament tree over sequences: each inner node holds the larger free room of its two children."""

    def __init__(self, most: int, size: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [size] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, free room before) of the first sequence with room for length, which is then taken."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            at += tree[at] < length
        free = tree[at]
        tree[at] = free - length
        sequence, at = at - self.leaves, at // 2
        while at:
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
            at //= 2
        return sequence, free


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, in the order given, which must not rise."""
    room = Room(len(lengths), size)
    return [(sequence, size - free) for sequence, free in map(room.place, lengths)]


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, doc_tokens, crcs): the checksum of each full sequence of the document's ids, then that of the rest if there is one."""

    def row(state: Encoder, text: str) -> tuple[int, list[int]]:
        ids = b"".join(state.pieces(text)) + end_id.to_bytes(4, "little")
        return len(ids) // 4, [zlib.crc32(ids[k : k + 4 * size]) for k in range(0, len(ids), 4 * size)]

    setup = lambda: encoder(tokenizer, lambda ids: struct.pack(f"<{len(ids)}I", *ids), "bytes")
    return map_texts(id_and_text(docs, id_col, text_col), row, "doc_tokens long, crcs array<long>", [pa.int64(), pa.list_(pa.int64())], setup)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, group_documents: int = 4096, seed: int = 11) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Each document is its ids without special tokens added, then end_id. Each id
    lies in one piece; pieces of a sequence stand gapless from offset 0. Null
    text: empty, so the piece is end_id alone. Repeated rows and null ids are
    documents of their own; other columns are not read; an empty table returns
    no piece. A group that holds far more rows than planned (one id repeated over
    and over) is packed in parts, so memory stays bounded.
    """
    groups = max(1, -(-docs.count() // group_documents))
    group = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "doc_tokens"), F.lit(groups))
    dealt = encoded(docs, tokenizer, id_col, text_col, size, end_id).select(group.alias("grp"), (F.col("doc_tokens") % size).alias("rest"), "doc_id", "doc_tokens", "crcs")
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", F.desc("rest"), "doc_id")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(grp: int, first: int, rows: list[tuple]) -> tuple[pa.RecordBatch, int]:
        spots, out = first_fit_decreasing([r[0] for r in rows if r[0]], size), []
        used = first + max((s for s, _ in spots), default=-1) + 1
        for k, (rest, doc_id, tokens, crcs) in enumerate(rows):
            for n, crc in enumerate(crcs[: tokens // size]):
                out.append((doc_id, n * size, size, crc, tokens, (grp << 32) + used, 0))
                used += 1
            if rest:
                sequence, offset = spots[k]
                out.append((doc_id, tokens - rest, rest, crcs[-1], tokens, (grp << 32) + first + sequence, offset))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names), used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, rows = None, 0, []
        for batch in batches:
            for grp, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if rows and (grp != now or len(rows) >= 4 * group_documents):
                    out, used = packed(now, first, rows)
                    yield out
                    rows, first = [], used if grp == now else 0
                now = grp
                rows.append(row)
        if rows:
            yield packed(now, first, rows)[0]

    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))
