"""Packing documents into fixed-length sequences along a space-filling curve.

A document is its subword ids and an end id. Its vector counts hashed ids, projected by random signs to ``DIMS``
dimensions and scaled to unit length; the cell of a ``2**BITS`` grid that it falls in gives its Hilbert key. Documents
are range-sorted by that key, and neighbours along the curve are packed end to end: a document that overruns a
sequence goes on in the next one.

Spark's part: tokens, vector and key are one Arrow projection, written to the shared checkpoint folder so that the
range sort's sampling doesn't tokenise twice; one range shuffle by (key, hash of the document) carries the ids, and
the second column splits a key that many copies share; there is a range for every ``RANGE_BYTES`` of ids. Each sorted range is packed by a scan that holds one sequence.
A range's last, unfilled sequence is cut at powers of two, which need no padding, so nothing is padded at all and no
range has to know another's length. A sequence's id is its range and its place there.

Defined cases: null and empty texts are the end id alone; repeated rows and null doc_ids are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, partitions, settle, slices, whole_text
from ledgerloom.llm.tokens import default_path, id_kind, word_ids

LENGTH = 4096
END_ID = 2
DIMS, BITS = 4, 8
RANGE_BYTES = 64 << 20


def projection(size: int, dims: int = DIMS) -> np.ndarray:
    """A random direction for each of ``size`` hashed ids (the same in every task)."""
    return np.random.default_rng(11).standard_normal((size, dims)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of grid cells, a row each (Skilling's transposed form, for all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def vectors(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The projected unit vectors of documents given as ids; the table's size is the hash's range."""
    out = np.zeros((len(ids), table.shape[1]), np.float32)
    for row, own in zip(out, ids, strict=True):
        for at in range(0, len(own), 65536):  # bounded memory for very long texts
            row += table[own[at : at + 65536].astype(np.int64) * 2654435761 % len(table)].sum(axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (as wide as id_kind says, without the end id), key, tie."""
    kind = id_kind(path)

    @F.pandas_udf("ids binary, key long")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, table = word_ids(path), projection(4096)
        for texts in batches:
            out, keys = [], [np.zeros(0, np.int64)]
            for a, b in slices(texts.str.len().tolist()):
                ids = [np.frombuffer(i, np.uint32) for i in words.texts(texts.iloc[a:b].tolist())]
                cells = ((vectors(ids, table) + 1) * (2 ** (BITS - 1)) - 0.5).round().clip(0, 2**BITS - 1)
                keys.append(hilbert_keys(cells))
                out += [i.astype(kind).tobytes() for i in ids]
            yield pd.DataFrame({"ids": pd.Series(out, dtype=object), "key": np.concatenate(keys)})

    return docs.select("doc_id", encode(whole_text()).alias("t"), F.xxhash64("doc_id", "text").alias("tie")).select("doc_id", "t.key", "tie", "t.ids")


class Packer:
    """Fills sequences of one range with pieces (doc_id, start, ids, doc_tokens, row)."""

    def __init__(self, first: int, length: int = LENGTH) -> None:
        self.sequence, self.length, self.held, self.fill, self.row = first, length, [], 0, first - 1

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        """Pieces of the sequences that are now full."""
        out, start, n = [], 0, len(ids)
        self.row += 1
        while start < n:
            take = min(n - start, self.length - self.fill)
            self.held.append((doc_id, start, ids[start : start + take], n, self.row))
            start, self.fill = start + take, self.fill + take
            if self.fill == self.length:
                out += self._close(self.held)
                self.held, self.fill = [], 0
        return out

    def end(self) -> list[tuple]:
        """What is held, in sequences that are powers of two long."""
        out, rest, held = [], self.fill, self.held[::-1]
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest, part = rest - room, []
            while room:
                doc_id, start, ids, n, row = held.pop()
                part.append((doc_id, start, ids[:room], n, row))
                if len(ids) > room:
                    held.append((doc_id, start + room, ids[room:], n, row))
                room -= len(part[-1][2])
            out += self._close(part)
        return out

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, n, row in pieces:
            out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, self.sequence, offset, row))
            offset += len(ids)
        self.sequence += 1
        return out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, document_row long"


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, document_row.

    document_row tells the rows of docs apart, which may share a doc_id or have none.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    path = path or default_path()
    kind, rows = id_kind(path), settle(tokenised(docs, path))
    held = rows.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = rows.repartitionByRange(max(partitions(docs.sparkSession), held // RANGE_BYTES + 1), "key", "tie").sortWithinPartitions("key", "tie")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, out, held = Packer(TaskContext.get().partitionId() << 32, length), [], 0
        end = np.array([end_id], np.uint32)
        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"].astype("object").where(pdf["doc_id"].notna(), None), pdf["ids"], strict=True):
                own = np.concatenate((np.frombuffer(ids, kind), end))
                out += packer.add(doc_id, own)
                held += len(own)
                if held > 1 << 20:  # rows go on while the range is read
                    yield frame(out)
                    out, held = [], 0
        yield frame(out + packer.end())

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=names)
        return pdf.astype({"doc_id": "Int64"})

    return ranges.select("doc_id", "ids").mapInPandas(fill, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
