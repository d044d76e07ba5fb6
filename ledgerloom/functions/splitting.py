"""Splitting texts into pieces under a limit: at paragraphs, then sentences, then (if a cap is given) anywhere.

One fold makes all of it: units in order are put together with a joint while the piece stays within the limit. It looks at a
text once, holds one text, and runs text by text in Arrow batches where the text is read, so no text is grouped or moved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "[\\t\\n\\v\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
PARAGRAPH = re.compile(f"\\n{BLANK}*\\n")
ANY_SENTENCE, FULL_STOP = re.compile(f"(?<=[.!?]){BLANK}+"), re.compile(f"(?<=\\.){BLANK}+")
HELD = 1 << 20  # characters of pieces that leave a task at a time
EDGES = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def octets(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def put_together(units: Iterator[str], limit: int, joint: str, size: Callable[[str], int] = len) -> Iterator[str]:
    """Pieces of whole units, each as long as the limit allows; a unit over the limit is a piece of its own."""
    held: list[str] = []
    total, between = 0, size(joint)
    for unit in units:
        n = size(unit)
        if held and total + between + n > limit:
            yield joint.join(held)
            held, total = [], 0
        total += n + (between if held else 0)
        held.append(unit)
    if held:
        yield joint.join(held)


def hard_cut(text: str, cap: int, size: Callable[[str], int] = len) -> Iterator[str]:
    """Pieces of at most cap, cut between code points: a quarter of the cap each (a code point has four bytes at most)."""
    step = max(1, cap // 4)
    while size(text) > cap:
        yield text[:step]
        text = text[step:]
    yield text


def sentences(paragraph: str, limit: int, ends: re.Pattern, size: Callable[[str], int] = len, cap: int | None = None) -> Iterator[str]:
    """A paragraph within the limit as it is, else its sentences put together again; sentences over the cap are cut."""
    if size(paragraph) <= limit:
        return iter([paragraph])
    units = (s for s in ends.split(paragraph) if s)
    if cap:
        units = (piece for s in units for piece in (hard_cut(s, cap, size) if size(s) > cap else (s,)))
    return put_together(units, limit, " ", size)


def paragraphs(text: str) -> list[str]:
    return [p for p in (part.strip(EDGES) for part in PARAGRAPH.split(text)) if p]


def case_pieces(text: str, limit: int = 2048, cap: int = 262_144) -> Iterator[str]:
    """Retrieval pieces: paragraphs, those over the limit in bytes by sentences."""
    return (piece for p in paragraphs(text) for piece in sentences(p, limit, ANY_SENTENCE, octets, cap))


def document_pieces(text: str, limit: int = 6000) -> Iterator[str]:
    """Pieces for extraction: paragraphs (long ones by sentences) packed up to the limit; a longer sentence stays whole."""
    return put_together((piece for p in paragraphs(text) for piece in sentences(p, limit, FULL_STOP)), limit, "\n\n")


def marked_pieces(pages: list[tuple[int, str]], limit: int = 6000) -> Iterator[str]:
    """Paragraphs of pages, each piece of each with its page's mark, which counts towards the limit."""
    for page, text in pages:
        mark = f"[p.{page}]\n"
        if text := text.strip(EDGES):
            yield from (mark + piece for piece in sentences(text, limit - len(mark), FULL_STOP))


def pieces(rows: DataFrame, cut: Callable[[str], Iterator[str]]) -> DataFrame:
    """rows (doc_id, text) -> (doc_id, i, text): each text's pieces by number. A null text is empty and has none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for at in range(batch.num_rows):  # one text at a time leaves the batch
                doc_id, text = (batch.column(c)[at].as_py() for c in ("doc_id", "text"))
                for i, piece in enumerate(cut(text)):
                    out.append((doc_id, i, piece))
                    held += len(piece)
                    if held >= HELD:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)
        pa.default_memory_pool().release_unused()

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(split, "doc_id long, i long, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "i", "text"])
