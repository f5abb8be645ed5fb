"""Words and terms of whole texts as UTF-8 bytes, and tables cut into parts of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
DIGITS = b"0123456789"


class Words:
    """Maximal runs of letters (and digits), where every byte above 0x7F is a letter; A-Z are lower-cased.

    UTF-8 keeps such bytes together, so the runs are those of the text's characters.
    """

    def __init__(self, digits: bool) -> None:
        kept = LETTERS + (DIGITS if digits else b"")
        self.table = bytes(c if c in kept else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
        self.run = re.compile(b"[^ ]+")

    def __call__(self, text: bytes | None) -> list[bytes]:
        return text.translate(self.table).split() if text else []

    def places(self, text: bytes) -> list[tuple[int, int]]:
        """Byte offsets (begin, end) of the words."""
        return [m.span() for m in self.run.finditer(text.translate(self.table))]


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Values of the named columns row by row: no batch of long texts is held twice."""
    return zip(*((v.as_py() for v in batch.column(n)) for n in names))


def part_count(df: DataFrame, size, most: int) -> int:
    """How many parts of about ``most`` in sum of ``size`` the rows make, at least one."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // most))
