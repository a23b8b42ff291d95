"""The word rule that the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall
find_spans = re.compile(WORD).finditer
_gaps = re.compile(rb"[\x20\x09-\x0D]+").sub
_gap = re.compile(rb"[\x20\x09-\x0D]+").search


def words(text: str | Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    inner = F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def spread(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by one space, in UTF-8, with where each starts and ends there."""
    whole = _gaps(b" ", (text or "").encode()).strip(b" ")  # of bytes: ASCII white space only
    if not whole:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    return whole, np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(whole)]])


def stretches(text: str | None, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in UTF-8, cut after ASCII white space into stretches of about ``size`` bytes, so that no word is cut."""
    raw = (text or "").encode()
    at = 0
    while at < len(raw):
        gap = _gap(raw, at + size) if at + size < len(raw) else None
        end = gap.end() if gap else len(raw)
        yield raw[at:end]
        at = end
