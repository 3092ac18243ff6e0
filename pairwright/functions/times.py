"""Stamps of points in time as text or numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of each kind of stamp.
LAYOUTS = {"iso": "yyyy-MM-dd'T'HH:mm:ss", "tag": "yyMMdd", "printable": "yyyy-MM-dd HH:mm:ss", "filename": "yyyy-MM-dd_HH-mm-ss", "comment": "# (yyyy-MM-dd HH:mm:ss)"}


def stamp(ts: Column, kind: str = "iso", delta_seconds: int = 0) -> Column:
    """``ts`` moved by some seconds, in a layout of LAYOUTS, or ``int`` for seconds since 1970."""
    moved = F.timestamp_seconds(F.unix_timestamp(ts) + delta_seconds)
    return F.unix_timestamp(moved) if kind == "int" else F.date_format(moved, LAYOUTS[kind])
