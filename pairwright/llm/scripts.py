"""Unicode script ranges, as a table that numpy can search."""

from __future__ import annotations

import numpy as np

# First and last code point of what holds the letters of each script (Unicode block bounds).
SCRIPT_RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x386, 0x386), (0x388, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x481), (0x48A, 0x52F)],
    "armenian": [(0x531, 0x587)],
    "hebrew": [(0x5D0, 0x5F2)],
    "arabic": [(0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x904, 0x939), (0x958, 0x961), (0x971, 0x97F)],
    "bengali": [(0x985, 0x9B9), (0x9DC, 0x9E1)],
    "tamil": [(0xB83, 0xBB9)],
    "thai": [(0xE01, 0xE30), (0xE40, 0xE46)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3)],
    "kana": [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x31F0, 0x31FF)],
    "han": [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
SCRIPTS = ["none", *SCRIPT_RANGES, "other"]

_bounds = sorted((lo, hi, SCRIPTS.index(name)) for name, ranges in SCRIPT_RANGES.items() for lo, hi in ranges)
_starts = np.array([b[0] for b in _bounds])
_ends = np.array([b[1] for b in _bounds])
_ids = np.array([b[2] for b in _bounds], dtype=np.int8)
_LOW = 0x3000


_OTHER = len(SCRIPTS) - 1


def _search(points: np.ndarray) -> np.ndarray:
    """Scripts of code points that are letters; those of no script listed are "other"."""
    at = np.maximum(np.searchsorted(_starts, points, side="right") - 1, 0)
    return np.where((points >= _starts[at]) & (points <= _ends[at]), _ids[at], _OTHER).astype(np.int8)


def _letters(points: np.ndarray) -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in points.tolist()), bool, len(points))


_low_table = np.where(_letters(np.arange(_LOW)), _search(np.arange(_LOW)), 0).astype(np.int8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def script_ids(points: np.ndarray) -> np.ndarray:
    """The index in SCRIPTS of each code point: 0 unless it is a letter, which Unicode's categories decide."""
    if not len(points):
        return np.zeros(0, np.int8)
    low = points < _LOW
    if low.all():
        return _low_table[points]
    out = np.empty(len(points), np.int8)
    out[low] = _low_table[points[low]]
    kinds, back = np.unique(points[~low], return_inverse=True)
    out[~low] = np.where(_letters(kinds), _search(kinds), 0)[back]
    return out


def script_counts(text: str) -> np.ndarray:
    """Letters of each script in ``text``; at 0, all other characters."""
    return np.bincount(script_ids(code_points(text)), minlength=len(SCRIPTS))
