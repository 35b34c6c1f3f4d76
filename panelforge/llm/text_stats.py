"""Counts and shares of one text that the quality operators score. Words are runs without ASCII white space."""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
STOPS = b".!?"

#: The features of a document, in the order of `Stats.features`.
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "stop_share", "distinct_share", "top_word_share", "run_share", "line_words", "wordless_share")


def window_ids(ids: np.ndarray, distinct: int, width: int = 5) -> np.ndarray:
    """A number for each window of `width` words, equal exactly where the windows are equal."""
    key, span = ids.astype(np.int64), max(distinct, 1)
    for k in range(1, width):
        if span >= 2**62 // max(distinct, 1):
            _, key = np.unique(key, return_inverse=True)
            span = len(key) + 1
        key, span = key[:-1] * distinct + ids[k:], span * distinct
    return key


def repeated_words(ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """Words that lie in a window found at least twice; overlapping windows count a word once."""
    if len(ids) <= width:
        return 0
    key = window_ids(ids, distinct, width)
    ordered = np.sort(key)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(np.isin(key, ordered[1:][same]))
    return int(np.minimum(np.diff(at, append=at[-1] + width), width).sum())


class Stats:
    """Counts of one text (UTF-8 bytes)."""

    __slots__ = ("features", "n_dup_lines", "n_repeat_words", "n_symbols", "n_words", "word_chars")

    def __init__(self, text: bytes):
        words = text.split()
        n = self.n_words = len(words)
        bare = text.translate(None, SPACES)
        self.word_chars = len(bare.decode("utf-8", "replace"))
        self.n_symbols = len(bare) - len(bare.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
        self.n_dup_lines = len(lines) - len(set(lines))
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        self.n_repeat_words = repeated_words(ids, len(numbers))
        size, w = max(len(bare), 1), max(n, 1)
        without = lambda chars: (len(bare) - len(bare.translate(None, chars))) / size
        stops = sum(x.rstrip(SPACES)[-1] in STOPS for x in lines)
        self.features = (
            np.log1p(n),
            min(self.word_chars / w, 100.0),
            self.n_symbols / size,
            self.n_dup_lines / max(len(lines), 1),
            self.n_repeat_words / w,
            without(UPPER),
            without(DIGITS),
            without(b"!"),
            stops / max(len(lines), 1),
            len(numbers) / w,
            (np.bincount(ids).max() / w) if n else 0.0,
            float(np.count_nonzero(ids[1:] == ids[:-1])) / w,
            min(n / max(len(lines), 1), 1000.0),
            sum(len(x) == 1 for x in words) / w,
        )
