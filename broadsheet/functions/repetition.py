"""Degenerate model output: a chunk repeated many times in a row, in near-linear time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Shortest chunk and number of consecutive copies that count as degenerate.
SHORTEST, COPIES = 3, 9


def _longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def is_degenerate(text: str) -> bool:
    """True if some line holds a chunk of SHORTEST or more characters COPIES times in a row.

    Copies of a chunk of length n make character i equal character i + n over a
    stretch of (COPIES - 1) * n places, which contains COPIES - 1 multiples of
    n. Looking only at those multiples costs len / n per chunk length; the few
    stretches that pass are compared in full.
    """
    for line in text.split("\n"):
        if len(line) < SHORTEST * COPIES:
            continue
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for size in range(SHORTEST, len(codes) // COPIES + 1):
            sample = codes[::size]
            equal = sample[1:] == sample[:-1]
            if np.count_nonzero(equal) < COPIES - 1 or _longest_run(equal) < COPIES - 1:
                continue
            if _longest_run(codes[size:] == codes[:-size]) >= (COPIES - 1) * size:
                return True
    return False


def is_repetitive(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else is_degenerate(t))

    return check(text)
