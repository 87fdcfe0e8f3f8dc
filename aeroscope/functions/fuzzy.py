"""Sequence scores as Arrow functions: indel ratio of characters, edit operations of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _places(a: str) -> dict[str, int]:
    """Bit set of the positions of each character."""
    where: dict[str, int] = {}
    for pos, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << pos)
    return where


def lcs_length(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Longest common subsequence, one big-integer row per character of b (bit-parallel)."""
    get = (_places(a) if where is None else where).get
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & get(c, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str, where: dict[str, int] | None = None) -> float:
    """Normalised indel similarity 2 * LCS / (len a + len b); two empty texts give 1."""
    if a == b:
        return 1.0
    return 2.0 * lcs_length(a, b, where) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, where = [], None, {}
    for x, y in zip(a, b):
        if x != last:
            last, where = x, _places(x)
        out.append(ratio_of(x, y, where))
    return pd.Series(out, dtype="float64")


COST, SUB, DEL, INS = 1 << 60, 1 << 40, 1 << 20, 1
WIDEST_BAND = 128


def _band(r: list[int], h: list[int], k: int) -> int | None:
    """Counts packed as cost, sub, del, ins in one integer; cells further than k off the diagonal are left
    out. Exact when the cost is at most k, else None."""
    m, n = len(r), len(h)
    if abs(m - n) > k:
        return None
    far = COST << 40
    row = [j * (COST + INS) if j <= k else far for j in range(n + 1)]
    for i in range(1, m + 1):
        lo, hi = max(1, i - k), min(n, i + k)
        diag = row[lo - 1]
        row[lo - 1] = i * (COST + DEL) if lo == 1 else far
        left = row[lo - 1]
        w = r[i - 1]
        for j in range(lo, hi + 1):
            up = row[j] if j < i + k else far
            if w == h[j - 1]:
                left = diag
            else:
                a, b, c = diag >> 60, up >> 60, left >> 60
                if a <= b and a <= c:
                    left = diag + COST + SUB
                elif b <= c:
                    left = up + COST + DEL
                else:
                    left = left + COST + INS
            diag = row[j]
            row[j] = left
    return row[n] if row[n] >> 60 <= k else None


def edit_operations(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """Substitutions, deletions, insertions and hits of a shortest edit; ties prefer sub, del, ins.

    Common ends are hits in every case. A narrow band is widened until it holds the distance; very different
    long texts go to the full table, one anti-diagonal at a time, so memory stays linear.
    """
    shorter = min(len(ref), len(hyp))
    tail = 0
    while tail < shorter and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    head = 0
    while head < shorter - tail and ref[head] == hyp[head]:
        head += 1
    same = head + tail
    ref, hyp = ref[head:len(ref) - tail], hyp[head:len(hyp) - tail]
    m, n = len(ref), len(hyp)
    if m == 0 or n == 0:
        return 0, m, n, same
    code: dict[str, int] = {}
    r = [code.setdefault(w, len(code)) for w in ref]
    h = [code.setdefault(w, len(code)) for w in hyp]
    k = 4
    while k <= WIDEST_BAND:
        packed = _band(r, h, k)
        if packed is not None:
            s, d, i = packed >> 40 & 0xFFFFF, packed >> 20 & 0xFFFFF, packed & 0xFFFFF
            return s, d, i, m - s - d + same
        if k >= max(m, n):
            break
        k *= 2
    s, d, i = _full_table(np.array(r), np.array(h))
    return s, d, i, m - s - d + same


def _full_table(r: np.ndarray, h: np.ndarray) -> tuple[int, int, int]:
    m, n = len(r), len(h)
    # rows of a state: cost, substitutions, deletions, insertions; index = i
    older = np.zeros((4, m + 1), dtype=np.int64)
    newer = np.zeros((4, m + 1), dtype=np.int64)
    newer[:, 0] = (1, 0, 0, 1)
    newer[:, 1] = (1, 0, 1, 0)
    step_sub, step_del, step_ins = (np.array([[1], *x]) for x in ([[1], [0], [0]], [[0], [1], [0]], [[0], [0], [1]]))
    for k in range(2, m + n + 1):
        now = np.zeros_like(newer)
        if k <= n:
            now[:, 0] = (k, 0, 0, k)
        if k <= m:
            now[:, k] = (k, 0, k, 0)
        i = np.arange(max(1, k - n), min(m, k - 1) + 1)
        diag, up, left = older[:, i - 1], newer[:, i - 1], newer[:, i]
        best = np.minimum(np.minimum(diag[0], up[0]), left[0])
        out = np.where(diag[0] == best, diag + step_sub, np.where(up[0] == best, up + step_del, left + step_ins))
        now[:, i] = np.where(r[i - 1] == h[k - i - 1], diag, out)
        older, newer = newer, now
    return tuple(int(x) for x in newer[1:, m])


OPERATIONS = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions", "hits")]
)


@F.pandas_udf(OPERATIONS)
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [edit_operations(list(a), list(b)) for a, b in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "hits"], dtype="int32")
