"""Order-dependent groupings as folds over numbers: each gives every item its group's number.

A fold sees sizes, headings and word sets only; ``together`` and, for columns, ``grouped`` apply its numbers to anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(sizes: Sequence[int], most: int, joins: Sequence[int] | None = None, breaks: Sequence[bool] | None = None, alone: int = 0) -> list[int]:
    """Greedy packing: an item joins the group before it while both and the join's cost stay within ``most``.

    A group without size takes nothing at a cost; a ``breaks`` item always starts a group, and the
    first ``alone`` items are groups of their own.
    """
    out, number, used = [], -1, 0
    for i, size in enumerate(sizes):
        cost = joins[i] if joins is not None else 0
        if i > alone and (used or not cost) and used + cost + size <= most and not (breaks is not None and breaks[i]):
            used += cost + size
        else:
            number += 1
            used = size
        out.append(number)
    return out


def filled(sizes: Sequence[int], least: int, most: int, join: int = 1) -> list[int]:
    """Items join the group before while its last line has under ``least``; an item that starts a group is cut into lines of ``most``."""
    out, number, line = [], -1, least
    for size in sizes:
        if line < least:
            line += join + size
        else:
            number += 1
            line = (size - 1) % most + 1 if size else 0
        out.append(number)
    return out


def merged(chars: Sequence[int], headings: Sequence[str], least: int, most: int, join: int = 2) -> list[int]:
    """Items of under ``least`` tokens gather up to ``most``; with under ``least`` gathered, a larger item of the same heading takes them in.

    What is gathered last joins the item before it, if both have ``most`` at most.  A token is four characters.
    """
    tokens = [n // 4 for n in chars]
    ends: list[int] = []  # last item of each closed group
    held, begin = 0, 0  # characters gathered since item `begin`

    def gathered(upto: int) -> bool:
        return begin < upto

    for i, n in enumerate(chars):
        if tokens[i] < least:
            if gathered(i) and held // 4 + tokens[i] > most:
                ends.append(i - 1)
                begin = i
            held = held + join + n if gathered(i) else n
            continue
        if gathered(i) and not (held // 4 < least and headings[begin] == headings[i]):
            ends.append(i - 1)
        ends.append(i)
        begin = i + 1
    if gathered(len(chars)):
        start = ends[-2] + 1 if len(ends) > 1 else 0
        if ends and (sum(chars[start:begin]) + join * (begin - start - 1)) // 4 + held // 4 <= most:
            ends[-1] = len(chars) - 1
        else:
            ends.append(len(chars) - 1)
    return numbers(ends)


def numbers(ends: Iterable[int]) -> list[int]:
    """Group numbers from the last item of each group."""
    out: list[int] = []
    for number, end in enumerate(ends):
        out += [number] * (end + 1 - len(out))
    return out


def alike(headings: Sequence[str], keys: Sequence[Sequence[str]], least: float) -> list[int]:
    """Neighbours stay together if like the one before, or (at four fifths) like the whole group so far; a new heading parts them."""
    out, number = [], -1
    last: set[str] = set()
    union: set[str] = set()
    for i, words in enumerate(keys):
        now = set(words)
        near = max(_overlap(last, now, len(last | now)), 0.8 * _overlap(union, now, len(union) + len(now - union)))
        if i and near >= least and (not headings[i] or headings[i] == headings[i - 1]):
            union |= now
        else:
            number += 1
            union = set(now)
        last = now
        out.append(number)
    return out


def _overlap(a: set[str], b: set[str], n_union: int) -> float:
    return len(b & a) / n_union if a and b else 0.0


def together(items: Sequence, group: Sequence[int]) -> list[list]:
    """Neighbours with equal numbers."""
    return [[item for item, _ in pairs] for _, pairs in groupby(zip(items, group, strict=True), key=lambda x: x[1])]


def column(fold: Callable[..., list[int]], *inputs: Column) -> Column:
    """A fold over array columns, row by row: ``array<int>`` of group numbers; a null array gives null."""
    @F.pandas_udf("array<int>")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else fold(*(x.tolist() if hasattr(x, "tolist") else x for x in row)) for row in zip(*series, strict=True)], dtype=object)

    # the optimiser would otherwise move a fold into the lambda that reads its numbers, where it can't run
    return run.asNondeterministic()(*inputs)


def grouped(items: Column, group: Column) -> Column:
    """``array<array<item>>`` of neighbours with equal numbers; linear.  Both should be columns, not expressions."""
    starts = F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: (i == 1) | (F.get(group, i - 1) != F.get(group, i - 2)))
    cut = lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(items) + 1)), lambda a, b: F.slice(items, a, b - a))
    return F.when(F.size(items) > 0, F.transform(F.array(starts), cut)[0])
