"""Recursive chunks: a text is cut at the coarsest separators that make its pieces small enough, and pieces are grouped with overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators by level, from paragraphs to words; of each level the first that a piece has is used.
SEPARATORS = (
    ("\n\n", "\r\n\r\n"),
    ("\n", "\r\n", "。", ".", "！", "!", "？", "?", "；", ";"),
    ("，", ",", "：", ":", "、", "（", "(", "）", ")"),
    (" ",),
)
SCHEMA = "array<struct<seq:int,text:string,start:int,end:int>>"


def _ranges(text: str, size: int) -> list[tuple[int, int]]:
    """Ranges of the pieces, each with its separator. Pieces of white space alone are left out; one that no separator cuts stays whole."""
    todo, done = [(0, len(text), 0)], []
    while todo:
        a, b, level = todo.pop()
        sep = next((s for s in SEPARATORS[level] if text.find(s, a, b) >= 0), None) if level < len(SEPARATORS) else ""
        if sep is None:
            todo.append((a, b, level + 1))
        elif not sep:
            done.append((a, b))
        else:
            parts, at = [], a
            while at < b:
                hit = text.find(sep, at, b)
                end = b if hit < 0 else hit + len(sep)
                if text[at:end].strip():
                    # a piece that fits is cut no further
                    parts.append((at, end, level + 1 if end - at > size else len(SEPARATORS)))
                at = end
            todo.extend(reversed(parts))
    return done


def split(text: str, size: int = 512, overlap: int = 64, least: int = 10) -> list[tuple[str, int, int]]:
    """(text, start, end) of each chunk; none for a text of white space alone.

    Pieces under ``least`` characters join the one before. A chunk takes pieces
    while they fit; the next one begins with its last piece, or as many as reach
    the overlap. Its text is its pieces', without blank ones between them.
    """
    pieces: list[list[tuple[int, int]]] = []
    if not text.strip():
        return []
    for r in _ranges(text, size):
        if pieces and r[1] - r[0] < least:
            pieces[-1].append(r)
        else:
            pieces.append([r])
    sizes = [sum(b - a for a, b in p) for p in pieces]
    groups, first, length = [], 0, 0
    for k, n in enumerate(sizes):
        if length + n > size and k > first:
            groups.append((first, k))
            first, length = k, 0
            while first > groups[-1][0] and (first == k or length < overlap):
                first -= 1
                length += sizes[first]
        length += n
    groups.append((first, len(pieces)))
    out = []
    for i, j in groups:
        own = [r for p in pieces[i:j] for r in p]
        out.append(("".join(text[a:b] for a, b in own), own[0][0], own[-1][1]))
    return out


def recursive_chunks(text: Column, size: int = 512, overlap: int = 64, least: int = 10) -> Column:
    """An array of (seq, text, start, end) for each text; null for a null one. Ranges depend on what came before in a text, which no built-in function carries."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else [{"seq": k, "text": x, "start": a, "end": b} for k, (x, a, b) in enumerate(split(s, size, overlap, least))])

    return run(text)
