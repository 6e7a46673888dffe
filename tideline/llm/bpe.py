"""Token counts of byte-level byte-pair encodings, without the tokens.

A pretoken starts as one symbol for each byte. Its symbols form a linked list,
and a heap holds the adjacent pairs that may merge; the pair of lowest rank,
leftmost first, is merged again and again. Each merge takes one symbol away, so
the count is the number of bytes minus the number of merges.

Which characters are letters and numbers depends on the Unicode version, and the
library that a vocabulary belongs to has its own. Its answers are asked for once,
on the driver, where they can differ from those of ``regex``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
import regex
import tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies of this family cut a text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Planes above this one hold no letters, numbers or spaces in any version.
LAST_PLANE = 0x3FFFF
#: Pretokens whose count a task remembers, and how long they may be.
REMEMBERED, SHORT = 1 << 19, 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def load(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Rank of each merge, and the special strings, of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    byte = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
    raw = lambda s: b"".join(byte[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    return ranks, [t["content"] for t in told["added_tokens"]]


def _probed(vocabulary: str, lead: str, points: list[int]) -> set[int]:
    """The code points that the library keeps in one pretoken with ``lead`` before them."""
    cut = tokenizers.Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
    together: set[int] = set()
    for k in range(0, len(points), 1 << 15):
        part = points[k : k + (1 << 15)]
        pieces = cut("".join(f"{lead}{chr(c)}\n" for c in part))
        together |= {part[start // 3] for _, (start, end) in pieces if start % 3 == 0 and end - start == 2}
    return together


@cache
def departures(vocabulary: str) -> tuple[str, str, str]:
    """Characters that the library takes for letters, for numbers, and for neither, other than ``regex`` does.

    Asked for are those that are letters or numbers to ``regex`` (the library may
    be older) and those that are unassigned to it (or newer).
    """
    every = "".join(map(chr, (c for c in range(LAST_PLANE + 1) if not 0xD800 <= c < 0xE000)))
    letter, number, unknown = (set(map(ord, regex.findall(p, every))) for p in (r"\p{L}", r"\p{N}", r"\p{Cn}"))
    asked = sorted(letter | number | unknown)
    letters, numbers = _probed(vocabulary, "a", asked), _probed(vocabulary, "1", asked)
    text = lambda points: "".join(map(chr, sorted(points)))
    return text(letters - letter), text(numbers - number), text((letter | number) - letters - numbers)


def pretokens(vocabulary: str) -> tuple[str, str, str]:
    """The usual pattern, the characters that it places in another class than the library, and the pattern for texts with these."""
    letters, numbers, others = departures(vocabulary)
    moved = letters + numbers + others
    if not moved:
        return PRETOKEN, "", PRETOKEN

    def runs(text: str) -> str:
        """The characters of a set in brackets, as ranges."""
        points = set(map(ord, text))
        starts, ends = ([c for c in sorted(points) if c + step not in points] for step in (-1, 1))
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends, strict=True))

    own = lambda p, extra: rf"[[\p{{{p}}}{'||[' + runs(extra) + ']' if extra else ''}]--[{runs(''.join(c for c in moved if c not in set(extra)))}]]"
    letter, number = own("L", letters), own("N", numbers)
    exact = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\p{{White_Space}}{letter}{number}]+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"
    return PRETOKEN, moved, exact


def count_merged(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of one pretoken."""
    left = len(word)
    symbol: list[bytes | None] = [word[i : i + 1] for i in range(left)]
    after, before = list(range(1, left + 1)), list(range(-1, left - 1))
    heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(left - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    end = left
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= end or symbol[i] != a or symbol[j] != b:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = a + b, None
        left -= 1
        after[i] = k = after[j]
        if k < end:
            before[k] = i
            if (r := ranks.get((a + b, symbol[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbol[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbol[h], a + b))
    return left


class Counts(dict):
    """Token count of each pretoken a task has met."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, pretoken: str) -> int:
        n = count_merged(pretoken.encode("utf-8", "replace"), self.ranks)
        if len(pretoken) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pretoken] = n
        return n


def _count(batches: Iterator[pa.RecordBatch], ranks: Broadcast, special: list[str], patterns: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    counts = Counts(ranks.value)
    usual, exact, moved = regex.compile(patterns[0]).finditer, None, frozenset(patterns[1])
    assert all(ord(c) > 0xFF for c in moved)
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def finder(text: str) -> Callable:
        nonlocal exact
        try:
            text.encode("latin-1")  # in none of these do the versions differ
            return usual
        except UnicodeEncodeError:
            if moved.isdisjoint(text):
                return usual
        exact = exact or regex.compile(patterns[2]).finditer
        return exact

    def tokens(text: str) -> int:
        pieces, find = cut.split(text) if cut else [text], finder(text)
        return len(pieces) - 1 + sum(counts[m.group()] for piece in pieces for m in find(piece))

    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array([tokens(t or "") for t in texts], pa.int64())],
            ["id", "n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, for the byte-level vocabulary file ``vocabulary``.

    Special strings inside a text count as one token each; none are added. Null
    and empty texts have 0 bytes and 0 tokens. Rows are independent: null,
    repeated and tied ids keep their rows, and other columns are not read. The
    merge table, whose size is that of the vocabulary, is broadcast. Characters
    are in the classes that the library gives them (see ``departures``).
    """
    ranks, special = load(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_count, ranks=shared, special=special, patterns=pretokens(vocabulary)), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
