"""Encoding and decoding by byte-level byte-pair vocabularies.

A vocabulary is a file of ranks: one line for each token, its bytes in base64 and
its id. The ``tokenizers`` library merges by pairs and not by ranks, so the pair
that makes each token is found first: the two symbols that the lower ranks leave
of its bytes. Both orders of merging then agree, as between the same two ends the
lower ranks leave the same symbols everywhere.

The library works on characters. Each byte has one that stands for it
(``bpe.byte_alphabet``), and pretokens go to its model in these. A task remembers
the ids of short pretokens, so the library meets each of them once. Tokens follow
each other without gaps, so their lengths in bytes place them, and the bytes that
begin a character turn places into characters of the text. A character of several
bytes can be split over tokens: all of them carry its offsets, and decoding joins
bytes before it reads characters.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import decoders, models, pre_tokenizers

from .bpe import byte_alphabet

#: Characters after which a long text is cut, at the next white space, and rows that a task works on and passes on at once.
BLOCK, ROWS = 1 << 16, 128
#: Pretokens whose ids a task remembers, and how long they may be.
REMEMBERED, SHORT = 1 << 17, 64
_CUT = re.compile(r"(?<=\S)[ \n]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Id of each token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two symbols that make ``token``: what the ranks below its own leave of its bytes."""
    symbols, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(symbols) > 2:
        rank, i = min((ranks.get(symbols[i] + symbols[i + 1], own), i) for i in range(len(symbols) - 1))
        if rank >= own:
            break
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    if len(symbols) != 2:
        raise ValueError(f"no two tokens of lower rank make {token!r}")
    return symbols[0], symbols[1]


@cache
def tokenizer(path: str, pattern: str) -> str:
    """The library's tokenizer for a rank file, as JSON: matches of ``pattern`` are encoded each by itself."""
    ranks = read_ranks(path)
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    alphabet = byte_alphabet()
    chars = lambda raw: "".join(alphabet[b] for b in raw)
    merges = [tuple(map(chars, halves(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    made = tokenizers.Tokenizer(models.BPE({chars(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    each = pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([each, pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def byte_table(told: str) -> list[bytes | None]:
    """The bytes of each id, by the byte alphabet read backwards; None where there is no token."""
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    known = {i: bytes(byte[c] for c in token) for token, i in tokenizers.Tokenizer.from_str(told).get_vocab().items()}
    return [known.get(i) for i in range(max(known) + 1)]


def blocks(text: str, size: int = BLOCK) -> list[str]:
    """A text cut before white space that follows another character, where no match of the pattern runs on."""
    out, start = [], 0
    while len(text) - start > size and (m := _CUT.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def pieces(ids: Iterable[int], table: list[bytes | None]) -> list[str]:
    """The characters that each token completes; those of a character that is split come with its last token."""
    read = codecs.getincrementaldecoder("utf-8")("replace")
    out = [read.decode(table[i]) for i in ids]
    if out and (rest := read.decode(b"", final=True)):
        out[-1] += rest
    return out


@cache
def departures(pattern: str) -> str:
    """Characters that the library has in another class of ``pattern`` than ``regex`` has: the Unicode versions differ."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out: set[str] = set()
    for kind in set(re.findall(r"\\[pP]\{[^}]*\}|\\[sSdDwW]", pattern)):
        alone = pre_tokenizers.Split(tokenizers.Regex(kind), "removed", invert=True)
        theirs = {c for k in range(0, len(every), 1 << 15) for piece, _ in alone.pre_tokenize_str(every[k : k + (1 << 15)]) for c in piece}
        out |= theirs ^ set(regex.findall(kind, every))
    return "".join(sorted(out))


class Codes(dict):
    """The ids, as 32-bit numbers, of each pretoken that a task has met.

    When it is full it starts anew, but takes over what is asked for again.
    """

    def __init__(self, told: str):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.model = tokenizers.Tokenizer.from_str(told).model
        self.alphabet = dict(enumerate(byte_alphabet()))

    def __missing__(self, pretoken: str) -> bytes:
        ids = self.before.get(pretoken)
        if ids is None:
            chars = pretoken.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)
            ids = array("i", [t.id for t in self.model.tokenize(chars)]).tobytes()
        if len(pretoken) <= SHORT:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[pretoken] = ids
        return ids


def spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character, and the one after the last, of tokens of so many bytes that make up ``raw``."""
    begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int32)
    ends = np.cumsum(lengths)
    return begins[ends - lengths] - 1, begins[ends - 1]


def _encode(batches: Iterator[pa.RecordBatch], told: Broadcast, pattern: str, moved: str) -> Iterator[pa.RecordBatch]:
    codes, lengths = Codes(told.value), np.array([len(b or b"") for b in byte_table(told.value)])
    usual, library, odd = regex.compile(pattern).findall, pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated"), frozenset(moved)

    def ids_of(text: str) -> np.ndarray:
        words = usual(text) if text.isascii() or odd.isdisjoint(text) else [piece for piece, _ in library.pre_tokenize_str(text)]
        return np.frombuffer(b"".join(map(codes.__getitem__, words)), np.int32)

    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            batch = whole.slice(k, ROWS)
            rows: list[tuple[np.ndarray, ...]] = []
            for text in batch.column("text").to_pylist():
                before, parts = 0, [(np.zeros(0, np.int32),) * 3]
                for block in blocks(text or ""):
                    ids = ids_of(block)
                    starts, ends = spans(block.encode("utf-8", "replace"), lengths[ids])
                    parts.append((ids, starts + before, ends + before))
                    before += len(block)
                rows.append(tuple(np.concatenate(p).astype(np.int32) for p in zip(*parts, strict=True)))
            tokens = np.array([len(r[0]) for r in rows], np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(tokens))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[n] for r in rows]), pa.int32())) for n in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens), *lists], ["id", "n_tokens", "ids", "starts", "ends"])


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, starts, ends) of every row's whole text, for the rank file ``ranks``.

    ``starts`` and ``ends`` are the characters of the text that a token stands
    for, with all of a character that it has a part of. No special token is
    added or known. ``pattern`` has to cover every text and to begin a new match
    at white space that follows another character, as those of this family do;
    long texts are cut there. Characters are in the classes that the library has
    them in (``departures``). Null and empty texts have no tokens and empty lists. Rows are
    independent: null, repeated and tied ids keep their rows; other columns are
    not read. The tokenizer, whose size is the vocabulary's, is broadcast.
    """
    told = docs.sparkSession.sparkContext.broadcast(tokenizer(ranks, pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_encode, told=told, pattern=pattern, moved=departures(pattern)), f"id {kind}, n_tokens long, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], told: Broadcast, at: int, with_pieces: bool) -> Iterator[pa.RecordBatch]:
    table = byte_table(told.value)
    tokens, known = pa.array(table, pa.binary()), np.array([t is not None for t in table])
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            batch = whole.slice(k, ROWS)
            lists = batch.column(at)
            ids = lists.flatten()
            plain = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            good = (plain >= 0) & (plain < len(table))
            good[good] = known[plain[good]]
            joined = tokens.take(pa.array(np.where(good, plain, int(np.argmax(known)))))
            ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            edges = np.concatenate(([0], ends))
            bad = np.concatenate(([0], np.cumsum(~good)))
            valid = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bad[edges]) == 0)
            # the bytes of all tokens lie one after the other: a row's end where its last token ends
            _, places, content = joined.buffers()
            places = np.frombuffer(places, np.int32)[edges] if len(joined) else np.zeros(len(edges), np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(lists), [pa.array(valid).buffers()[1], pa.py_buffer(places), content or pa.py_buffer(b"")])
            columns = [*batch.columns, decoded]
            if with_pieces:
                columns.append(pa.array([pieces(row, table) if ok else None for row, ok in zip(lists.to_pylist(), valid, strict=True)], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", with_pieces: bool = False) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes that ``ids`` stand for.

    Bytes are joined before anything is read as characters, so characters that
    are split over tokens come out whole. With ``with_pieces``, ``pieces`` holds
    the characters that each token completes; bytes that make no character are
    U+FFFD there. Both are null where ``ids`` is null, holds a null or an id that
    the vocabulary does not have; no ids give no bytes. Other columns are kept,
    whatever their names.
    """
    told = encoded.sparkSession.sparkContext.broadcast(tokenizer(ranks, pattern))
    names = [*encoded.columns, "decoded", *(["pieces"] if with_pieces else [])]
    kinds = [*(f.dataType.simpleString() for f in encoded.schema), "binary", *(["array<string>"] if with_pieces else [])]
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
    at = encoded.columns.index(ids_col)
    return encoded.toDF(*(f"c{i}" for i in range(len(encoded.columns)))).mapInArrow(partial(_decode, told=told, at=at, with_pieces=with_pieces), schema).toDF(*names)
