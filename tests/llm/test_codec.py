"""Encoding and decoding against the library that the rank files are made for."""

import hashlib
import random
import types

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import tokenizers

from tideline.llm import codec, queries

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.read_ranks(RANKS), special_tokens={})


def encoded(texts, path=RANKS):
    """What a task makes of texts, row by row."""
    told = types.SimpleNamespace(value=codec.tokenizer(path, P.PATTERN))
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    return [r for b in codec._encode(iter([batch]), told, P.PATTERN, codec.departures(P.PATTERN)) for r in b.to_pylist()]


def test_every_code_point(library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [between.join(every) for between in ("", "a", " ", "1")] + [f"a{c}1{c} {c}" for c in codec.departures(P.PATTERN)]
    assert [r["ids"] for r in encoded(texts)] == [library.encode_ordinary(t) for t in texts]


def test_random_texts_in_blocks(library, monkeypatch):
    monkeypatch.setattr(codec, "REMEMBERED", 20)
    monkeypatch.setattr(codec, "SHORT", 3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\u0085", "\u00a0", "\u3000", "é", "日本", "🙂", "'s", "'", "1", "12", "<|endoftext|>", "the ", "aa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(300))) for r in map(random.Random, range(300))]
    for size in (1, 7, 60):
        monkeypatch.setattr(codec.blocks, "__defaults__", (size,))
        assert [r["ids"] for r in encoded(texts)] == [library.encode_ordinary(t) for t in texts]


def test_offsets_are_those_of_the_library():
    made = tokenizers.Tokenizer.from_str(codec.tokenizer(RANKS, P.PATTERN))
    texts = ["naïve 日本語 🙂🙂  x", "", "ṩ́ a\u0301\n\n ok 𝒳𝒴"]
    for r, t in zip(encoded(texts), texts, strict=True):
        want = made.encode(t, add_special_tokens=False)
        assert r["ids"] == want.ids and list(zip(r["starts"], r["ends"], strict=True)) == want.offsets


def test_other_vocabulary_of_ranks(library):
    ranks = codec.read_ranks(path := P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "Straße, naïve façade; 日本語 и русский 🙂🙂 1234567890 " * 20
    assert encoded([text], path)[0]["ids"] == own.encode_ordinary(text)


def test_vocabulary_without_a_way_to_a_token(tmp_path):
    import base64

    every = [bytes([b]) for b in range(256)] + [b"abc"]
    bad = tmp_path / "bad.tiktoken"
    bad.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(every)))
    with pytest.raises(ValueError, match="abc"):
        codec.tokenizer(str(bad), P.PATTERN)
    bad.write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="bytes"):
        codec.tokenizer(str(bad), P.PATTERN)


def test_rows(spark, docs, rows, none, library):
    coded = codec.decode(codec.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN, with_pieces=True)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "starts", "ends", "decoded", "pieces"]
    got = coded.collect()
    assert len(got) == len(rows)
    want = sorted((repr(r[0]), r[1] or "") for r in rows)
    assert sorted((repr(r.doc_id), bytes(r.decoded).decode()) for r in got) == want
    for r in got:
        text = bytes(r.decoded).decode()
        assert r.ids == library.encode_ordinary(text) and r.n_tokens == len(r.ids) == len(r.starts) == len(r.ends)
        assert "".join(r.pieces) == text
        # the characters of a token hold its bytes, and together they cover the text
        own = [library.decode_single_token_bytes(i) for i in r.ids]
        assert all(b in text[s:e].encode() for b, s, e in zip(own, r.starts, r.ends, strict=True))
        assert sorted({c for s, e in zip(r.starts, r.ends, strict=True) for c in range(s, e)}) == list(range(len(text)))
    empty = codec.decode(codec.encode(none, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert empty.count() == 0


def test_long_text_keeps_its_offsets(spark, library):
    text = " ".join(f"wörd{i}🙂" for i in range(40000))
    row = codec.encode(spark.createDataFrame([(1, text), (2, "x" * 200000), (3, " " * 100000)], "doc_id long, text string"), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert row[0].ids == library.encode_ordinary(text)
    assert row[0].ends[-1] == len(text) and all(a <= b for a, b in zip(row[0].starts, row[0].starts[1:]))
    assert [r.ends[-1] for r in row[1:]] == [200000, 100000]


def test_odd_ids(spark):
    rows = spark.createDataFrame([(1, [72, 105], "a"), (2, [], "b"), (3, None, "c"), (4, [72, None], "d"), (5, [70000], "e"), (6, [8582], "f")], "doc_id long, ids array<int>, decoded string")
    got = {r[0]: r for r in codec.decode(rows, RANKS, P.PATTERN, with_pieces=True).collect()}
    table = codec.byte_table(codec.tokenizer(RANKS, P.PATTERN))
    assert bytes(got[1][3]) == table[72] + table[105] and bytes(got[2][3]) == b"" and got[2][4] == []
    assert all(got[k][3] is None and got[k][4] is None for k in (3, 4, 5))
    assert got[1][2] == "a"  # a column of the same name stays
    assert got[6][4] == [table[8582].decode("utf-8", "replace")]


def test_query_against_the_library(spark, library):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op13_bpe_codec(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(want)).hexdigest()
