import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import bpe, packing, token_counts
from shelfmark.llm.segments import PieceCache, pieces, spans
from tests.llm.rows import awkward, frame

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.text(alphabet="ab \n\t'é日1!<|endoftext|> \x1c", max_size=60)


@given(TEXTS)
def test_pieces_join_to_the_text(text):
    assert "".join(pieces(text)) == text and "".join(spans(text, 7)) == text


def test_piece_cache_forgets_and_stays_right():
    cache = PieceCache(lambda batch: [p.encode() for p in batch], most=3)
    for _ in range(3):
        for text in ["a b c d e", "f g a", "", "h  i"]:
            assert cache.ids([text]) == [text.encode()]
    assert len(cache.young) + len(cache.old) < 20


@pytest.mark.parametrize("path", [JSON, public_tokenizers.path("piece_bpe_32k.model")])
def test_counts_are_the_librarys(spark, path):
    rows = awkward() + [(900, "a <|endoftext|>  b\n\n c" * 3000, None, None)]
    got = token_counts.count_tokens(frame(spark, rows, ["n_tokens", "ids"]), path).collect()
    if path.endswith("json"):
        library = Tokenizer.from_file(path)
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(library.encode(t or "")) for _, t, *_ in rows]
    assert sorted(r["n_tokens"] for r in got) == sorted(want)
    assert {r["ids"] for r in got} == {"own"}


def test_counts_of_nothing(spark):
    assert token_counts.token_count_query(frame(spark, []), JSON).collect() == []


def test_query_limits_and_bytes(spark):
    rows = {r["doc_id"]: r for r in token_counts.token_count_query(frame(spark, [(1, "é" * 5, None, None), (2, None, None, None), (3, "a b " * 2000, None, None)]), JSON).collect()}
    assert (rows[1]["n_bytes"], rows[2]["n_bytes"], rows[2]["n_tokens"]) == (10, 0, 0)
    assert rows[3]["over_limit"] and not rows[1]["over_limit"]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_rank_table_gives_the_librarys_ids(text):
    library = Tokenizer.from_file(JSON)
    assert packing.encoder(JSON).encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def test_rank_table_agrees_on_every_code_point():
    library, table = Tokenizer.from_file(JSON), packing.encoder(JSON)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 512):
        text = " ".join(f"a{c}1{c}b,{c}{c} {c}" for c in points[at : at + 512])
        assert table.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 100])
def test_packing(spark, capacity):
    rows = [r for r in awkward() if r[0] is not None]
    docs = frame(spark, rows, ["ids", "start", "length"]).dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = packing.pack(docs, JSON, capacity).collect()
    library, pieces_of, sequences = Tokenizer.from_file(JSON), {}, {}
    for r in found:
        pieces_of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces_of) == set(texts)
    for key, parts in pieces_of.items():
        parts.sort(key=lambda r: r["start"])
        want = library.encode(texts[key] or "", add_special_tokens=False).ids + [1]
        assert [p["start"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts])[:-1])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).tolist() == want
        assert {p["doc_tokens"] for p in parts} == {len(want)}
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([p["length"] for p in parts])
        assert [p["offset"] for p in parts] == [0, *ends[:-1]] and ends[-1] <= capacity
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else capacity - ends[-1]
    assert padding <= 0.02 * sum(r["length"] for r in found)
    query = packing.packing_query(docs, JSON).collect()
    assert len(query) and all(0 <= r["ids_crc32"] < 2**32 for r in query)


def test_packing_nulls_repeats_and_nothing(spark):
    found = packing.pack(frame(spark, [(None, None, None, None), (1, "a", None, None), (1, "a", None, None)]), JSON).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in found) == [(0, 1), (1, 2), (1, 2)] or sum(r["length"] for r in found) == 5
    assert packing.pack(frame(spark, []), JSON).collect() == []


def test_classes_are_reciprocals():
    fits = packing.class_lengths(2048)
    assert [int(fits[n]) for n in (1, 45, 681, 682, 683, 1500, 2048)] == [1, 45, 512, 682, 682, 1024, 2048]


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_bpe_is_tiktokens(own, text):
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_of_long_pre_tokens(own):
    rng = random.Random(5)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ["a" * 20_000, "".join(rng.choice("abcdehinst") for _ in range(30_000)), "é" * 9_999, " " * 5000 + "x"]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_rank_queue_order():
    queue = bpe.RankQueue(70_000)
    for rank in [69_999, 3, 256, 255, 3]:
        queue.push(rank, rank + 1)
    seen = []
    while (rank := queue.first()) >= 0:
        seen.append((rank, queue.take(rank)))
    assert seen == [(3, [4, 4]), (255, [256]), (256, [257]), (69_999, [70_000])]


def test_bpe_frames(spark, own):
    rows = awkward()
    both = bpe.decode(bpe.encode(frame(spark, rows, ["ids", "decoded"]), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in both) == sorted((t or "").encode() for _, t, *_ in rows)
    digests = bpe.bpe_query(frame(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert digests.count() == len(rows) and digests.where("n_tokens = 0").count() == sum(not t for _, t, *_ in rows)
    assert bpe.bpe_query(frame(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_crc_is_of_little_endian_ids(spark):
    row = packing.packing_query(frame(spark, [(7, "hello", None, None)]), JSON).collect()
    ids = Tokenizer.from_file(JSON).encode("hello", add_special_tokens=False).ids + [1]
    assert sum(r["length"] for r in row) == len(ids)
    if len(row) == 1:
        assert row[0]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
