import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import token_alignment as T
from tests.llm.rows import awkward, frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
BYTE_OF = T._byte_level()
PAIR = T.Pair(A, B)


def tokens(text):
    """Ids and end offsets of both sides by decoded bytes alone, or None."""
    if not text:
        return None
    out = []
    a = TOKENIZER.encode(" " + text, add_special_tokens=False)
    b = PIECES.encode(text)
    for ids, sizes in (
        (a.ids, [bytes(BYTE_OF[c] for c in t) for t in a.tokens]),
        (b, [bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [PIECES.id_to_piece(i)]]),
    ):
        if b"".join(sizes) != (" " + text).encode():
            return None
        end, ends = 0, []
        for s in sizes:
            end += len(s)
            ends.append(end)
        out.append(list(zip(ids, ends, strict=True)))
    return out


def aligned(text):
    """(n_a, n_b, groups, links): groups as text, links as a list of id pairs, by comparing all tokens."""
    both = tokens(text)
    if both is None:
        return 0, 0, "", []
    a, b = both
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    groups, start = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, e in side if start < e <= cut) for side in (a, b)))
        start = cut
    begins = [[0, *[e for _, e in side][:-1]] for side in (a, b)]
    links, first = [], 0
    for (i, e), s in zip(a, begins[0], strict=True):
        while b[first][1] <= s:
            first += 1
        k = first
        while k < len(b) and begins[1][k] < e:
            links.append((i, b[k][0]))
            k += 1
    return len(a), len(b), ";".join(groups), links


def brute(rows):
    found = [(i, aligned(text)) for i, text, *_ in rows]
    count = Counter(p for _, f in found for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(
        (i if i is not None else -1, n_a, n_b, g.count(";") + bool(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, (n_a, n_b, g, links) in found
    )


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["▁", "a▁b c", "<|endoftext|> <s> </s> <0x41>", "日本語 テキスト", "𝕏𝕏 é́ \U0001f468‍\U0001f469", "a  b   c \n\n d ", " ", "  ", "\t\tx\n", "\x00 \x01", "x" * 500, "é" * 300, "Ünïcödé ſt ﬁ ½   　 ﻿"]


@pytest.mark.parametrize("links", [4_000_000, 50])
def test_alignment_is_brute_forces(spark, monkeypatch, links):
    monkeypatch.setattr(T, "BLOCK_LINKS", links)
    rows = awkward() + [(1000 + k, t, None, None) for k, t in enumerate(ODD)]
    got = T.alignments(frame(spark, rows, ["n_a", "block", "links", "pair"]), A, B)
    assert got.columns == ["doc_id", *COLUMNS]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in COLUMNS)) for r in got.collect()) == brute(rows)


def test_tables_without_text(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in T.alignments(df, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert T.alignments(df.limit(0), A, B).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\té日<s>|▁𝕏\x1c"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=4))
@example(["a b", "a▁ b", " "])
def test_texts_by_pieces_are_texts(texts):
    pair = PAIR
    for text, found in zip(texts, pair.texts(texts), strict=True):
        n_a, n_b, groups, links = aligned(text)
        if found is None:
            assert n_a == 0
        else:
            assert (found[0].decode(), found[2]) == (groups, n_a)
            assert [divmod(int(x), pair.b_size) for x in np.frombuffer(found[1], np.int64)] == links
            assert len(links) + groups.count(";") + 1 - n_a == n_b


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(T, "PIECES", 3)
    monkeypatch.setattr(T, "BATCH", 2)
    monkeypatch.setattr(T, "PIECE_CHARS", 6)
    pair = T.Pair(A, B)
    for text in ["one two three four five", "six one severalletters two", "one"] * 2:
        assert next(pair.texts([text]))[0].decode() == aligned(text)[2]
    assert len(pair.young) + len(pair.old) < 16


def test_new_pieces_share_lines(monkeypatch):
    pair, calls = T.Pair(A, B), []
    monkeypatch.setattr(pair, "_tokens_a", lambda lines, inner=pair._tokens_a: calls.append(len(lines)) or inner(lines))
    text = ", ".join(f"wörd{k}{k * k}" for k in range(2000))
    found = next(pair.texts([text]))
    n_a, _, groups, links = aligned(text)
    assert (found[0].decode(), found[2]) == (groups, n_a)
    assert [divmod(int(x), pair.b_size) for x in np.frombuffer(found[1], np.int64)] == links
    assert sum(calls) < 50


@pytest.mark.parametrize("cuts", [True, False])
def test_lines_with_unaligned_pieces(cuts):
    pair = T.Pair(A, B)
    pair.cuts = cuts
    texts = ["one two▁ three four", "one two three four", "▁", "", "five\x85 six\u2028 seven\x1c ", " eight  nine\n\n ten", "two▁", "eleven\u3000 <|endoftext|> twelve"]
    for text, found in zip(texts, pair.texts(texts), strict=True):
        n_a, _, groups, links = aligned(text)
        if not n_a:
            assert found is None
        else:
            assert (found[0].decode(), found[2]) == (groups, n_a)
            assert [divmod(int(x), pair.b_size) for x in np.frombuffer(found[1], np.int64)] == links
