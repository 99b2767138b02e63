"""Token counts, token files and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from embertrace.llm import token_counts, token_files
from embertrace.llm.common import new_folder
from embertrace.llm.packing import GROUP_ENTRIES, assign, closes, pack
from embertrace.llm.tokens import STABLE, encoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name, texts):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in lib.encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE, WORD])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdtAé1.  ́²ﬁ你"), st.characters(codec="utf-8")), max_size=60), max_size=8))
def test_encoder_equals_library(name, texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(name).encode(texts)]
    assert got == library(name, texts)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_on_odd_texts(name):
    texts = [" " * 1_500_000 + "x", "\x01 a\x01", "ΑΣ Σας", "İstanbul", "\u212b\u1100\u1161", "".join(map(chr, range(1, 0x530))), "漢字かなカナ한글 €…„“",
             "ab" * 50_000, "a <|endoftext|> b", "<|startoftext|>", "x" * 5000, "don't  we'll", "a b c d e f g h", "a b c d e f g h i"]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(name).encode(texts)]
    assert got == library(name, texts)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_library_over_stable_characters(name):
    chars = [c for c in map(chr, range(0xFFFF)) if STABLE.fullmatch(c)]
    texts = [f"a{c}b {c}1{c} {c}{c}'s  {c}\n{c}X {d}{c}" for c, d in zip(chars, chars[1:])]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(name).encode(texts)]
    assert got == library(name, texts)


def test_counts(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0), len((r.text or "").encode()), len(ids)) for r, ids in zip(rows, library(BYTE, [r.text or "" for r in rows])))
    cache = token_counts.DigestCache(spark)
    for _ in range(2):
        got = token_counts.with_limit(token_counts.count_tokens(odd, BYTE, cache)).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
        assert spark.read.parquet(cache.path).count() == odd.selectExpr("coalesce(text, '')").distinct().count()  # nothing is encoded twice
    more = odd.selectExpr("doc_id", "'new text' AS text")
    assert {r.n_tokens for r in token_counts.count_tokens(more, BYTE, cache).collect()} == {2}
    assert spark.read.parquet(cache.path).count() == odd.selectExpr("coalesce(text, '')").distinct().count() + 1
    assert token_counts.count_tokens(none, BYTE, cache).count() == 0
    assert token_counts.count_tokens(none, BYTE, token_counts.DigestCache(spark)).count() == 0
    other = token_counts.count_tokens(odd, WORD, cache)  # another version never reads these counts
    assert {r.n_tokens for r in other.where("doc_id = 9").collect()} == {len(library(WORD, [rows[11].text])[0])}


@pytest.mark.parametrize("top", [1, 255, 256, 65_535, 65_536, 2**32 - 1])
def test_codes_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        ids = rng.integers(0, top, n, np.uint32, endpoint=True)
        codes = token_files.Codes(token_files.pack_codes(ids))
        assert codes.all().tolist() == ids.tolist() and len(codes) == n
        for i in rng.integers(0, n, 40) if n else []:
            assert codes[int(i)] == ids[i]
    with pytest.raises(ValueError):
        token_files.Codes(b"other")
    with pytest.raises(IndexError):
        token_files.Codes(token_files.pack_codes(ids))[n]


def test_token_files(spark, odd, none, monkeypatch):
    path = new_folder(spark, "test")
    token_files.write_token_files(odd.repartition(3), path, WORD)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, path).collect())
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, want = 0, []
    for r, ids in zip(rows, library(WORD, [r.text or "" for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        want.append((at, r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    empty = new_folder(spark, "test")
    token_files.write_token_files(none, empty, WORD)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing_of_tiny_texts(spark):
    pieces = next(n for n in range(1, 600_000) if closes(n, n))
    assert pieces * (pieces // 2048) <= GROUP_ENTRIES and closes(2048, 256 * 2048) and not closes(2048, 256 * 2048 - 1)
    rows = pack(spark.range(50_000).selectExpr("id AS doc_id", "'' AS text").coalesce(1), "byte_bpe_50k.json").collect()
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append(r.offset)
    assert sorted(r.doc_id for r in rows) == list(range(50_000)) and len(fill) == 25
    assert all(sorted(at) == list(range(len(at))) and len(at) <= 2048 for at in fill.values())


def test_packing(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((((r.doc_id is None, r.doc_id or 0), [*ids, 1]) for r, ids in zip(rows, library(BYTE, [r.text or "" for r in rows]))))
    pieces = pack(odd.coalesce(1), BYTE).collect()
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        own = [ids for key, ids in want if key == (p.doc_id is None, p.doc_id or 0) and len(ids) == p.doc_tokens]
        assert any(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in own)
    for group in by_sequence.values():
        group.sort(key=lambda p: p.offset)
        assert [p.offset for p in group] == np.cumsum([0, *(p.length for p in group)])[:-1].tolist()
        assert sum(p.length for p in group) <= 2048
    assert pack(none, BYTE).count() == 0


def test_differencing_fills_windows():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 700):
        sizes = [rng.randint(1, 256) for _ in range(n)]
        part = assign(sizes)
        loads = np.bincount(part, weights=sizes) if n else np.zeros(0)
        assert len(part) == n and all(loads <= 2048)
        assert len(loads) <= sum(sizes) / 2048 * 1.02 + 2
    assert max(np.bincount(assign([2048, 2048, 1]), weights=[2048, 2048, 1])) == 2048
    assert assign([1500, 1500, 500, 500], 2000) in ([0, 1, 0, 1], [0, 1, 1, 0])
