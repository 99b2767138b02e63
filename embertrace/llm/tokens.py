"""Token ids of whole texts, exactly as the tokenizers library gives them.

A byte-pair vocabulary is a list of merges; which tokens a piece of text becomes follows from their order
alone. The merges of a tokenizer's file are handed to a second public implementation of the same rule that
takes a whole text at once and returns an array, which spares an object for every piece and token. Texts for
which the two are not known to split alike (strings of special tokens, characters whose normal form or class
depends on the Unicode version, runs too long for a pattern) go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import tiktoken

# How the two kinds of pretokeniser split text.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = "\x01"  # closes each word of the kind that drops white space
# Characters that are their own normal form alone and beside each other, and of one class in all Unicode
# versions: Latin, Greek without final sigma, Cyrillic, punctuation, kana, CJK ideographs, Hangul syllables.
STABLE = re.compile(
    "[\x00\x02-˿Ͱ-ͳ͵-ͷͻ-ͽΈ-ΊΌΎ-ΡΤ-ρσ-҂Ҋ-ԯ"
    "‐-‧‰-⁞₠-₽　-〩ぁ-ゖァ-ヺ一-鿕가-힣]*")


SPACE, LETTER, NUMBER, OTHER = range(4)


def _kinds() -> np.ndarray:
    """The kind of each character below U+10000."""
    named = {"L": LETTER, "N": NUMBER}
    kinds = np.array([named.get(unicodedata.category(chr(c))[0], OTHER) for c in range(1 << 16)], np.uint8)
    kinds[[ord(c) for c in WHITE]] = SPACE
    return kinds


_KINDS: list[np.ndarray] = []


def closed_words(text: str) -> str:
    """``text`` without white space, each of its words (runs of letters, single numbers, runs of other
    characters, contractions that begin such a run) closed by a mark."""
    if not _KINDS:
        _KINDS.append(_kinds())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _KINDS[0][codes]
    ends = np.ones(len(codes), bool)
    ends[:-1] = (kinds[1:] != kinds[:-1]) | (kinds[:-1] == NUMBER)
    at = text.find("'")
    while at >= 0:
        if at == 0 or kinds[at - 1] != OTHER:
            for short in CONTRACTIONS:
                if text.startswith(short, at):
                    ends[at] = False
                    ends[at + 1 : at + len(short)] = False
                    ends[at + len(short) - 1] = True
                    break
        at = text.find("'", at + 1)
    kept = kinds != SPACE
    ends &= kept
    out = np.full(int(kept.sum() + ends.sum()), ord(MARK), np.uint32)
    out[(np.cumsum(kept) + np.cumsum(ends) - ends - 1)[kept]] = codes[kept]
    return out.tobytes().decode("utf-32-le")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, "Encoder"] = {}


def encoder(name: str) -> "Encoder":
    """The worker's encoder of one tokenizer file; loaded once per worker process."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(vocabulary(name))
    return _LOADED[name]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge_ranks(vocab: dict[str, int], merges: list, suffix: str) -> tuple[dict[bytes, int], np.ndarray]:
    """(bytes of each token -> the order in which it is made, the token id of each place in that order).
    A suffix, which closes words, is written as one byte behind them and joins the last byte before all else."""
    letters = byte_letters()
    bytes_of = {letter: b for b, letter in letters.items()}
    ranks: dict[bytes, int] = {}
    ids: list[int] = []

    def add(raw: bytes, token: str) -> None:
        if raw not in ranks:
            ranks[raw] = len(ids)
            ids.append(vocab.get(token, 0))

    mark = MARK.encode()
    for b, letter in letters.items():
        add(bytes([b]), letter)
    if suffix:
        for b, letter in letters.items():
            if bytes([b]) != mark:
                add(bytes([b]) + mark, letter + suffix)
    for merge in merges:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        token = left + right
        plain = token.removesuffix(suffix) if suffix else token
        add(bytes(bytes_of[c] for c in plain) + (mark if plain != token else b""), token)
    return ranks, np.array(ids, np.uint32)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.special = [t["content"] for t in kind["added_tokens"]]
        # A byte-level pretokeniser gives a single space to the word after it; the other kind drops white space.
        self.keeps_space = kind["normalizer"] is None and kind["pre_tokenizer"]["type"] == "ByteLevel"
        ranks, self.ids = merge_ranks(kind["model"]["vocab"], kind["model"]["merges"], kind["model"].get("end_of_word_suffix") or "")
        pattern = SPACED if self.keeps_space else f"[^{MARK}]*{MARK}"
        self.pairs = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _prepared(self, text: str) -> str | None:
        """The text as the merges take it; None if the library has to encode it."""
        if any(s in text for s in self.special):
            return None
        if self.keeps_space:
            return text
        if MARK in text or not (text.isascii() or STABLE.fullmatch(text)):
            return None
        return closed_words(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole = []
        for i, text in enumerate(texts):
            prepared = self._prepared(text)
            if prepared is None:
                whole.append(i)
                continue
            try:
                out[i] = self.ids[self.pairs.encode_to_numpy(prepared, disallowed_special=())].astype("<u4").tobytes()
            except ValueError:  # a run of white space that the pattern can't hold
                whole.append(i)
        if whole:
            for i, got in zip(whole, self.lib.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = np.array(got.ids, "<u4").tobytes()
        return out
