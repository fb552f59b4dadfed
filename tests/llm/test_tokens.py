"""Token ids against the plain library: whole table, machine-made texts, special strings."""

import random
import zlib

import numpy as np
import pytest

from barloom.llm import queries, tokens
from barloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "HALİ, evet", "a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y, <|endoftext|>\n<|endoftext|>", "İ. İ, i̇. ΑΣ. ΑΣ, ΌΣΟΣ",
       "á, é.", "\x02", "a \x02 b", "a\x02b, c", "don't. we'll, I'M.", "a.b,c. d ,e .f", "1,000.5, 3.", "ab cd ef", "‍. x‍,",
       "ŉ. ǰ, ẖ. ß. ﬁ, Å.", "日本. 語, 。", "\U0001f600. \U0001f468‍\U0001f469,", "\r\n\t x", "a  b", "<|endoftext", "|endoftext|>"]
SIGNS = [*"abzAZİΣßı.,'!? \n\t́̇\x02é1920<|>-_", " ", " ", "<|endoftext|>", "ing", "the ", " "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    from tokenizers import Tokenizer
    path = queries.tokenizer(name)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices(SIGNS, k=rng.randrange(1, 40))) for _ in range(6000)]
    for i in range(0, len(texts), 97):
        part = texts[i:i + 97]
        want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        for t, a, b in zip(part, own.encode(part), want):
            assert a == b, repr(t)


class Counted(dict):
    """Counts what is looked up."""
    n = 0

    def get(self, *a):
        self.n += 1
        return super().get(*a)

    def __getitem__(self, k):
        self.n += 1
        return super().__getitem__(k)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_looked_up_once_a_call(name):
    own = tokens.Encoder(queries.tokenizer(name))
    texts = ["Alpha beta, gamma\nalpha" + " beta, gamma." * 500, "beta, " * 200 + "end"]
    want = own.library(texts)
    assert own.encode(texts) == want
    own.known = Counted(own.known)
    assert own.encode(texts) == want and own.known.n <= 10


def test_white_space_that_goes_to_the_library():
    own = tokens.Encoder(queries.tokenizer("byte_bpe_50k.json"))
    space = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    texts = ["a" + c + "b" for c in space] + ["", "a", "a b\nc", " a", "a ", "\na", "a\n", "a  b", "a \nb", "a\n\nb", "a<|endoftext|>b"]
    assert own.odd(tokens.pa.array(texts)) == [c not in " \n" for c in space] + [False] * 3 + [True] * 8


def test_pieces_and_their_places(spark):
    """Every id of every document is in one piece, sequences have no gap, and only documents over the limit are cut."""
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    got = queries.op9_best_fit_packing(spark, SMALL).collect()
    by, room = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    docs = table(spark, SMALL, "documents").collect()
    assert set(by) == {r.doc_id for r in docs}
    for r in docs:
        ids = np.asarray([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        cut = [ids[i:i + 4096] for i in range(0, len(ids), 4096)]
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in sorted(by[r.doc_id], key=lambda p: p.piece)] == [
            (k, 4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)]
    for places in room.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(room) <= -(-sum(r.length for r in got) // 4096) * 1.01 + 1
