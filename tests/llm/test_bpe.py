import random

import numpy as np
import pytest

from splitlift.llm import bpe as B
from splitlift.llm._vocab import default_vocabulary

from llm_fixtures import make  # noqa: F401

PATH = default_vocabulary()
TEXTS = ["", None, "<|endoftext|>hi <|endoftext|> x's you'll  \n\n  a\t\tb   x ²³ Ⅷ 1½ عربي 中文字 😀 é don't 'S \x1c\x85 _a_b__c  ",
         "x" * 3000, " " * 2000 + "a", "naïve Ünïcode café's", "a\r\nb", "'s'll'x", "<|endoftext|>"]


@pytest.fixture(scope="module")
def vocabulary():
    return B.ByteBpe(B.read_vocabulary(PATH))


def test_round_trip_equals_the_library(make, vocabulary):
    tk = vocabulary.tokenizer
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "x" * 3000)]
    got = B.bpe_decode(B.bpe_encode(make(rows), PATH, limit=50, buckets=3), PATH).collect()
    assert len(got) == len(rows)
    want = sorted(((i, tk.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == want
    for _, ids, t in want:
        assert tk.decode(ids, skip_special_tokens=False) == t


def test_one_block_and_many_blocks_agree(make):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["ab", "cd", "é", "it's", "x1"]) for _ in range(rnd.randint(0, 50))))
            for i in range(60)]
    one = B.bpe_digest(B.bpe_decode(B.bpe_encode(make(rows), PATH), PATH))
    many = B.bpe_digest(B.bpe_round_trip(make(rows), PATH, limit=40, buckets=2))
    assert sorted(one.collect()) == sorted(many.collect())


def _fast(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    cuts = [*np.flatnonzero(B.word_starts(raw, np.array([0, len(raw)]))).tolist(), len(raw)]
    return [text.encode()[a:b].decode() for a, b in zip(cuts, cuts[1:])]


def test_fast_split_of_every_usual_character(vocabulary):
    for c in map(chr, range(0x400)):
        if not B._OTHER.search(c):
            for t in (f"a{c}b 1{c}2 {c} !{c}  {c}{c}{c}'s", f"{c}{c} {c}\n{c}"):
                assert _fast(t) == vocabulary.words(t), (c, t)


def test_fast_split_of_random_texts(vocabulary):
    rnd = random.Random(1)
    parts = ["a", "s", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "1", "!", "é", "l", "v", "e", "'v"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        assert _fast(t) == vocabulary.words(t), t


def test_empty_table(make):
    assert B.bpe_decode(B.bpe_encode(make([]), PATH), PATH).collect() == []


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        B.ByteBpe(B.read_vocabulary(default_vocabulary("word_bpe_49k.json")))
