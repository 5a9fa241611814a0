import re

import numpy as np

from tidemark.llm._words import ALNUM, LOWER, SPACED, Words, grams, within


def test_words_of_texts():
    texts = ["a b", "", "  a\tb\x0bc ", "é b", "x" * 3000, "a b"]
    found = Words([t.encode() for t in texts], SPACED, block=64)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(found.bounds).tolist() == [len(w) for w in want]
    names = {}
    for h, w in zip(found.hashes.tolist(), [x for w in want for x in w], strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_lowered_words():
    text = "It's THE-end 3x ÉÀ ñ"
    found = Words([text.encode().translate(LOWER)], ALNUM)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert len(found) == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def test_grams_and_borders():
    h = np.arange(1, 40, dtype=np.uint64) ** 3
    for n in (1, 2, 3, 5, 12, 13, 20, 39, 40):
        got = grams(h, n)
        assert len(got) == max(0, 40 - n) and len(np.unique(got)) == len(got)
        if len(got) > 4:
            assert grams(h[3 : 3 + n], n)[0] == got[3]
    assert within(np.array([0, 3, 3, 7]), 3, 7).tolist() == [True, False, False, True, True]
    assert len(Words([], SPACED)) == 0
