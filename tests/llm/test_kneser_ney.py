"""The language models against interpolated Kneser-Ney over plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from textquarry.llm.language_id import ORDER, Models, symbols

PAD = "\x02"


def plain_symbols(text):
    out = ""
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or not out.endswith(" "):
            out += c
    return out


class Plain:
    def __init__(self, texts):
        """One language's counts: raw for the longest grams, distinct contexts for the others."""
        self.counts = {ORDER: Counter()}
        for text in texts:
            padded = PAD * (ORDER - 1) + plain_symbols(text)
            for i in range(ORDER - 1, len(padded)):
                self.counts[ORDER][padded[i - ORDER + 1 : i + 1]] += 1
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, counts in self.counts.items():
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            self.discount[n] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
            self.total[n], self.kinds[n] = defaultdict(int), defaultdict(int)
            for gram, c in counts.items():
                self.total[n][gram[:-1]] += c
                self.kinds[n][gram[:-1]] += 1

    def probability(self, gram, alphabet):
        if not gram:
            return 1 / alphabet
        n, before = len(gram), gram[:-1]
        less = self.probability(gram[1:], alphabet)
        total = self.total[n].get(before, 0)
        if not total:
            return less
        d = self.discount[n]
        return (max(self.counts[n][gram] - d, 0) + d * self.kinds[n][before] * less) / total


def drawn(seed, letters, n):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_probabilities_equal_plain_ones(seed):
    texts = {
        "aa": drawn(seed, "abcd eE1.", 30),
        "bb": drawn(seed + 50, "abxy zé", 12),
        "cc": drawn(seed + 90, "中文字 a", 5) + [""],
    }
    models = Models(texts)
    plain = {k: Plain(v) for k, v in texts.items()}
    alphabet = len({g for p in plain.values() for g in p.counts[1]}) + 1
    tried = drawn(seed + 7, "abcdexyzé 中ß?", 40) + ["", "   ", "12"]
    raw = [t.encode() for t in tried]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    codes, owner = symbols(data, ends)
    at = np.flatnonzero(codes != ord(PAD))
    bits = models.bits(codes, at)
    want = [
        [
            math.log2(plain[k].probability("".join(map(chr, codes[i - ORDER + 1 : i + 1])), alphabet))
            for k in models.languages
        ]
        for i in at
    ]
    assert bits == pytest.approx(np.array(want), abs=2e-4)
    entropy, n = models.cross_entropy(data, ends)
    for k, text in enumerate(tried):
        own = plain_symbols(text)
        assert n[k] == (len(own) if own.strip() else 0)
        if n[k]:
            mine = np.array([w for w, i in zip(want, at, strict=True) if owner[i] == k])
            assert entropy[k] == pytest.approx(-mine.mean(0), abs=2e-4)


def test_the_lowest_entropy_names_the_language():
    texts = {"aa": drawn(1, "abcd ", 80), "bb": drawn(2, "cdxy ", 80)}
    models = Models(texts)
    models.calibrate({"aa": drawn(3, "abcd ", 20), "bb": drawn(4, "cdxy ", 20)})
    tried = drawn(5, "abcd ", 20) + drawn(6, "cdxy ", 20) + ["", "..", "ßßßßßßßßß" * 40]
    raw = [t.encode() for t in tried]
    found = models.predict(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    plain = {k: Plain(v) for k, v in texts.items()}
    alphabet = len({g for p in plain.values() for g in p.counts[1]}) + 1
    for k, text in enumerate(tried[:40]):
        padded = PAD * (ORDER - 1) + plain_symbols(text)
        loss = {
            name: -sum(math.log2(p.probability(padded[i - ORDER + 1 : i + 1], alphabet))
                       for i in range(ORDER - 1, len(padded)))
            for name, p in plain.items()
        }
        if text.strip():
            assert found[0][k] == min(loss, key=loss.get)
    assert list(found[0][40:42]) == ["und", "und"] and list(found[3][40:]) == [True, True, True]
