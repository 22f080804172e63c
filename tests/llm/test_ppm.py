import math
import zlib
from collections import Counter

import odd
import pytest

from cleansheet.llm import ppm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trained_on(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 != 2


def stream(text):
    return [ppm.START] * ppm.ORDER + list((text or "").translate(LOWER).encode()) + [ppm.END]


class Reference:
    """The model written down plainly, one dictionary of followers for each context."""

    def __init__(self, texts):
        self.follow = {}
        for text in texts:
            s = stream(text)
            for i in range(ppm.ORDER, len(s)):
                self.follow.setdefault(tuple(s[i - ppm.ORDER : i]), Counter())[s[i]] += 1
        for k in range(ppm.ORDER, 0, -1):
            for context in [c for c in self.follow if len(c) == k]:
                for symbol in self.follow[context]:
                    self.follow.setdefault(context[1:], Counter())[symbol] += 1

    def chance(self, context, symbol):
        out, ruled_out = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            known = self.follow.get(tuple(context[len(context) - k :]))
            if not known:
                continue
            left = {s: n for s, n in known.items() if s not in ruled_out}
            if not left:
                continue
            total = 2 * sum(left.values())
            if symbol in left:
                return out * (2 * left[symbol] - 1) / total
            out *= len(left) / total
            ruled_out |= set(known)
        return out / (ppm.SYMBOLS - len(ruled_out))

    def score(self, text):
        s, total, past = stream(text), 0.0, {}
        for i in range(ppm.ORDER, len(s)):
            chance = self.chance(s[i - ppm.ORDER : i], s[i])
            own = tuple(s[i - ppm.LOCAL : i]) if i >= ppm.LOCAL else None
            if own in past:
                foreseen, often = past[own]
                often *= ppm.LOCAL_ESCAPE
                if foreseen == s[i]:
                    chance = 1 - 1 / often
                else:
                    chance *= 1 / often / (1 - self.chance(s[i - ppm.ORDER : i], foreseen))
            if own:
                past[own] = (s[i], past.get(own, (0, 0))[1] + 1)
            total += math.log10(chance)
        return total


def tokens(text):
    for c in "\t\n\x0b\f\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.translate(LOWER).split(" ") if w] + [None]


ROWS = [r for r in odd.texts() if r[0] not in (11, 12)] + [(30 + d, odd.prose(d % 9, 25) + ". " + odd.prose(d, 30)) for d in range(25)]


@pytest.mark.parametrize("entries", [1_000_000, 900])
def test_against_plain_model(spark, entries):
    got = ppm.score_documents(odd.frame(spark, ROWS), part_entries=entries).collect()
    assert len(got) == len(ROWS)
    train = [t for d, t in ROWS if trained_on(d)]
    model, count = Reference(train), Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(d), not trained_on(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6), round(model.score(t), 2)) for d, t in ROWS)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6), round(r["score"], 2)) for r in got)
    for a, b in zip(have, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 0.05, (a, b)


def test_chances_sum_to_one():
    model = Reference(["the thing", "thin ice"])
    for context in (stream("thi")[-ppm.ORDER - 1 : -1], [1] * ppm.ORDER):
        assert abs(sum(model.chance(context, s) for s in range(256)) - 1) < 1e-9


def test_nothing_to_learn_from_and_empty_table(spark):
    held = next(d for d in range(100) if not trained_on(d))
    row = ppm.score_documents(odd.frame(spark, [(held, "ab")])).first()
    assert (row["n_known"], row["train_tokens"], row["n_tokens"]) == (0, 0, 2)
    assert abs(row["score"] + 3 * math.log10(256)) < 1e-4 and row["base_score"] == 0
    assert ppm.score_documents(odd.frame(spark, [])).count() == 0
