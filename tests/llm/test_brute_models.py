"""Models of the operators against plain versions: a likelihood by hand, exact sets instead of filters, true similarities."""

import math
import random

import numpy as np

from plumbline.llm import fingerprint, langid, quality
from plumbline.llm.blocks import ALNUM
from tests.llm import brute


def test_training_finds_the_likelihood_s_peak():
    """The fitted model is no worse than what small steps in any direction give, by a likelihood written out by hand."""
    rng = random.Random(2)
    rows = [([rng.randrange(6) for _ in range(3)], rng.randrange(3)) for _ in range(60)]
    feature = np.array([f for fs, _ in rows for f in fs])
    value, bounds = np.full(len(feature), 0.5), np.arange(61) * 3
    grade = np.array([g for _, g in rows])
    model = quality.train(feature, value, bounds, grade, 3, steps=2000, rate=0.05, decay=0.0)

    def loss(weights, cuts):
        total = 0.0
        for fs, g in rows:
            score = sum(0.5 * weights[f] for f in fs)
            below = [0.0, *(1 / (1 + math.exp(-(c - score))) for c in cuts), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / len(rows)

    weights, cuts = model.weights[:6].copy(), model.thresholds.copy()
    best = loss(weights, cuts)
    for k in range(6):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += step
            assert loss(moved, cuts) >= best - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = cuts.copy()
            moved[k] += step
            assert loss(weights, moved) >= best - 1e-6
    chance = model.above(np.array([0.3]))[0]
    assert np.allclose(chance, [1 / (1 + math.exp(c - 0.3)) for c in model.thresholds])


def test_filters_decide_like_exact_sets():
    """Grams, popcounts and decisions of small texts by sets of byte strings."""
    rng = random.Random(4)
    letters = {"x": "abcdef", "y": "cdefgh", "z": "uvwxyz"}
    known = {lang: [" ".join("".join(rng.choices(abc, k=5)) for _ in range(30)) for _ in range(12)] for lang, abc in letters.items()}

    def grams(text):
        folded = bytes(langid.LETTERS[np.frombuffer(text.encode(), np.uint8)])
        line = b"\0" + folded + b"\0" * (max(langid.ORDERS) - 1)
        out = []
        for n in langid.ORDERS:
            out += [(n, line[k : k + n]) for k in range(len(line) - n + 1) if any(line[k : k + 2])]
        return out

    sets = {lang: {g for t in texts for g in grams(t)} for lang, texts in known.items()}
    model = langid.Model(tuple(letters), np.zeros((1, 1 << 20), np.uint64), 2)
    for k, texts in enumerate(known.values()):
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            for at in langid.slot_numbers(langid.grams_of(data, np.array([0, len(data)]))[0], 2, 1 << 20):
                model.slots[0, at] |= np.uint64(1 << k)
    wrong = model.false_positive()
    for lang, abc in letters.items():
        text = " ".join("".join(rng.choices(abc, k=5)) for _ in range(20))
        data = np.frombuffer(text.encode(), np.uint8)
        counts, total = langid.tally(model, data, np.array([0, len(data)]))
        exact = [sum(g in s for g in grams(text)) for s in sets.values()]
        assert total[0] == len(grams(text)) and np.abs(counts[0] - exact).max() <= 2
        said, score = langid.decide(model, wrong, counts, total, np.array([True]))
        assert said == [lang] and abs(score[0] - max(exact) / len(grams(text))) < 0.02
    tie = langid.decide(model, np.zeros(3), np.array([[5, 5, 5]]), np.array([10]), np.array([True]))
    assert tie[0] == ["x"] and tie[1][0] == 0.5


def test_collision_rate_is_the_generalised_jaccard():
    """Over many samples the share of equal ones comes near to the similarity of the word counts."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(12):
        a = rng.choices(words, k=80)
        b = [w if rng.random() < rng.choice([0.5, 0.8, 0.95]) else rng.choice(words) for w in a]
        texts += [" ".join(a), " ".join(b)]
    samples = 1500
    made = fingerprint.sample([t.encode() for t in texts], samples)
    for k in range(0, 24, 2):
        x, y = (brute.words(t) for t in texts[k : k + 2])
        every = set(x) | set(y)
        true = sum(min(x.count(w), y.count(w)) for w in every) / sum(max(x.count(w), y.count(w)) for w in every)
        assert abs((made[k] == made[k + 1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / samples) + 0.01
    assert ALNUM[ord("A")] == ord("a")
