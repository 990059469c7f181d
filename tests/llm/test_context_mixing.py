"""Scores of the context mixing model against a plain computation, a place and a bit at a time."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyfolio.llm import contextmix as cm
from tallyfolio.llm.common import Texts


def plain_log10(model, counters, w, p):
    total = 0.0
    for bit in range(8):
        symbol = w & 255
        value, node = symbol >> (7 - bit) & 1, (256 | symbol) >> (8 - bit)
        x, gate, inside = [], 0, True
        for i in range(1, 5):
            inside = inside and not cm._APART[w >> 8 * i & 255]
            gate += inside
        for o in range(cm.CONTEXTS):
            base = cm.bases_of(o, np.array([w], np.uint64), np.array([p], np.uint64))
            zero, one = counters[o][:, cm.slots_of(o, base, np.array([node], np.uint64), counters[o].shape[1])[0]].astype(float)
            x.append(math.log((one + cm.ALPHA) / (zero + cm.ALPHA)))
            if o in cm.STEPS:
                gate = gate * (len(cm.STEPS[o]) + 1) + sum(zero + one >= step for step in cm.STEPS[o])
        s = max(-16, min(16, sum(a * b for a, b in zip(model.weights[gate], [*x, 0.3], strict=True))))
        at = (max(-8, min(8, s)) + 8) * (cm.LEVELS - 1) / 16
        low = min(int(at), cm.LEVELS - 2)
        row = node * cm.LEVELS + low
        q = (1 / (1 + math.exp(-s)) + model.map[row] * (1 - at + low) + model.map[row + 1] * (at - low)) / 2
        total += math.log10(q if value else 1 - q)
    return total


def test_score_of_places():
    rng = np.random.default_rng(1)
    counters = [rng.integers(0, 9, (2, s)).astype(np.float32) for s in (1 << 16, 1 << 10, 1 << 10, 1 << 10, 1 << 10)]
    model = cm.Model(counters)
    model.weights = rng.normal(0.3, 0.2, model.weights.shape)
    model.set_map(rng.random(256 * cm.LEVELS) * 50, np.full(256 * cm.LEVELS, 60.0))
    texts = Texts(pa.array(["The cat sat on the mat, the Ünd and 日本.", "", "x", " \n a"]))
    w, p = cm.windows(texts)[0], cm.prefixes(texts)
    want = [plain_log10(model, counters, int(a), int(b)) for a, b in zip(w, p, strict=True)]
    np.testing.assert_allclose(model.log10(w, p), want, rtol=1e-4)
    np.testing.assert_allclose(model.frozen().log10(w, p), want, rtol=1e-4)
    cache = cm.Cache(model.frozen(), 1 << 4)  # far fewer slots than places
    for _ in range(3):
        np.testing.assert_allclose(cache.log10(w, p), want, rtol=1e-4)
    of = cm.windows(texts)[1]
    for _ in range(3):
        np.testing.assert_allclose(cache.texts(texts), np.bincount(of, want, texts.n), rtol=1e-4)


def hostile_texts():
    rng = random.Random(3)
    some = ["".join(rng.choice("aB \n,é") for _ in range(rng.randrange(60))) for _ in range(80)]
    return [None, "", " ", "\t\n  ", "a", " a", "a ", *some, *some[:30], "x" * 5000, " " * 3000, "to be or " * 700, "end of Text", "ENd of text", "日本 語"]


def test_stretches_give_every_place():
    texts = hostile_texts()
    want = Counter()
    t = Texts(pa.array(texts))
    for w, p in zip(cm.windows(t)[0].tolist(), cm.prefixes(t).tolist(), strict=True):
        want[w, p] += 1
    for size, long, step in ((1 << 12, 32, 200), (16, 32, 7), (64, 3, 1), (1 << 12, 0, 40)):
        met, got = cm.Met(size, long), Counter()
        for lo in range(0, len(texts), step):
            for some in met.add(Texts(pa.array(texts[lo : lo + step], pa.string()))):
                for w, p, n in zip(*some, strict=True):
                    got[int(w), int(p)] += int(n)
        for some in met.last():
            for w, p, n in zip(*some, strict=True):
                got[int(w), int(p)] += int(n)
        assert got == want
    assert list(cm.Met().add(Texts(pa.array([], pa.string())))) == []


def test_cache_is_kept_for_one_model():
    counters = [np.ones((2, s), np.float32) for s in (1 << 16, 16, 16, 16, 16)]
    one = cm.cache_of("one", cm.Model(counters))
    assert cm.cache_of("one", cm.Model(counters)) is one and cm.cache_of("two", cm.Model(counters)) is not one
    assert list(cm._KEPT) == ["two"]


def test_a_worker_learns_without_holding_the_counts():
    rng = np.random.default_rng(1)
    counts = [rng.integers(0, 9, (2, 64)).astype(np.float32) for _ in range(cm.CONTEXTS)]
    want = [cm._predictions(o, c, ((1, 0), (0, 1))) for o, c in enumerate(counts)]
    model = cm.Model(counts)
    cm._KEPT.clear()
    own = cm.learner("a", model)
    assert not model.counters and own.sizes == [64] * cm.CONTEXTS
    for a, b in zip(own.spared, want, strict=True):
        np.testing.assert_array_equal(a, b)
    cm._KEPT.clear()
    assert len(cm.learner("a", model).spared) == cm.CONTEXTS  # asked for again by another task
    cm._KEPT.clear()
