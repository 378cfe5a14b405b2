"""Slopes of the two classifiers against finite differences of their losses, written out bag by bag."""

import math
import random

import numpy as np
import pytest

from folio.llm import quality_model, toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


@pytest.mark.parametrize("prior", [0.05, 0.95])  # the corrected term is above zero, and below it
def test_nnpu_slopes(prior):
    rng = random.Random(1)
    bags = [sorted(rng.sample(range(6), rng.randint(0, 4))) for _ in range(30)]
    is_p = np.arange(30) < 12
    w, b = np.array([rng.gauss(0, 1) for _ in range(6)]), 0.3
    bags.sort(key=lambda x: -sum(w[c] for c in x))  # the toxic texts score highest
    rows, cols = np.repeat(np.arange(30), [len(x) for x in bags]), np.array([c for x in bags for c in x])

    def terms(w, b):
        up = [sigmoid(b + sum(w[c] for c in x)) for x in bags]
        return 0.3 * sum(1 - u for u in up[:12]) / 12, 0.7 / (1 - prior) * (sum(up[12:]) / 18 - prior * sum(up[:12]) / 12)

    _, corrected = terms(w, b)
    risk = (lambda w, b: sum(terms(w, b))) if corrected >= 0 else (lambda w, b: -terms(w, b)[1])
    got, told = toxicity.nnpu_slopes(w, b, rows, cols, is_p, prior, 0.3)
    assert told * 0.7 / (1 - prior) == pytest.approx(corrected) and (corrected < 0) == (prior > 0.5)
    eps = 1e-6
    want = [(risk(w + eps * np.eye(6)[k], b) - risk(w - eps * np.eye(6)[k], b)) / (2 * eps) for k in range(6)] + [(risk(w, b + eps) - risk(w, b - eps)) / (2 * eps)]
    assert got == pytest.approx(want, abs=1e-7)


def loss(p, x, begin, label):
    out = 0.0
    for k, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
        h = [np.tanh(v @ p["E"] + p["e"]) for v in x[a:b]]
        raw = [math.exp(sum(np.tanh(v @ p["V"]) * np.array([sigmoid(t) for t in v @ p["U"]]) * p["w"])) for v in h]
        z = sum(r / sum(raw) * v for r, v in zip(raw, h, strict=True))
        y = sigmoid(z @ p["c"] + p["d"])
        out -= label[k] * math.log(y) + (1 - label[k]) * math.log(1 - y)
    return out / len(label)


def test_attention_slopes():
    rng = np.random.default_rng(3)
    begin, label = np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(0, 1, (9, 5))
    p = {"E": rng.normal(0, 1, (5, 4)), "e": rng.normal(0, 1, 4), "V": rng.normal(0, 1, (4, 3)), "U": rng.normal(0, 1, (4, 3)), "w": rng.normal(0, 1, 3), "c": rng.normal(0, 1, 4), "d": np.array(0.2)}
    got = quality_model._slopes(p, quality_model._forward(p, x, begin), label, begin)
    eps = 1e-6
    for name, value in p.items():
        want = np.zeros_like(value)
        for at in np.ndindex(value.shape):
            change = np.zeros_like(value)
            change[at] = eps
            want[at] = (loss(p | {name: value + change}, x, begin, label) - loss(p | {name: value - change}, x, begin, label)) / (2 * eps)
        assert np.asarray(got[name]) == pytest.approx(want, abs=1e-7), name


def test_empty_and_one_kind():
    assert toxicity.train_nnpu([], [np.array([0])], 3, 0.1, 0.3)[1] == -4.0
    assert toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -4.0).scores([np.zeros(0, int)])[0] < 0.1
    x, begin = quality_model.passages(np.zeros(0, np.uint8), np.array([0, 0]))
    assert x.shape == (1, quality_model.N_FEATURES) and not x.any()
    assert quality_model.train(np.repeat(x, 2, 0), np.array([0, 1, 2]), np.ones(2)).scores(x, begin)[0] > 0.9
