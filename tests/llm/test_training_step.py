"""A step of training against its plain form, and the work it takes."""

from __future__ import annotations

import numpy as np
from presswork.llm import lm

CLASSES = 40


def made(steps=5):
    """A model after a few steps on texts of 1, 2, 3, ... tokens, and a batch for the next one."""
    random = np.random.default_rng(3)
    n = np.arange(1, 30)
    classes = random.integers(0, CLASSES, n.sum()).astype(np.int32)
    model = lm.Bilinear.begun(np.arange(1.0, CLASSES + 1))
    batch = classes, model.contexts(classes, n), random.integers(0, CLASSES, lm.NOISE).astype(np.int32), random.normal(size=CLASSES).astype(np.float32)
    for _ in range(steps):
        model.step(*batch)
    return model, n, batch


def test_contexts_are_the_classes_before_by_columns_in_one_piece():
    model, n, (classes, context, _, _) = made(0)
    want = []
    for text in np.split(classes, np.cumsum(n)[:-1]):
        want += [[text[k - 1 - i] if i < k else CLASSES for i in range(lm.CONTEXT)] for k in range(len(text))]
    assert context.tolist() == want
    assert all(context[3:90, i].flags.c_contiguous for i in range(lm.CONTEXT))


def test_a_step_equals_its_plain_form():
    model, _, batch = made()
    classes, context, noise, log_noise = batch
    old = lm.Bilinear(CLASSES, model.flat.copy())
    h = sum(old.read[context[:, i]] * old.scale[i] for i in range(lm.CONTEXT))
    up = 1 / (1 + np.exp((h * old.made[classes]).sum(axis=1) + old.bias[classes] - log_noise[classes])) / len(classes)
    down = -1 / (1 + np.exp(-(h @ old.made[noise].T + old.bias[noise] - log_noise[noise]))) / len(classes)
    back = up[:, None] * old.made[classes] + down @ old.made[noise]
    gradients = {k: np.zeros_like(getattr(old, k), float) for k in ("read", "scale", "made", "bias")}
    np.add.at(gradients["made"], classes, up[:, None] * h)
    np.add.at(gradients["made"], noise, down.T @ h)
    np.add.at(gradients["bias"], classes, up)
    np.add.at(gradients["bias"], noise, down.sum(axis=0))
    for i in range(lm.CONTEXT):
        np.add.at(gradients["read"], context[:, i], back * old.scale[i])
        gradients["scale"][i] = (back * old.read[context[:, i]]).sum(axis=0)
    model.step(*batch)
    for name, gradient in gradients.items():
        seen = getattr(old, f"{name}_seen") + gradient**2
        assert np.allclose(getattr(model, f"{name}_seen"), seen, rtol=1e-4), name
        assert np.allclose(getattr(model, name), getattr(old, name) + lm.RATE * gradient / np.sqrt(seen), atol=1e-6), name


def test_a_step_sorts_each_list_of_classes_once_and_by_digits(monkeypatch):
    model, _, batch = made(0)
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(lm.np, "argsort", lambda a, **more: sorts.append(a.dtype.itemsize) or argsort(a, **more))
    model.step(*batch)
    assert sorts == [2, 2]
