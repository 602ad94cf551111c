"""Messages of the skip-chain field against enumeration, and labels that travel along mentions."""

import itertools
import random

import numpy as np

from fleetpulse.llm import pii


def enumerated(field, rows, chain, skip):
    """Marginals from the weight of every labelling."""
    own = field.unary[np.array(rows)].sum(axis=1)
    out = np.zeros((len(rows), pii.L))
    for labels in itertools.product(range(pii.L), repeat=len(rows)):
        score = sum(own[i, a] for i, a in enumerate(labels))
        score += sum(field.chain[labels[i], labels[j]] for i, j in chain) + sum(field.skip[labels[i], labels[j]] for i, j in skip)
        out[range(len(rows)), labels] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_without_loops_are_exact():
    rng = np.random.default_rng(4)
    for chain, skip in [([], []), ([(0, 1), (1, 2), (2, 3), (3, 4)], []), ([(0, 1), (3, 4)], [(1, 3), (2, 3)]), ([], [(0, 4), (1, 4), (2, 4), (3, 4)])]:
        field = pii.Field()
        field.unary, field.chain, field.skip = rng.normal(size=(20, pii.L)), rng.normal(size=(pii.L, pii.L)), rng.normal(size=(pii.L, pii.L))
        rows = rng.integers(0, 20, size=(5, 3)).tolist()
        assert np.allclose(field.marginals(rows, chain, skip), enumerated(field, rows, chain, skip), atol=1e-3)


def test_components_are_reached_over_links():
    rnd = random.Random(1)
    for _ in range(50):
        n = rnd.randint(1, 12)
        links = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(rnd.randint(0, n))}) if n > 1 else []
        want = list(range(n))
        for _ in range(n):
            for i, j in links:
                want[i] = want[j] = min(want[i], want[j])
        assert pii.components(n, links) == want


def test_every_later_mention_takes_the_label():
    """One base phone and twelve bare mentions of its digits: a label that skip links carry reaches all."""
    field = pii.Field()
    field.skip[:] = np.eye(pii.L) * 6.0
    digits = "4155550123"
    text = "call +14155550123 now. " + " ".join(f"again {digits} or so." for _ in range(12))
    tokens = pii.tokens_of(text)
    base = pii.base_spans(text)
    y = pii.truth(tokens, base)
    rows = [pii.features(text, t) for t in tokens]
    phone = pii.KINDS.index("phone") + 1
    for f, label in zip(rows, y):
        if label:
            field.unary[f, label] = 3.0
    _, spans = pii.all_spans(text, field)
    of = pii.components(len(tokens), pii.skip_links(text, tokens))
    reached = {of[i] for i, label in enumerate(y) if label}
    linked = [tokens[i] for i in range(len(tokens)) if not y[i] and of[i] in reached]
    assert len(linked) == 12 and set(spans) >= {(phone - 1, *t) for t in linked}
