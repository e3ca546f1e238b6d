"""Passes of the recurrent language model: gradients, wide logits, memory of a window."""

import tracemalloc

import numpy as np
import pytest

from herdsignal.llm import recurrent_lm as R


def known(top):
    return R.Vocabulary(2000, 500, 10, np.arange(top, dtype=np.uint64), np.arange(top, 0, -1), np.full(R.TAILS, 5), np.full(R.TAILS, 2))


def plain(p, vocabulary, before, codes, here, h):
    """Log-probability of all codes, word by word in doubles."""
    total, s = 0.0, R.STATE
    for lane in range(before.shape[1]):
        state = h[lane].astype(float)
        for t in range(len(before)):
            x, u = p["inputs"][before[t, lane]] + p["bias"], state @ p["state"]
            z, r = (1 / (1 + np.exp(-(x + u)[i * s : (i + 1) * s])) for i in (0, 1))
            new = np.tanh(x[2 * s :] + r * u[2 * s :])
            state = new + z * (state - new)
            if not here[t, lane]:
                continue
            code = int(codes[t, lane])
            logits = state @ p["heads"] + p["head_bias"]
            head = 0 if code < 0 else vocabulary.first_tail + code - R.TOP if code >= R.TOP else 1 + code // R.MEMBERS
            total += logits[head] - np.logaddexp.reduce(logits)
            if 0 <= code < R.TOP:
                within = state @ p["members"][code // R.MEMBERS] + p["member_bias"][code // R.MEMBERS]
                total += within[code % R.MEMBERS] - np.logaddexp.reduce(within)
    return total


@pytest.mark.parametrize("wide", [1, 60])
def test_losses_and_steps_match_plain_formulas(wide):
    rng = np.random.default_rng(4)
    vocabulary = known(70)
    net = R.Network(vocabulary)
    for name in ("heads", "members"):
        net.p[name] *= wide  # the wide ones leave the bound within which no row's largest logit is taken off
    texts = [rng.choice(np.r_[np.arange(70), R.TOP + np.arange(R.TAILS)], n).astype(np.uint16) for n in (6, 6, 3)]
    ((_, before, codes, here, live),) = R.lanes(texts)
    h = rng.uniform(-1, 1, (live, R.STATE)).astype(np.float32)
    assert all((r < R.REACH) == (wide == 1) for r in net.ready().reach)
    p = {name: value.astype(float) for name, value in net.p.items()}
    flat = np.flatnonzero(here)
    score, _ = net.loss(net.forward(before, h).reshape(-1, R.STATE)[flat], codes.ravel()[flat])
    assert score.sum() == pytest.approx(plain(p, vocabulary, before, codes, here, h), rel=1e-4)
    net.learn(before, codes, here, h, {})
    for name, value in p.items():
        moved = net.p[name] - value
        for place in np.argsort(-abs(moved), axis=None)[[0, 1, 5]].tolist():
            at, sides = np.unravel_index(place, value.shape), []
            for change in (1e-4, -1e-4):
                value[at] += change
                sides.append(plain(p, vocabulary, before, codes, here, h))
                value[at] -= change
            slope = np.clip((sides[1] - sides[0]) / 2e-4 / live, -5, 5)
            assert moved[at] == pytest.approx(-R.STEP * slope / np.sqrt(0.05 + slope**2), rel=0.02, abs=2e-5), name


def test_a_window_uses_the_memory_of_the_one_before():
    rng = np.random.default_rng(4)
    net, sums = R.Network(known(R.TOP)), {}
    ((_, before, codes, here, live),) = R.lanes([rng.integers(0, R.TOP + R.TAILS, R.WINDOW - 1).astype(np.uint16)] * R.LEARNERS)
    h = np.zeros((live, R.STATE), np.float32)
    net.learn(before, codes, here, h, sums)
    tracemalloc.start()
    net.learn(before, codes, here, h, sums)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 6 << 20  # 15 MB before, taken and given back in each window
