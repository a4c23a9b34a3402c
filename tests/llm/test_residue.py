import random
import tracemalloc

import numpy as np

from pagemill.llm import residue


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice("amber birch cloud 12 dune élan lorem ipsum".split()) for _ in range(r.randint(0, 40))) for _ in range(n)]


def models(seed):
    return tuple(residue.CharModel().add(texts(seed + k, 50), 1 + k) for k in range(3))


def log_prob(model, slots, strength=4.0):
    """One model over all positions at once, by the definition."""
    p = (model.counts[0][slots[0]] + 0.02 * strength) / (model.total + 20 * strength)
    for k in range(1, residue.ORDER):
        before = np.concatenate([model.counts[k - 1][:1], model.counts[k - 1][slots[k - 1]][:-1]])
        p = (model.counts[k][slots[k]] + strength * p) / (before + strength)
    return np.log(np.maximum(p, 1e-12))


def test_steps_of_scoring_leave_no_trace(monkeypatch):
    codes, starts = residue._codes(texts(3, 60))
    whole = residue._slots(codes)
    now, seeds = models(10), models(20)
    want = [[np.concatenate([[0.0], np.cumsum(log_prob(m, whole) - log_prob(three[2], whole), dtype=np.float64)]) for m in three[:2]] for three in (now, seeds)]
    scored = residue.block_scores(np.array(want[0]), starts)
    for near in (1, 7, len(codes) - 1, len(codes), 1 << 16):
        monkeypatch.setattr(residue, "NEAR", near)
        slots = residue._slots(codes)
        assert all((a == b).all() for a, b in zip(slots, whole))
        got = residue.Beside(now, seeds).ratios(slots)
        assert (got == np.array(want)).all() and (residue.Beside(now).ratios(slots) == got[:1]).all()
        assert residue.block_scores(got[0], starts) == scored
    none = residue.Beside(now).ratios(residue._slots(residue._codes([])[0]))
    assert none.shape == (1, 2, 1) and residue.block_scores(none[0], np.array([0])) == []


def test_windows_end_with_their_block():
    fills = residue._plain("lorem ipsum dolor sit amet consectetur adipiscing elit")
    filler, prose = residue.CharModel().add([fills], 50), residue.CharModel().add(texts(5, 50), 9)
    blocks = [fills, "", "amber birch cloud dune", "x", fills]
    codes, starts = residue._codes(blocks)
    ratios = residue.Beside((filler, residue.CharModel(), prose)).ratios(residue._slots(codes))[0]
    scores = residue.block_scores(ratios, starts)
    assert [s[1] for s in scores] == list(map(len, blocks))
    half = residue.WINDOW // 2
    for (hit, n, fill, note), a, b in zip(scores, starts[:-1] + residue.ORDER - 1, starts[1:]):
        at = [(max(i - half, a), min(i + half, b)) for i in range(a, b)]
        assert hit == sum(max(x[hi] - x[lo] for x in ratios) > 0 for lo, hi in at)
        assert (fill, note) == tuple((x[b] - x[a]) / max(n, 1) for x in ratios)
    assert scores[0][0] == len(fills) and scores[2][0] == 0


def test_scoring_holds_little_beside_its_result():
    """What hashing and scoring hold on the way is of a fixed size; arrays of the length of the text made it 1.75 times the result before."""
    codes, _ = residue._codes(["amber birch cloud dune " * 20_000])
    tracemalloc.start()
    slots = residue._slots(codes)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 1.3 * sum(s.nbytes for s in slots)
