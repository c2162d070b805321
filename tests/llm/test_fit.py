import random

import numpy as np

from formweave.llm import mixing


def test_long_documents_meet_their_budget():
    got = mixing.fit(np.array([30_001, 50_000]), np.array([3, 2]), 100_000)
    assert got.tolist() == [0, 2]
    rng = random.Random(3)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(20_000, 60_000), 4)))
        counts = np.array([rng.randrange(1, 6) for _ in lengths])
        budget = rng.randrange(40_000, 400_000)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * j for s in sums for j in range(c + 1) if s + n * j <= budget}
        got = mixing.fit(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all() and (lengths * got).sum() == max(sums)
