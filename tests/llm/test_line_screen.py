import random

import numpy as np

from quartzframe.llm import line_dedup as ld


def test_the_screen_loses_no_pair_of_two_classes():
    """Any edits up to the threshold stay within what the parities allow; only pairs of one class are passed over."""
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefghij ", "aé😀\x00퟿z"])
        a = [rng.choice(letters) for _ in range(rng.randrange(20, 60))]
        b, edits = list(a), rng.randrange(1, 4)
        for _ in range(edits):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
        parities = [np.array(c, np.int64) for c in zip(*(ld.parities("".join(x)) for x in (a, b)))]
        pair = np.array([0]), np.array([1])
        assert len(ld.screened(*pair, np.array([0, 1]), *parities, edits)[0]) == 1
        assert len(ld.screened(*pair, np.array([7, 7]), *parities, edits)[0]) == 0
