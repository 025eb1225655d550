import random

import pytest

WORDS = "river stone garden window letter market number signal bridge winter summer yellow copper silver planet forest engine mirror basket candle hammer ribbon saddle tunnel violin walnut anchor barrel castle dragon".split()


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words that are the same for a seed."""

    def text(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return text
