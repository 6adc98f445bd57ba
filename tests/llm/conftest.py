import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeflmnorstu") for _ in range(draw.randint(2, 9))) for _ in range(300)]

    def make(n, seed=None):
        pick = random.Random(seed) if seed is not None else draw
        return " ".join(pick.choice(vocabulary) for _ in range(n))

    return make
