import pytest


@pytest.fixture(scope="session")
def words():
    import numpy as np

    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(400)]
    return lambda n, seed: " ".join(np.random.default_rng(seed).choice(vocabulary, n))
