"""Numbers of links of fingerprints against all pairs."""

import random

import numpy as np
import pytest

from foliant.llm import fingerprints
from foliant.llm.fingerprints import BITS, RADIUS


def made(seed: int, hot: bool) -> list[tuple]:
    rng = random.Random(seed)
    out: list[int] = []
    for _ in range(12):
        base = rng.getrandbits(BITS)
        for _ in range(rng.choice([1, 3, 9])):
            x = base
            for b in rng.sample(range(BITS), rng.randrange(0, 6)):
                x ^= 1 << b
            out += [x] * rng.choice([1, 1, 2])
    if hot:  # many different ones with a shared block
        block = rng.getrandbits(32)
        out += [(rng.getrandbits(BITS - 32) << 32) | block for _ in range(40)]
        near = (rng.getrandbits(BITS - 32) << 32) | block
        out += [near ^ (1 << rng.randrange(32, BITS)) for _ in range(30)]
    return [(i, x.to_bytes(BITS // 8, "little")) for i, x in enumerate(out)] + [(None, out[0].to_bytes(BITS // 8, "little"))]


@pytest.mark.parametrize(("block", "hot"), [(1024, False), (3, True), (20, True)])
def test_number_of_links(spark, block, hot):
    rows = made(block, hot)
    got = fingerprints.near_classes(spark.createDataFrame(rows, "doc_id long, fp binary"), block=block).collect()
    fps = [np.frombuffer(bytes(r["fp"]), "<u8") for r in got]
    want = [sum(int(np.bitwise_count(a ^ b).sum()) <= RADIUS for j, b in enumerate(fps) if j != i) for i, a in enumerate(fps)]
    assert [r["near_links"] for r in got] == want and max(want) > 5


def test_links_are_told_once():
    """Blocks against blocks, in groups larger and smaller than two blocks."""
    from foliant.llm.simhash import tiled

    rng = np.random.default_rng(1)
    values, groups = rng.integers(0, 8, 60).astype(np.uint64), np.sort(rng.integers(0, 3, 60))
    told = []
    list(tiled(values, groups, lambda x: np.bitwise_count(x) <= 1, 5, lambda a, b: told.extend(zip(a.tolist(), b.tolist(), strict=True))))
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if groups[i] == groups[j] and int(values[i] ^ values[j]).bit_count() <= 1]
    assert sorted(told) == want
