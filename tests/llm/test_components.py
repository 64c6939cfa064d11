import random

import pytest
from conftest import rows

from pairloom.llm.components import components


@pytest.mark.parametrize("shape", ["random", "path", "star", "loops", "none"])
def test_smallest_reachable_node(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "path": [(i, i + 1) for i in range(40)],
        "star": [(i, 50) for i in range(50)],
        "loops": [(1, 1), (2, 1), (1, 2), (2, 1), (None, 4), (4, None)],
        "none": [],
    }[shape]
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got) == sorted(root.items(), key=repr)
