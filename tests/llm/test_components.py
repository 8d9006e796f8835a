"""Components against a plain search, in one part and in many."""

import random

import pytest
from tidewell.llm import components as K


def plain(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += near[x]
    return out


@pytest.mark.parametrize("part", [200_000, 7])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components(spark, monkeypatch, part, kind):
    monkeypatch.setattr(K, "PART", part)
    rng = random.Random(part)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    hub = [(2000, 2001 + i) for i in range(60)]
    links = chain + hub + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(50)] + [(5, 5), (None, 3), (4, None), (2000, 2001)]
    if kind == "binary":
        links = [tuple(None if x is None else x.to_bytes(16, "big") for x in p) for p in links]
    rng.shuffle(links)
    got = K.components(spark.createDataFrame(links, f"u {kind}, v {kind}").repartition(5)).collect()
    of = lambda x: bytes(x) if kind == "binary" else x
    assert {of(r.node): of(r.root) for r in got} == plain(links) and len(got) == len({of(r.node) for r in got})
