import random

from lodestone.llm.components import components


def test_components_match_a_plain_search(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(50)] + [(7, 7)]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            v = todo.pop()
            if v not in want:
                want[v] = start
                todo += near[v]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
