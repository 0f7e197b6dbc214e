"""Crowds of like texts, of which few are near the class that they are compared with first."""

from __future__ import annotations

import random

from tracelake.llm import near


def test_a_crowd_of_near_copies_costs_few_pairs(spark, monkeypatch):
    """Copies of a text with words replaced: most of them link with each other and few with the bucket's smallest one."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 1, 2, 2, 3, 5))):
            words[at] = f"v{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    made, between = [], near.between

    def counted(rows, key, percent):
        out = between(rows, key, percent)
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "between", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(df, 5, 80).collect()}
    assert sum(made) <= 5 * len(texts)

    sets = [set(near.shingles(t, 5).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    assert got == dict(enumerate(comp))
