"""How much one plan holds: the driver keeps a plan whole, and plans it anew after each of its shuffles."""

from __future__ import annotations

from tracelake.llm import near


def test_near_copies_take_small_plans(spark, monkeypatch):
    """No table of the join by shared elements comes from a plan of several steps."""
    made, stored = [], near.stored

    def counted(df):
        made.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return stored(df)

    monkeypatch.setattr(near, "stored", counted)
    text = [f"w{i}" for i in range(40)]
    texts = [" ".join(text[:i] + [f"v{i}"] + text[i + 1 :]) for i in range(5)]
    df = spark.createDataFrame(list(enumerate([*texts, "another one", None])), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(df, 3, 80).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6}
    assert max(made) <= 16, sorted(made)
