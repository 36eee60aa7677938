"""Boosted trees against a plain Python version, on odd rows, and as SQL."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from heliograph.operators import boosting


def plain_boosting(rows, labels, cuts, classes, rounds, depth, rate, ridge):
    """Trees grown row by row; returns the margins of all rows."""
    counts = [labels.count(k) for k in range(classes)]
    margins = [[math.log((c + 1) / (len(rows) + classes)) for c in counts] for _ in rows]

    def grow(own, k, left, g, h):
        total = sum(g[i] for i in own), sum(h[i] for i in own)
        score = lambda a, b: a * a / (b + ridge)
        best = None
        for f in range(len(cuts)):
            for cut in cuts[f]:
                low = [i for i in own if rows[i][f] <= cut]
                if left and low and len(low) < len(own):
                    gl, hl = sum(g[i] for i in low), sum(h[i] for i in low)
                    gain = round(score(gl, hl) + score(total[0] - gl, total[1] - hl) - score(*total), 9)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, f, cut
        if best is None:
            return {i: -rate * total[0] / (total[1] + ridge) for i in own}
        low = [i for i in own if rows[i][best[1]] <= best[2]]
        high = [i for i in own if rows[i][best[1]] > best[2]]
        return grow(low, k, left - 1, g, h) | grow(high, k, left - 1, g, h)

    for _ in range(rounds):
        p = [[math.exp(m) / sum(map(math.exp, own)) for m in own] for own in margins]
        steps = [grow(list(range(len(rows))), k, depth, [p[i][k] - (labels[i] == k) for i in range(len(rows))], [p[i][k] * (1 - p[i][k]) for i in range(len(rows))]) for k in range(classes)]
        margins = [[margins[i][k] + steps[k][i] for k in range(classes)] for i in range(len(rows))]
    return margins


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = []
    for i in range(160):
        k = r.randrange(4)
        values = [round(r.gauss(k, 1.0), 2), round(r.gauss(-k * k, 2.0), 1), float(r.randrange(5)), r.choice([None, float("nan"), 1.0, 2.0])]
        out.append((i, *values, "abcd"[k]))
    return out


def test_margins_equal_plain_python(spark, rows):
    df = spark.createDataFrame(rows, "id int, `f 0` double, f1 double, f2 double, f3 double, kind string")
    names = ["f 0", "f1", "f2", "f3"]
    model = boosting.fit_boosted(df.repartition(3), names, "kind", list("abc") + ["none", "d"], rounds=3, depth=2, bins=8)
    model = boosting.Boosted.from_json(model.to_json())
    low = [[-math.inf if v is None or math.isnan(v) else v for v in r[1:5]] for r in rows]
    want = plain_boosting(low, [[*"abc", "none", "d"].index(r[5]) for r in rows], model.cuts, 5, 3, 2, 0.3, 1.0)
    got = df.select("id", *[m.alias(f"m{k}") for k, m in enumerate(model.margins())]).toPandas().sort_values("id")
    assert np.allclose(got[[f"m{k}" for k in range(5)]].to_numpy(), np.array(want), atol=1e-9)
    scored = boosting.apply_boosted(df, model)
    table = scored.toPandas()
    assert scored.columns[-7:] == ["tree_prediction", "tree_score", "a_pred", "b_pred", "c_pred", "none_pred", "d_pred"]
    p = table[[f"{c}_pred" for c in model.classes]].to_numpy()
    assert np.allclose(p.sum(1), 1) and np.allclose(p.max(1), table["tree_score"]) and (table["tree_prediction"] == np.array(model.classes)[p.argmax(1)]).all()
    assert (table["tree_prediction"] == table["kind"]).mean() > 0.7
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_training_tables(spark, rows):
    schema = "id int, f0 double, f1 double, f2 double, f3 double, kind string"
    none = boosting.fit_boosted(spark.createDataFrame([], schema), ["f0"], "kind", ["a", "b"], rounds=2)
    got = boosting.apply_boosted(spark.createDataFrame(rows[:3], schema), none).collect()
    assert {(r["a_pred"], r["b_pred"], r["tree_prediction"]) for r in got} == {(0.5, 0.5, "a")}
    odd = [(1, None, None, None, None, "a"), (2, None, None, None, None, "b"), (3, 1.0, 1.0, 1.0, 1.0, None), (4, 1.0, 1.0, 1.0, 1.0, "other")]
    same = boosting.fit_boosted(spark.createDataFrame(odd, schema), ["f0", "f1"], "kind", ["a", "b"], rounds=2)
    assert all(not isinstance(tree, list) for round_ in same.trees for tree in round_)  # nothing to split
    scored = boosting.apply_boosted(spark.createDataFrame(odd, schema), same)
    best = boosting.best_per_source(scored.unionByName(scored), "id").collect()
    assert sorted(r["id"] for r in best) == [1, 2, 3, 4] and all(abs(r["a_pred"] - 0.5) < 1e-9 for r in best)
