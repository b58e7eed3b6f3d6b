"""Reports from partial results: exact figures equal one pass over all, sketches are near the true quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.plans.queries import QUERIES
from foliant.operators.metric_report import partials, report
from foliant.operators.retrieval_metrics import METRICS

SCHEMA = "tenant string, source string, recall_at_k double, precision_at_k double, hit_rate double, mrr double, score double"


def _rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tenant = rng.choice(["a", "a", "a", "b", None])
        hit = float(rng.random() < 0.7)
        score = rng.gauss(0.5, 0.2) if i % 17 else rng.choice([None, float("nan"), float("inf")])
        out.append((tenant, rng.choice(["web", "code", None]), hit * rng.random(), hit * 0.4, hit, hit / rng.randint(1, 5), score))
    return out


def _exact(rows, level):
    groups = {}
    for r in rows:
        key = {"all keys": r[:2], "tenant": (r[0], None), "source": (None, r[1]), "total": (None, None)}[level]
        groups.setdefault(key, []).append(r)
    return groups


def test_levels_merge_and_quantiles(spark):
    rows = _rows(6000)
    df = lambda part: spark.createDataFrame(part, SCHEMA).repartition(3)
    merged = report(partials(df(rows[:1000])).unionByName(partials(df(rows[1000:]))))
    whole = report(partials(df(rows)))
    exact = lambda d: {(r["level"], r["tenant"], r["source"]): (r["queries"], r["misses"], r["scored"], r["score_min"], r["score_max"], *(round(r[m], 9) for m in METRICS)) for r in d.collect()}
    assert exact(merged) == exact(whole)
    seen = 0
    for r in merged.collect():
        group = _exact(rows, r["level"])[(r["tenant"], r["source"])]
        scores = sorted(x[6] for x in group if x[6] is not None and abs(x[6]) < float("inf"))
        assert (r["queries"], r["scored"]) == (len(group), len(scores))
        assert r["mrr"] == pytest.approx(sum(x[5] for x in group) / len(group))
        for q, v in zip((0.1, 0.5, 0.9), r["quantiles"], strict=True):
            assert abs(sum(s <= v for s in scores) / len(scores) - q) < 0.02
        seen += 1
    assert seen == sum(len(_exact(rows, x)) for x in ("all keys", "tenant", "source", "total"))


def test_groups_without_scores_and_empty_tables(spark):
    rows = [("a", None, None, None, 0.0, None, None), ("b", "web", 1.0, 1.0, 1.0, 1.0, 0.25)]
    made = {(r["level"], r["tenant"], r["source"]): r for r in report(partials(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert made[("tenant", "a", None)]["quantiles"] is None and made[("tenant", "a", None)]["recall_at_k"] == 0
    assert made[("source", None, None)]["queries"] == 1 and made[("total", None, None)]["queries"] == 2
    assert made[("total", None, None)]["quantiles"] == [0.25] * 3
    assert report(partials(spark.createDataFrame([], SCHEMA))).collect() == []


def test_one_key(spark):
    made = report(partials(spark.createDataFrame(_rows(40), SCHEMA), ["tenant"]), ["tenant"])
    assert {r["level"] for r in made.collect()} == {"tenant", "total"}
    assert made.where(F.col("level") == "total").first()["queries"] == 40


def test_the_query_searches_once(spark):
    made = QUERIES["metric_report"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in made._jdf.queryExecution().toString() and made.count() > 0
