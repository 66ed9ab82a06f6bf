"""Rows that joins on shingles make for documents and families around one passage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import neardups


def rows_of_joins(df, on):
    """Rows made by the joins on ``on`` of a plan that has run."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
            continue
        if name.endswith("QueryStage"):
            plans.append(plan.plan())
            continue
        if "Join" in name and plan.leftKeys().mkString(",").split("#")[0] == on:
            total += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture
def made(monkeypatch):
    """Rows made by each written table's joins on ``key``."""
    counts, real = [], neardups.store

    def counted(df, label):
        df.collect()
        counts.append((label, rows_of_joins(df, "key")))
        return real(df, label)

    monkeypatch.setattr(neardups, "store", counted)
    return counts


def test_shingles_of_one_document_join_nothing(spark, made):
    sets = {i: {*range(30), *range(1000 * i + 1000, 1000 * i + 1070)} for i in range(40)}
    sets[40] = (sets[7] - {1007 + 7000}) | {99}
    rows = [(i, np.array(sorted(s), np.int64).tobytes()) for i, s in sets.items()]
    whole = spark.createDataFrame(rows, "id bigint, values binary")
    left = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "id bigint, n bigint")
    lists, _ = neardups._rare_lists(left, whole, 85)
    owners = {}
    for i, s in sets.items():
        for key in s:
            owners.setdefault(key, set()).add(i)
    want = set()
    for i, s in sets.items():
        order = sorted(s, key=lambda k: (len(owners[k]), k))
        first = order[: len(s) - -(-len(s) * 85 // 100) + 1]
        want |= {(k, i, len(s), sum(len(owners[x]) == 1 for x in s)) for k in first if len(owners[k]) > 1}
    assert want and {(r["key"], r["id"], r["n"], r["u"]) for r in lists.collect()} == want
    shared = sum(len(s) for s in owners.values() if len(s) > 1)
    assert 0 < dict(made)["rare"] <= shared


def test_families_around_one_passage_meet_no_other(spark, made):
    families = 12
    sets = {}
    for f in range(families):
        for i in range(5):
            own = range(1000 * f + 1000, 1000 * f + 1048)
            sets[100 * f + i] = {*range(50), *own, 10**6 + 100 * f + i, 10**6 + 100 * f + i + 50}
    loose = {1: {*range(4000, 4048), *range(40), 7}, 2: {*range(50)}, 3: {*range(30), *range(2 * 10**6, 2 * 10**6 + 50)}}
    family = {i: i // 100 * 100 for i in sets} | {5000 + i: None for i in loose}
    sets |= {5000 + i: s for i, s in loose.items()}
    values = spark.createDataFrame([(i, len(s), k) for i, s in sets.items() for k in s], "id bigint, n bigint, key bigint")
    owners = spark.createDataFrame(list(family.items()), "id bigint, family bigint")
    unions = {}
    for i, f in family.items():
        if f is not None:
            unions.setdefault(f, set()).update(sets[i])
    want = {
        (i, f) for i, s in sets.items() for f, u in unions.items() if f != family[i] and 100 * len(s & u) >= 85 * len(s)
    }
    found = neardups._covered(values, owners, 85).orderBy(F.col("id"))
    assert {tuple(r) for r in found.collect()} == want
    assert {i for i, _ in want} == {5001, 5002}
    # a row for each of a passage's shingles, documents and families would be 36,000 and more
    rows = values.count()
    assert sum(v for _, v in made) + rows_of_joins(found, "key") <= 2 * rows
