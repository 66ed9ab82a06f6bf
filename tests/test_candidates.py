"""Candidates of a search over many columns: every pair has its chance."""

from __future__ import annotations

from factorloom.functions import registry as reg
from factorloom.plans import search

COLUMNS = [f"x{i}" for i in range(300)]
ADD = {"safe_add": reg.default_registry((3,))["safe_add"]}


def test_no_pair_of_many_columns_is_left_out():
    drawn = search.draw(COLUMNS, COLUMNS, ADD, 1, 10**6, "1|0")
    assert len(drawn) == 300 * 300 and set(drawn) == {("safe_add", a, b) for a in COLUMNS for b in COLUMNS}


def test_draws_follow_seed_and_round_and_are_even():
    salts = [f"{seed}|{number}" for seed in range(5) for number in range(4)]
    draws = [search.draw(COLUMNS, [*COLUMNS, 1.0], ADD, 1, 1000, s) for s in salts]
    assert draws[0] == search.draw(COLUMNS, [*COLUMNS, 1.0], ADD, 1, 1000, salts[0])
    assert all(len(set(d)) == 1000 for d in draws)
    assert len({e for d in draws for e in d}) > 17_000  # 20 draws of 90,600 overlap little
    apart = [abs(int(a[1:]) - int(b[1:])) for d in draws for _, a, b in d if isinstance(a, str) and isinstance(b, str)]
    assert 95 < sum(apart) / len(apart) < 105  # of even draws: 100


def test_a_search_meets_pairs_outside_any_window():
    settings = search.SearchSettings(population_size=10**6, generations=1)
    met = search.Search(COLUMNS, ADD, settings).candidates
    assert {("safe_add", a, b) for a in COLUMNS for b in COLUMNS} <= set(met)


def test_seen_formulas_are_not_drawn_and_few_places_are_held():
    many = [f"x{i}" for i in range(200_000)]
    first = search.draw(many, many, ADD, 1, 50, "1|0")
    assert len(first) == 50
    assert not set(first) & set(search.draw(many, many, ADD, 1, 50, "1|0", set(first)))
    assert search.draw(many, many, ADD, 0, 50, "1|0") == []
    assert len(search.draw(["a", "b"], ["a", "b"], ADD, 1, 50, "1|0", {("safe_add", "a", "b")})) == 3
