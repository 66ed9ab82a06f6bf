"""The registered searches run the built-in settings as they are."""

from __future__ import annotations

import os

import pytest

from factorloom import catalog
from factorloom.plans import mining, search

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")

TRIALS = [(c.functions().keys(), c.search) for c in mining.TRIAL_CONFIGS]
FINAL = [(mining.FINAL_CONFIG.functions().keys(), mining.FINAL_CONFIG.search)]


@pytest.mark.parametrize(
    ("name", "want"),
    [("search_factors", FINAL), ("train_final_search", FINAL), ("trial_configs", TRIALS), ("write_trial_history", TRIALS)],
)
def test_registered_searches_run_the_built_in_settings(spark, monkeypatch, name, want):
    seen = []

    def noted(series, target, searches, where=None, journal=None):
        seen.extend((s.functions.keys(), s.settings) for s in searches)
        return [search.SearchResult("open", 1.0, 0.0, 0.0, 1, [(0, 0, "open", 1, 1.0, 0.0, 0.0, 1.01)]) for _ in searches]

    monkeypatch.setattr(mining, "search_all", noted)
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
    assert seen == want
