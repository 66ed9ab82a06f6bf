"""Composed jobs: expression scoring, search, trials, training."""
