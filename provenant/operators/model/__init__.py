"""Scoring models: design, split, fit, metrics, tiers, independent checks."""
