"""Operators for preparing language-model training data.

Nothing else in the library imports this folder. General helpers (shared scratch folder, broadcast
bounds) come from :mod:`geocairn.plans.session`.
"""
