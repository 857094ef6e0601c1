"""Composed plans: feature frame, ML preparation and models, evaluation, catalogue."""
