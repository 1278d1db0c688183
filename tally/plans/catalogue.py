"""Imports every catalogue module so that its queries register."""

from tally.plans import q_history, q_metrics, q_models, q_prep, q_profile, q_sources, q_studies, q_vectors  # noqa: F401
