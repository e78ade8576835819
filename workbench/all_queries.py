"""Imports every query module so that the registry is complete."""

from workbench import q_audit, q_catalogue, q_evaluation, q_events, q_landmarks  # noqa: F401
from workbench import q_plans, q_profiles, q_robustness, q_sequences, q_smoothing, q_streaming  # noqa: F401
