"""Importing this module registers every query."""

from dischargelab.plans import q_cluster, q_merge, q_misc, q_pipelines, q_shapes, q_signal, q_trains  # noqa: F401
from dischargelab.plans.registry import ORACLES, QUERIES  # noqa: F401
