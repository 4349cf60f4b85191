"""Registered queries: each operator on the given tables, beside its SQL twin."""

from .registry import ORACLES, QUERIES  # noqa: F401
import importlib
for _m in ("q_metrics", "q_changes", "q_findings", "q_graphs", "q_text", "q_streams"):
    importlib.import_module(f"{__name__}.{_m}")
