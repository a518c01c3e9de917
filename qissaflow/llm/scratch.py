"""Cutting lineage with tables written to the folder all executors share."""

from qissaflow.sources.shared import forget, spread, written

__all__ = ["forget", "spread", "written"]
