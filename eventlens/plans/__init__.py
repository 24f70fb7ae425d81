"""Registered queries over one data folder."""

from eventlens.plans import tables, encoding, masking, batching, scoring, profiling  # noqa: F401, I001
from eventlens.plans.catalog import QUERIES, plain
from eventlens.plans.workspace import Workspace, workspace

__all__ = ["QUERIES", "Workspace", "plain", "workspace"]
