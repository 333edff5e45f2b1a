"""Operators composed into whole analyses, contexts and runs (`runs`, which also writes documents)."""

from sourceloom.plans.analysis import Analysis
from sourceloom.plans.context import ProjectContext

__all__ = ["Analysis", "ProjectContext"]
