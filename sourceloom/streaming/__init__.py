"""Continuous form of the incremental update."""

from sourceloom.streaming.updates import apply_batch, start_updates

__all__ = ["apply_batch", "start_updates"]
