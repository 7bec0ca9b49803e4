"""Streams of snapshots."""

from eigenflux.streaming.incremental import IncrementalPOD, hourly_snapshots

__all__ = ["IncrementalPOD", "hourly_snapshots"]
