"""Readers: driver tables, manifests, logs, notes, transcripts."""

from logloom.sources.tables import load

__all__ = ["load"]
