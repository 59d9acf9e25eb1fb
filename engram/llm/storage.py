"""Intermediate tables that survive the loss of an executor; see ``engram.storage``."""

from ..storage import durable, release, shared_dir, tables

__all__ = ["durable", "release", "shared_dir", "tables"]
