"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from ..operators.scratch import drop, new_path, shared_dir, staged

__all__ = ["drop", "new_path", "shared_dir", "staged"]
