"""Intermediate tables, kept in the folder that all executors share."""

from ferrolith.sources.shared import clear, new_path, own_folder, shared_folder, written

__all__ = ["clear", "new_path", "own_folder", "shared_folder", "written"]
