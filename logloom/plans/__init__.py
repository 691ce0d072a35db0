"""Plan helpers: shared folders and lineage cuts."""

from logloom.plans.shared import Scratch, clear_shared, once, shared_path, splittable, written

__all__ = ["Scratch", "clear_shared", "once", "shared_path", "splittable", "written"]
