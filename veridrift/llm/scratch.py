"""Intermediate tables of the corpus operators; see ``veridrift.sources.tables``."""

from veridrift.sources.tables import materialize, owned, roots, scratch_path, shared_dir

__all__ = ["materialize", "owned", "roots", "scratch_path", "shared_dir"]
