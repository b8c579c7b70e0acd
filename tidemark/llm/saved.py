"""Tables that cut a job's lineage; see `tidemark.functions.saved`."""

from ..functions.saved import drop, folder, saved, scratch

__all__ = ["drop", "folder", "saved", "scratch"]
