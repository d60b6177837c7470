"""The library's shared tables, under the name that the operators use."""

from tidepool.plans.store import delete, delete_at_end, drop, release, shared_folder, written

__all__ = ["delete", "delete_at_end", "drop", "release", "shared_folder", "written"]
