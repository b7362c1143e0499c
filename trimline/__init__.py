"""Container right-sizing analytics on Spark."""

from trimline.params import EXACT, INCREMENTAL, Sizing, Tiering

__all__ = ["EXACT", "INCREMENTAL", "Sizing", "Tiering"]
