"""Incremental loading.

The source analyses are batch only: no stream source, watermark or state.
This package holds one thing, the incremental form of the append step
(``INSERT INTO t SELECT``): new order files are appended to an order table
as they arrive, exactly once, and every batch operator then reads that table.
"""

from tidemark.streaming.append import append_new_files

__all__ = ["append_new_files"]
