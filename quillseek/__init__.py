"""Site-search indexing and ranked keyword search as PySpark DataFrame jobs."""

from quillseek.config import SearchConfig

__all__ = ["SearchConfig"]
