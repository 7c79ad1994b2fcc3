"""Named plans. Importing the modules registers them."""

from . import meshes, points, rows, timeline, views  # noqa: F401
from .registry import ORACLE as _PLAIN
from .registry import QUERIES, with_views  # noqa: F401

ORACLE = {key: with_views(sql) for key, sql in _PLAIN.items()}
