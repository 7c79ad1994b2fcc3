"""All queries of this package. Importing the modules registers them."""

from . import queries_native, queries_text, queries_words  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
