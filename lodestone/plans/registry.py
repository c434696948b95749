"""All queries of the engine outside the training-data subpackage, by name."""

from . import deeper, graphs, memory, more, rest, texts, views, wider  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
