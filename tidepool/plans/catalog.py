"""All registered queries (importing the plan modules registers them)."""

from . import models, streams, topics  # noqa: F401
from .common import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
