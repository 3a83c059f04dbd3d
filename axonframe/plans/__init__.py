"""The registered queries and their SQL counterparts."""

from . import catalogue, effects, kernels, networks, signals  # noqa: F401
from .registry import REGISTRY  # noqa: F401
