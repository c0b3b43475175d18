"""Registered queries, binding views and their SQL twins."""

from . import registry  # noqa: F401  (fills the registry before any query module is used)
