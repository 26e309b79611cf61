"""Registered queries; importing any of them registers all, in one order."""

from .. import registry  # noqa: F401
