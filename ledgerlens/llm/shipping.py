"""Sends the package to the Python workers; see the module of that name above."""

from ledgerlens.shipping import ship_code

__all__ = ["ship_code"]
