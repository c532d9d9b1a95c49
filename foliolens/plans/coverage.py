"""Operators of the inventory that have no query of their own, with the reason."""

from __future__ import annotations

_PDF = "reads or writes PDF bytes; no codec is offered"
_DRIVER = "plumbing of the driver (uploads, health, rendering); no DataFrame result"

SKIPPED: dict[str, str] = {
    "S1": _DRIVER, "S15": _PDF, "S17": _PDF, "S18": _PDF,
    "X15": _PDF, "X16": _PDF, "X17": "the same operator as W11",
    "E1": _PDF, "E9": _PDF, "E11": _PDF, "E12": _PDF,
    "E16": _DRIVER, "E21": _DRIVER,
}
