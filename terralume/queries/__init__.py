"""Every operator bound to the driver tables, with its oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import Query, registered


def load_all() -> dict[str, Query]:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registered()
