"""Objects that outlive a task in a Python worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object of this name in this worker, made on first use. Functions travel to workers by value, so their own
    modules cannot hold it; a module of no other content does."""
    holder = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
