"""The registered queries."""

import importlib
import pkgutil


def load_all():
    """Import every `*_queries` module and return the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module}")
    return importlib.import_module(f"{__name__}.registry")
