from importlib import import_module
from pkgutil import iter_modules


def load_catalog() -> None:
    """Import every module that registers queries."""
    for module in sorted(m.name for m in iter_modules(__path__)):
        if module.startswith("q_"):
            import_module(f"{__name__}.{module}")
