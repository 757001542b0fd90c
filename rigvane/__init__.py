"""Multi-view scene analytics on Spark: every operator is a function from DataFrames to DataFrames."""

from importlib import import_module

__version__ = "0.2.0"

#: Public names and their modules; they are imported when asked for, as workers import the package too.
_EXPORTS = {"Engine": "plans.engine", "config": "sources.frames", "load_config": "sources.frames", "Detector": "tracker", "Profile": "tracker", "Tracker": "tracker", "build": "tracker"}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(import_module(f".{_EXPORTS[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
