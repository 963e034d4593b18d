from . import scalar  # noqa: F401
