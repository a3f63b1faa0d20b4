"""Column-level helpers: every function takes and returns a ``Column`` and
compiles to built-in Spark expressions (no Python at run time)."""
from quarry.functions.text import *  # noqa: F401,F403
from quarry.functions.vectors import *  # noqa: F401,F403
