"""Column functions and their SQL registration."""
from .scalar import *  # noqa: F401,F403
from .register import register  # noqa: F401
