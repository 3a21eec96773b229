from .vectors import *  # noqa: F403
