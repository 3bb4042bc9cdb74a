"""Scalar Column functions (text and URL)."""

from .text import *  # noqa: F401,F403
from .urls import *  # noqa: F401,F403
