"""Readers and writers."""

from pairloom.sources.readers import *  # noqa: F401,F403
from pairloom.sources.writers import *  # noqa: F401,F403
