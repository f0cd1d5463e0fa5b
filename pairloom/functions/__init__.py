"""Column functions."""

from pairloom.functions.names import *  # noqa: F401,F403
from pairloom.functions.parsing import *  # noqa: F401,F403
from pairloom.functions.sequence import *  # noqa: F401,F403
