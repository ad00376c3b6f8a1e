"""The library's operators on the test tables, with an equivalent SQL text for each."""

from . import audiences, attribution, delivered, delivery, files, lift, ordering, partitioned, reports, sheets  # noqa: F401  (register their queries)
from .registry import ORACLES, QUERIES  # noqa: F401
