"""All queries, imported for their side effect of registering."""

from __future__ import annotations

from .base import ORACLE, QUERIES  # noqa: F401
from . import q_functions  # noqa: F401
from . import q_zones  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_clean  # noqa: F401
from . import q_quality  # noqa: F401
from . import q_sources  # noqa: F401
