"""Every registered query with its SQL twin."""

from __future__ import annotations

from chiffra.plans import answers, assembly, figures, layout, more, notes, overview, retrieval, structure, texts  # noqa: F401
from chiffra.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
