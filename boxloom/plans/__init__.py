"""Query catalogue. Importing it registers every query."""

from boxloom.plans.registry import REGISTRY  # noqa: F401
from boxloom.plans import answering, books, detection, files, grouping, layout, overlays  # noqa: F401
