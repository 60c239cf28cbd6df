"""The queries over the driver's tables; importing the package registers all of them."""

from . import analysis, feeds, football, ingestion, modelling, pit, relational  # noqa: F401
