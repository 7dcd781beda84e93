"""Sources, soft-delete filters, readers and writers."""

from loanlens.sources.catalog import MissingColumns, Sources, active, lit_date, require

__all__ = ["MissingColumns", "Sources", "active", "lit_date", "require"]
