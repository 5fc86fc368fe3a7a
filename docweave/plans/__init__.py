"""Registered queries over the driver tables."""

from docweave.plans import documents, functions, groups, keyed, lookups, texts  # noqa: F401
