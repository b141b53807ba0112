"""Imports every module that registers queries."""

from tideline.plans import aggregates, graphs, joins, models, scalars, scans, selection, streams, timeline  # noqa: F401
