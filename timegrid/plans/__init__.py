"""Registered queries."""

from timegrid.plans import codecs, media, relations, shapes, timeline  # noqa: F401
from timegrid.plans.registry import ORACLE, QUERIES  # noqa: F401
