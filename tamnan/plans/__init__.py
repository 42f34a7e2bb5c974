"""The queries, registered by importing their modules."""

from tamnan.plans import audits, checks, events, files, handles, joins, retrieve, rules, stats, texts  # noqa: F401
