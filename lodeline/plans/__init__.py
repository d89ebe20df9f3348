"""Queries over the driver's tables; importing registers them."""

from lodeline.plans import documents, evaluation, extra, graph, knowledge, logs, rank, search, text, vectors  # noqa: F401
