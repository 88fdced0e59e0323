"""Registered queries over the driver's tables; importing the package registers all of them."""

from hydrolith.plans import catalog, coverage, digests, documents, extras, operations, records, revisions, serving, stations, streams, times  # noqa: F401
