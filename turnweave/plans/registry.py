"""All queries by name."""

from __future__ import annotations

from turnweave.plans import catalogs, files, lists, runs, scalars, segments

ALL = {
    name: entry
    for module in (segments, catalogs, runs, scalars, files, lists)
    for name, entry in module.QUERIES.items()
}
