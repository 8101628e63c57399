"""Named queries over the sample tables. Importing this package fills the registry."""

import importlib

MODULES = (
    "relational", "windows", "scalars", "loads", "typing", "parity", "quality", "dml",
    "access", "semantic", "estate_graph", "estate_rules", "scans", "integrity",
    "ingest", "streams", "learning", "udfs",
)


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"carryover.plans.{m}")
