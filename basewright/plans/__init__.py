"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

QUERIES: dict = {}
ORACLES: dict = {}

from basewright.plans import queries  # noqa: E402,F401  registers them
