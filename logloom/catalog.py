"""Registered queries and their DuckDB oracles."""

QUERIES: dict = {}
ORACLES: dict = {}


def _register(module) -> None:
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)


from logloom.operators import analysis, blocks, chunks, daily, eligibility, incremental, lookups, notes, quality, reduction, replay, report, sessions, state, validation  # noqa: E402
from logloom.sources import documents, files  # noqa: E402
from logloom.streaming import first_fit, outcomes, reopening  # noqa: E402
from logloom.streaming import sessions as streamed  # noqa: E402

for _module in (blocks, sessions, chunks, reduction, state, incremental, replay, report, notes, daily, eligibility, quality, lookups, validation, analysis, files, documents, streamed, reopening, first_fit, outcomes):
    _register(_module)
