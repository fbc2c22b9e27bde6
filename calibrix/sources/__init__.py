"""Table readers, derived fixtures and file sources/sinks."""

from calibrix.sources.fixtures import comments, eval_log, forecasts_from_events, predictions
from calibrix.sources.tables import read_table

__all__ = ["comments", "eval_log", "forecasts_from_events", "predictions", "read_table"]
