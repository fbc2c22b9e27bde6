"""calibrix: calibration and group-fairness analytics expressed as Spark DataFrame jobs."""

from calibrix.config import GROUPS, get_session, scratch_path

__all__ = ["GROUPS", "get_session", "scratch_path"]
