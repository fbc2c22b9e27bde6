"""Structured Streaming versions of the loss accumulation (T1) and the patience logic."""

from calibrix.streaming.group_loss import stream_group_loss
from calibrix.streaming.patience import stream_early_stop
from calibrix.streaming.sources import stage_in_order

__all__ = ["stage_in_order", "stream_early_stop", "stream_group_loss"]
