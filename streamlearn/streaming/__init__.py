"""Structured Streaming operators."""

from streamlearn.streaming.online import (
    stream_periods, stream_learn, stream_score, stream_alerts, stream_rates, run_to_completion,
)

__all__ = ["stream_periods", "stream_learn", "stream_score", "stream_alerts", "stream_rates", "run_to_completion"]
