"""Operators put together: preparation, one-shot run, tuning, forecast."""
