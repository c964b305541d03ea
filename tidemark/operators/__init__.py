"""Operators over the long table of observations: sid, ts, v; a missing value is NULL."""
