"""Structured Streaming: hourly means with a watermark as long as the ingestion lag."""
