from barweave.streaming.audit import AuditFailed, audit_stream, latest_blocks
from barweave.streaming.daily import audit_micro_batches, daily_sentiment_stream, drain

__all__ = ["AuditFailed", "audit_micro_batches", "audit_stream", "daily_sentiment_stream", "drain", "latest_blocks"]
