"""Conversation analytics on Spark: threads of messages as tables of lines."""
