"""Keyword moderation and corpus analytics on Spark."""
