"""Moderation and corpus analytics as Spark plans."""
