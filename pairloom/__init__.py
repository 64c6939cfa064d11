"""Prompt/answer data preparation, evaluation analytics and feedback collection on Spark."""
