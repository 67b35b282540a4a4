"""Conversation-dataset engine on Spark: DataFrame in, DataFrame out."""
