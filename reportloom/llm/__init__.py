"""Training-data operators over documents, conversations and benchmark tables."""
