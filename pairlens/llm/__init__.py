"""Training-data operators: ten components over documents, pages, conversations and embeddings."""
