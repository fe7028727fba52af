"""Training-data operators over documents and embeddings."""
