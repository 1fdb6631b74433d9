"""Training-data operators over the documents, pages, embeddings and benchmark tables."""
