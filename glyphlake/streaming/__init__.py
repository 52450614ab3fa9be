"""Streaming forms. The operators have none of their own: they work on a batch, and on each batch of foreachBatch."""
