"""Training-data operators: documents in, decisions, spans, ids or scores out."""
