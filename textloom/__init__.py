"""textloom: document-intelligence and retrieval analytics as DataFrame pipelines."""
