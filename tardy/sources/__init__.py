"""Table sources: trip table, requests, responses, saved statistics."""
