"""Graph sources: tables, edge-list files and generators."""
