"""DataFrame operators over sources, entries, findings and candidates."""
