"""Archives: housekeeping frames and detector files."""
