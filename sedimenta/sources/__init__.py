"""Table, file, archive and paginated REST sources."""
