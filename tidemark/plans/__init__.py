"""Named queries: operator compositions over the tables, with their SQL twins."""
