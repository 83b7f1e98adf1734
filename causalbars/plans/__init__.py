"""Named queries over the tables of a data directory, and their SQL counterparts."""
