"""Column functions: codes, tags, boxes and times."""
