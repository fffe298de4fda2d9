"""Source files to chunk rows."""
