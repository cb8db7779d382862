"""Feed file readers and table readers."""
