"""Files that arrive: intake as a stream, weekly figures, and refreshing only the cycles that changed."""
