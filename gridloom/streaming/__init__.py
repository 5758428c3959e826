"""Progressive results and event windows."""
