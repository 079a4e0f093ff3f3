"""The same networks over unbounded input."""
