"""Page corpus reader and dataset writers."""
