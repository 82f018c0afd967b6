"""File-queue streams."""
