"""Goals as DataFrame operations."""
