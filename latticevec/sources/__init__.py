"""Vector files, the store of built parts, and run logs."""
