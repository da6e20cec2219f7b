"""Relational operators over operation logs, file metadata and value logs."""
