"""Uploads taken as they arrive."""
