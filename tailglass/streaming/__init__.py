"""Watches over streams of lines."""
