"""Readers and writers for molecule and structure files, and for captured REST pages."""
