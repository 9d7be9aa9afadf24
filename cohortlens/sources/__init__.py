"""Readers for the text and table layouts of a study, and the update-only result sink."""
