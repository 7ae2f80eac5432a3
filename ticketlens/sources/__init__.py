"""Readers and writers of ticket files and warehouse tables."""
