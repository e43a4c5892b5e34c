"""Readers, writers, schema shaping and the adapter that turns an event log into a sensor network."""
