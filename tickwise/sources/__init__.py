"""Readers, decoders, validators and sinks."""
