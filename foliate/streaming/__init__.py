"""Snapshots that arrive one after the other."""
