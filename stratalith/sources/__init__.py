"""Readers and writers: text formats, files, snapshots and logs."""
