"""Readers and writers: sentence logs, height lists, truth and trajectory tables, datagrams."""
