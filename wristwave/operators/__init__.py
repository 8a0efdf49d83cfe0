"""DataFrame -> DataFrame operators over sample, window, beat and trial tables."""
