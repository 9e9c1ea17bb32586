"""Tables from files, rows and generators, and their sinks."""
