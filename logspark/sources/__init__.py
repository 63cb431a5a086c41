"""Log files, command output and registered tables as DataFrames."""
