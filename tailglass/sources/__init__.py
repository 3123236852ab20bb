"""Tables of lines and listings of files."""
