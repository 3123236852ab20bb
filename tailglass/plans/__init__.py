"""Where to read on, and what to remember: cursors and rotated copies as joins over tables."""
