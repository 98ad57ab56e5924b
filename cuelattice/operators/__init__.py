"""DataFrame operators: catalog resolution, series passes, intervals, edits, mixing."""
