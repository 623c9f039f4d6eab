"""Where messages and media rows come from."""
