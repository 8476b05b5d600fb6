"""Stream transforms, change data, windows and keyed state."""
