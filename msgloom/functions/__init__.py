"""Pure Column functions: dates, times, text, keys."""
