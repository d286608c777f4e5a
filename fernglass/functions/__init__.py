"""Row functions as Column builders; none of them runs Python per row."""
