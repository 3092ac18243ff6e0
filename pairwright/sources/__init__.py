"""Tables that reviews, annotations and rankings are read from and written to."""
