"""The review log as a stream."""
