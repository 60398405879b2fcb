"""DataFrame in, DataFrame out; every operator works on all series at once."""
