"""Training-data operators: each module holds one operator by its named method."""
