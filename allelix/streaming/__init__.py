"""Running sums over arriving count batches; an extension, since counts of batches add up."""
