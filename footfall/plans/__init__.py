"""Jobs and views put together from the operators."""
