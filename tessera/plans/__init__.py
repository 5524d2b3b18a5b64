"""Plans: the panel of the driver's tables and the batch compiler."""
